"""Normal forms of titles as column expressions; Python runs only for NFC, and only on texts with marks."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from titleforge.functions import fixed as X


@dataclass(frozen=True)
class Rules:
    """How titles are normalised."""

    digits: str = "fa"
    core_stopwords: bool = True
    extra_stopwords: bool = True
    custom_stopwords: tuple[str, ...] = ()
    strip_years: bool = True
    zwnj: str = "strip"
    min_token_len: int = 1
    names: tuple[str, ...] = X.GIVEN_NAMES
    unknown: tuple[str, ...] = X.UNKNOWN_MARKERS


    @classmethod
    def of(cls, options: dict | None) -> Rules:
        """From a mapping as a configuration file has it; unknown keys are ignored."""
        o = options or {}
        return cls(
            digits="en" if o.get("digit_target") == "en" else "fa",
            core_stopwords=bool(o.get("use_core_stopwords", True)),
            extra_stopwords=bool(o.get("use_extra_stopwords", True)),
            custom_stopwords=tuple(o.get("custom_stopwords") or ()),
            strip_years=bool(o.get("strip_years", True)),
            zwnj=o.get("zwnj", "strip"),
            min_token_len=int(o.get("min_token_len", 1)),
        )

    @property
    def stopwords(self) -> tuple[str, ...]:
        words: set[str] = set(self.custom_stopwords)
        if self.core_stopwords:
            words.update(X.CORE_STOPWORDS)
        if self.extra_stopwords:
            words.update(X.EXTRA_STOPWORDS + X.AUTHOR_MARKERS + X.ROLE_MARKERS + X.VOLUME_MARKERS)
        return tuple(sorted({plain(w, self) for w in words}))

    @property
    def phrases(self) -> tuple[str, ...]:
        return tuple(" ".join(plain(w, self) for w in p) for p in X.PHRASES)


# --- on the driver: for word lists, and for the scanners that need whole titles in Python ---

_LETTERS = str.maketrans(X.LETTERS)


def _regex(pattern: str, flags: int = 0):
    import re

    return re.compile(pattern, flags)


_GONE, _OTHER = _regex(f"[{X.MARKS}{X.NO_WIDTH}]"), _regex(f"[^{X.KEPT}]")
_JOINER, _SPACES = _regex(rf"\s*{X.ZWNJ}[\s{X.ZWNJ}]*"), _regex(X.SPACES)


def plain(text: str | None, rules: Rules) -> str:
    """The readable normal form of one text (column form: ``display``)."""
    if not text:
        return ""
    to, others = (X.FA_DIGITS, X.EN_DIGITS) if rules.digits == "fa" else (X.EN_DIGITS, X.FA_DIGITS)
    out = _GONE.sub("", unicodedata.normalize("NFC", text).translate(_LETTERS))
    out = _OTHER.sub(" ", out.translate(str.maketrans(others + X.AR_DIGITS, to * 2)).lower())
    out = _JOINER.sub(lambda m: X.ZWNJ if set(m[0]) == {X.ZWNJ} else " ", out)
    return _SPACES.sub(" ", out).strip(X.ZWNJ + " ")


# --- as columns ---


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Canonical composition; only texts with a combining mark travel to Python."""
    return F.coalesce(_nfc(F.when(text.rlike(r"\p{M}"), text)), text)


def map_digits(text: Column, to: str = "fa") -> Column:
    target, others = (X.FA_DIGITS, X.EN_DIGITS) if to == "fa" else (X.EN_DIGITS, X.FA_DIGITS)
    return F.translate(text, others + X.AR_DIGITS, target * 2)


def display(text: Column, rules: Rules = Rules(), compose: bool = True) -> Column:
    """The readable normal form: letters, marks, digits, case, spaces. Null is empty."""
    out = F.coalesce(text, F.lit(""))
    out = nfc(out) if compose else out
    out = F.translate(out, "".join(X.LETTERS), "".join(X.LETTERS.values()))
    out = F.regexp_replace(out, f"[{X.MARKS}{X.NO_WIDTH}]", "")
    out = F.regexp_replace(F.lower(map_digits(out, rules.digits)), f"[^{X.KEPT}]", " ")
    out = F.regexp_replace(out, rf"(?U)\s+{X.ZWNJ}[\s{X.ZWNJ}]*|{X.ZWNJ}+\s[\s{X.ZWNJ}]*", " ")
    out = F.regexp_replace(F.regexp_replace(out, f"{X.ZWNJ}+", X.ZWNJ), X.SPACES, " ")
    return F.regexp_replace(out, f"^[ {X.ZWNJ}]+|[ {X.ZWNJ}]+$", "")


def joined(shown: Column, rules: Rules = Rules()) -> Column:
    """The joiner policy on a readable form."""
    if rules.zwnj == "strip":
        return F.replace(F.regexp_replace(shown, rf"(?U)ه{X.ZWNJ}(?:ای|ی)(?=\s|$)", "ه"), F.lit(X.ZWNJ), F.lit(""))
    if rules.zwnj == "space":
        return F.trim(F.regexp_replace(F.replace(shown, F.lit(X.ZWNJ), F.lit(" ")), X.SPACES, " "))
    return shown


def tokens_of(shown: Column, rules: Rules = Rules()) -> Column:
    return F.filter(F.split(joined(shown, rules), " "), lambda t: t != "")


def tokenize(text: Column, rules: Rules = Rules(), compose: bool = True) -> Column:
    return tokens_of(display(text, rules, compose), rules)


def is_year(token: Column) -> Column:
    return map_digits(token, "en").rlike(X.YEAR)


def drop_phrases(tokens: Column, rules: Rules = Rules()) -> Column:
    """Phrases go from left to right, the longest first: one alternation over the spaced string."""
    some = sorted(rules.phrases, key=lambda p: -len(p.split()))
    if not some:
        return tokens
    spaced = F.concat(F.lit(" "), F.array_join(F.transform(tokens, lambda t: F.concat(t, F.lit(" "))), " "))
    bare = F.regexp_replace(spaced, "(?: (?:" + "|".join(p.replace(" ", "  ") for p in some) + ") )", "")
    return F.filter(F.split(bare, " +"), lambda t: t != "")


def meaningful(tokens: Column, rules: Rules = Rules()) -> Column:
    stops = F.array(*map(F.lit, rules.stopwords)) if rules.stopwords else F.array().cast("array<string>")
    keep = lambda t: ~F.array_contains(stops, t) & (F.length(t) >= rules.min_token_len) & (~is_year(t) if rules.strip_years else F.lit(True))
    return F.filter(drop_phrases(tokens, rules), keep)


def meaningful_tokens(text: Column, rules: Rules = Rules(), compose: bool = True) -> Column:
    return meaningful(tokenize(text, rules, compose), rules)


def normalize(text: Column, rules: Rules = Rules(), compose: bool = True) -> Column:
    """The form in which titles are compared."""
    return F.array_join(meaningful_tokens(text, rules, compose), " ")


def collapsed(words: list[str], longest: int = 4) -> list[str]:
    for _ in range(3):
        out, at = [], 0
        while at < len(words):
            n = next((n for n in range(min(longest, (len(words) - at) // 2), 0, -1) if words[at : at + n] == words[at + n : at + 2 * n]), 0)
            out += words[at : at + max(n, 1)]
            at += 2 * n or 1
        if len(out) == len(words):
            return out
        words = out
    return words


@F.pandas_udf(StringType())
def collapse_repeats(text: pd.Series) -> pd.Series:
    """Adjoining repeats of up to four words become one, in up to three rounds."""
    return text.map(lambda t: None if t is None else " ".join(collapsed(t.split())))


def search_query(text: Column, rules: Rules = Rules(), max_words: int = 8, compose: bool = True, collapse: bool = True) -> Column:
    """A title as one would type it into a search box; the readable form where nothing is left."""
    shown = display(text, rules, compose)
    shown = collapse_repeats(shown) if collapse else shown
    noise = F.array(*map(F.lit, X.QUERY_NOISE))

    def wanted(token: Column) -> Column:
        # a token is probed alone, so a phrase never matches; a joiner may split it into several words
        left = meaningful(tokens_of(display(token, rules, False), rules), rules)
        return (F.size(left) > 0) & ~F.array_contains(noise, F.array_join(left, " "))

    kept = F.slice(F.array_distinct(F.filter(F.split(shown, " "), wanted)), 1, max_words)
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(shown)


def variants_of(query: Column, min_words: int = 3, prefixes: tuple[str, ...] = X.QUERY_PREFIXES) -> Column:
    """A query, then by turns a shorter form and a form with a prefix; distinct."""
    words = F.filter(F.split(query, " "), lambda w: w != "")
    n = F.size(words)
    core = F.array_join(F.slice(words, 1, 4), " ")
    shorter = F.when(n - 1 >= min_words, F.transform(F.sequence(n - 1, F.lit(min_words)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))).otherwise(F.array().cast("array<string>"))
    prefixed = F.array(*(F.trim(F.concat(F.lit(f"{p} "), core)) for p in prefixes)) if prefixes else F.array().cast("array<string>")
    turns = F.filter(F.flatten(F.zip_with(shorter, prefixed, lambda a, b: F.array(a, b))), lambda q: q.isNotNull())
    all_forms = F.filter(F.array_distinct(F.concat(F.array(query), turns)), lambda q: q != "")
    return F.when(n > 0, all_forms).otherwise(F.array().cast("array<string>"))


def search_variants(text: Column, rules: Rules = Rules(), max_words: int = 8, min_words: int = 3, prefixes: tuple[str, ...] = X.QUERY_PREFIXES, compose: bool = True, collapse: bool = True) -> Column:
    return variants_of(search_query(text, rules, max_words, compose, collapse), min_words, prefixes)


def coverage(found: Column, wanted: Column) -> Column:
    """Share of the wanted tokens among the found ones; 1 where nothing is wanted."""
    want = F.array_distinct(wanted)
    return F.when(F.size(want) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(want, found)) / F.size(want))


def covers(suggestion: Column, query: Column, rules: Rules = Rules(), min_ratio: float = 1.0, compose: bool = True) -> Column:
    return coverage(meaningful_tokens(suggestion, rules, compose), meaningful_tokens(query, rules, compose)) >= min_ratio


def residual(a: Column, b: Column) -> Column:
    """Sorted words of ``a`` that ``b`` lacks."""
    return F.array_sort(F.array_except(a, b))
