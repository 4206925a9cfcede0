"""Titles, links, product signals and content measures of landed pages."""

from __future__ import annotations

import html as _html
import urllib.parse
from functools import reduce
from html.parser import HTMLParser
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from titleforge.functions import fixed as X
from titleforge.functions.text import collapsed


@F.pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else _html.unescape(t))


#: Entities that need no Python, the ampersand last.
_COMMON = {
    "&quot;": '"', "&lt;": "<", "&gt;": ">", "&#39;": "'", "&#039;": "'", "&apos;": "'", "&nbsp;": "\u00a0", "&copy;": "©", "&middot;": "·",
    "&#8211;": "–", "&#8212;": "—", "&ndash;": "–", "&mdash;": "—", "&#8216;": "‘", "&#8217;": "’", "&#8220;": "“", "&#8221;": "”", "&#8230;": "…",
    "&laquo;": "«", "&raquo;": "»", "&hellip;": "…", "&zwnj;": "\u200c", "&#124;": "|", "&#038;": "&", "&#38;": "&", "&amp;": "&",
}
_RARE = r"&(?!(?:" + "|".join(e[1:-1] for e in _COMMON) + r");)#?[A-Za-z0-9]"


def _native(text: Column) -> Column:
    # no entity in the text: none of the replacements run
    return F.when(text.contains("&"), reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), _COMMON.items(), text)).otherwise(text)


def unescape(text: Column) -> Column:
    """Common entities natively; only texts with any other travel to Python."""
    rare = text.rlike(_RARE)
    return F.when(rare, _unescape(F.when(rare, text))).otherwise(_native(text))


def some(text: Column) -> Column:
    """Null for an empty text. (``nullif`` makes a common expression that can't hold a Python function.)"""
    return F.when(text != "", text)


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def strip_tags(fragment: Column) -> Column:
    return squeeze(unescape(F.regexp_replace(fragment, r"<[^>]+>", " ")))


def without_scripts(page: Column) -> Column:
    return F.regexp_replace(page, r"(?isU)<(script|style|noscript)[^>]*>.*?</\1>".replace("(?isU)", "(?is)"), " ")


def _first(page: Column, pattern: str) -> Column:
    """The first match without tags; its entities stay, but for the common ones. Null where nothing is left."""
    return some(squeeze(_native(F.regexp_replace(F.regexp_extract(page, f"(?is){pattern}", 1), r"<[^>]+>", " "))))


def strip_site_name(title: Column, page: Column, domain: Column, site_name: Column) -> Column:
    """Drops the parts of a title that provably name the site; unchanged where none does."""
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    own = F.coalesce(_first(page, r"""<meta[^>]+property=["']og:site_name["'][^>]+content=["'](.*?)["']"""), F.lit(""))
    label = F.element_at(F.split(F.replace(text(domain), F.lit("www."), F.lit("")), r"\."), 1)
    names = F.filter(F.array(F.trim(text(site_name)), F.lower(own), text(domain), label), lambda n: n != "")
    whole = F.trim(F.coalesce(title, F.lit("")))
    parts = F.filter(F.transform(F.split(whole, f"(?U){X.TITLE_SEPARATOR}"), lambda p: F.trim(p)), lambda p: p != "")
    kept = F.filter(parts, lambda p: ~F.exists(names, lambda n: F.contains(F.lower(p), n)))
    # of the longest parts the first
    longest = F.array_max(F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), (-i).alias("i"), p.alias("p"))))["p"]
    return F.when((F.size(parts) < 2) | (F.size(names) == 0) | (F.size(kept) == F.size(parts)), whole).when(F.size(kept) == 0, longest).otherwise(F.array_join(kept, " "))


def title_candidate(page: Column, domain: Column | None = None, site_name: Column | None = None) -> Column:
    """h1, else og:title, else title without the site's name; empty where there is none. Common entities only."""
    domain, site_name = (F.lit("") if c is None else c for c in (domain, site_name))
    return F.coalesce(
        _first(page, r"<h1[^>]*>(.*?)</h1>"),
        _first(page, r"""<meta[^>]+property=["']og:title["'][^>]+content=["'](.*?)["']"""),
        _first(page, r"""<meta[^>]+content=["'](.*?)["'][^>]+property=["']og:title["']"""),
        strip_site_name(_first(page, r"<title[^>]*>(.*?)</title>"), page, domain, site_name),
        F.lit(""),
    )


@F.pandas_udf(StringType())
def finished_title(title: pd.Series) -> pd.Series:
    """Rare entities and adjoining repeats, in one pass."""
    return title.map(lambda t: None if t is None else " ".join(collapsed(_html.unescape(t).split())))


def with_title(pages: DataFrame, page: Column, domain: Column | None = None, site_name: Column | None = None, into: str = "title") -> DataFrame:
    """Adds the finished title.

    The candidate passes a generator of one row, so that the Python function reads a plain column: with lambdas in
    its argument the optimizer may leave the function where it can't be evaluated.
    """
    out = pages.select("*", F.explode(F.array(title_candidate(page, domain, site_name))).alias("_candidate"))
    return out.withColumn(into, finished_title("_candidate")).drop("_candidate")


def product_signals(page: Column, url: Column) -> Column:
    """struct(is_product, reasons, blockers)."""
    text = without_scripts(page)
    strong = reduce(or_, (page.rlike(f"(?iu){p}") for p in X.STRONG_PRODUCT))
    listed = lambda rules, where: F.filter(F.array(*(F.when(where.rlike(f"(?iuU){p}"), F.lit(label)) for label, p in rules)), lambda x: x.isNotNull())
    weak = F.filter(F.array(*(F.when(text.rlike(f"(?U){p}"), F.lit(label)) for label, p in X.WEAK_PRODUCT)), lambda x: x.isNotNull())
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    blocked = F.when(path.rlike(f"(?i){X.NOT_PRODUCT_PATH}"), F.array(F.lit(X.PATH_BLOCKER))).otherwise(F.array().cast("array<string>"))
    none, blockers = F.array().cast("array<string>"), listed(X.NOT_PRODUCT, page)
    empty = F.coalesce(page, F.lit("")) == ""
    all_blockers = F.concat(blockers, blocked)
    return (
        F.when(empty, F.struct(F.lit(False).alias("is_product"), none.alias("reasons"), F.array(F.lit(X.EMPTY_BLOCKER)).alias("blockers")))
        .when(strong, F.struct(F.lit(True).alias("is_product"), F.concat(F.array(F.lit(X.STRONG_REASON)), weak).alias("reasons"), none.alias("blockers")))
        .when((F.size(weak) >= 2) & (F.size(all_blockers) == 0), F.struct(F.lit(True).alias("is_product"), weak.alias("reasons"), none.alias("blockers")))
        .otherwise(F.struct(F.lit(False).alias("is_product"), weak.alias("reasons"), all_blockers.alias("blockers")))
    )


def main_text(page: Column) -> Column:
    """The largest article, else main, else body; first of equal ones."""
    body = without_scripts(page)

    def largest(tag: str) -> Column:
        blocks = F.regexp_extract_all(body, F.lit(f"(?is)<{tag}[^>]*>(.*?)</{tag}>"), 1)
        best = F.array_max(F.transform(blocks, lambda b, i: F.struct(F.length(b).alias("n"), (-i).alias("i"), b.alias("b"))))
        return F.when(F.size(blocks) > 0, best["b"])

    inside = some(F.regexp_extract(body, r"(?is)<body[^>]*>(.*?)</body>", 1))
    return strip_tags(F.coalesce(largest("article"), largest("main"), inside, body))


def content_metrics(page: Column) -> Column:
    """struct(word_count, h2_count, h3_count, has_table, has_list, image_count, published)."""
    body = without_scripts(page)
    count = lambda tag: F.size(F.regexp_extract_all(body, F.lit(rf"(?i)<({tag})[\s>]"), 1))
    found = [some(F.regexp_extract(page, f"(?i){p}", 1)) for p in X.PUBLISHED]
    return F.struct(
        F.size(F.filter(F.split(main_text(page), " "), lambda w: w != "")).alias("word_count"),
        count("h2").alias("h2_count"),
        count("h3").alias("h3_count"),
        (count("table") > 0).alias("has_table"),
        (count("ul|ol") > 0).alias("has_list"),
        count("img").alias("image_count"),
        F.coalesce(*(F.substring(f, 1, 32) for f in found), F.lit("")).alias("published"),
    )


def content_score(m: Column) -> Column:
    """0 to 10: length, headings, structure, images, date."""
    part = lambda x, most: F.least(x / most, F.lit(1.0))
    return F.round(
        part(m["word_count"], 1500.0) * 4.0 + part(m["h2_count"] + m["h3_count"], 8.0) * 2.5 + m["has_table"].cast("double") + m["has_list"].cast("double") + part(m["image_count"], 4.0) + F.when(m["published"] != "", 0.5).otherwise(0.0),
        2,
    )


def domain_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")))


def same_domain(url: Column, domain: Column) -> Column:
    host, domain = domain_of(url), F.lower(domain)
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))


class _Hrefs(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.found += [v for k, v in attrs if k == "href" and v]


def links_of(page: str | None, base: str | None) -> list[str]:
    parser = _Hrefs()
    parser.feed(page or "")
    out: dict[str, None] = {}
    for href in parser.found:
        if not href.startswith(("mailto:", "tel:", "javascript:", "#")):
            whole = urllib.parse.urldefrag(urllib.parse.urljoin(base or "", href))[0]
            out[whole.rstrip("/") or whole] = None
    return list(out)


@F.pandas_udf(ArrayType(StringType()))
def links(page: pd.Series, base: pd.Series) -> pd.Series:
    """Absolute links without fragments, distinct, in order."""
    return pd.Series([links_of(p, b) for p, b in zip(page, base, strict=True)])


@F.pandas_udf(ArrayType(StringType()))
def images(page: pd.Series, base: pd.Series) -> pd.Series:
    import re

    source = re.compile(r"""<img[^>]+src=["']([^"']+)["']""", re.I)
    return pd.Series([[urllib.parse.urljoin(b or "", s) for s in source.findall(p or "")] for p, b in zip(page, base, strict=True)])


def _codec(name: str | None) -> str | None:
    import codecs

    try:
        return codecs.lookup(name).name if name else None
    except LookupError:
        return None


def decoded(body: bytes | None, content_type: str | None) -> str:
    """Bytes as text: a byte order mark, else what header or meta tag declare, else the first that fits."""
    import re

    if not body:
        return ""
    if body[:3] == b"\xef\xbb\xbf":
        return body.decode("utf-8-sig", "replace")
    if body[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return body.decode("utf-16", "replace")
    header = re.search(r"charset\s*=\s*[\"']?([\w\-]+)", content_type or "", re.I)
    meta = re.search(rb"""<meta[^>]+charset\s*=\s*["']?\s*([\w\-]+)""", body[:4096], re.I)
    declared = _codec(header and header[1]) or _codec(meta and meta[1].decode("ascii", "ignore"))
    if declared:
        return body.decode(declared, "replace")
    for name in ("utf-8", "windows-1256", "cp1252"):
        try:
            return body.decode(name)
        except UnicodeDecodeError:
            pass
    return body.decode("utf-8", "replace")


@F.pandas_udf(StringType())
def decode_page(body: pd.Series, content_type: pd.Series) -> pd.Series:
    return pd.Series([decoded(b, c) for b, c in zip(body, content_type, strict=True)])
