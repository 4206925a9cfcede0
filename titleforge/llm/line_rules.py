"""Line-first cleaning, in DataFrame functions only.

Each line of a text is held against punctuation, navigation and boilerplate rules. Failing lines go; a
document that loses more than ``most_lost`` percent of its word characters goes too.

Defined results: a null or empty text, or one without words, has no lines to judge, zero counts and
``base_failed``. Repeated rows are judged one by one. Other columns of the input pass through unless a
result column has their name, which then wins. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titleforge.llm.common import table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: A line of prose has a word that closes with one of these, perhaps inside quotes or brackets.
TERMINAL = r"""[.!?:;,\u2026\u3002\uFF01\uFF1F]["'\u201D\u2019\u00BB)\]]*(\s|$)"""
#: A word that is a separator of a menu, or closes with a run of marks.
MENU = r"^(\||>|\u00BB|\u203A|\u00B7|\u2022|/|::)+$|\|$"
SHOUT = r"(!!+|\?\?+|##+|\*\*+|\$\$+|%%+|&&+)$"
#: Fixed phrases of page furniture, held against lower-cased lines.
BOILERPLATE = (
    "all rights reserved",
    "licensed under the",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "use of cookies",
    "javascript is disabled",
    "javascript is required",
    "enable javascript",
    "lorem ipsum",
    "subscribe to our newsletter",
    "click here to",
    "sign up for",
    "powered by",
)
#: Without one of these in the text, no word of it matches MENU or SHOUT.
MENU_SIGN, SHOUT_SIGN = r"[|>/\u00BB\u203A\u00B7\u2022]|::", r"!!|\?\?|##|\*\*|\$\$|%%|&&"


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def base_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", tokens(whole)).withColumn("_lines", F.filter(F.split(whole, "\n"), lambda s: F.length(F.translate(s, " \t\n\x0b\x0c\r", "")) > 0))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    words = F.col("_words")
    n = F.col("n_words").cast("int")
    at = lambda i, k: F.get(words, i + (k - 1))
    # hashes find the documents that may repeat a window; exact strings then decide
    keys = F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(*(at(i, k) for k in range(5)))))
    out = out.withColumn("_keys", keys).withColumn("_again", F.coalesce(F.size(F.array_distinct("_keys")) < F.size("_keys"), F.lit(False)))
    joined = lambda i: F.concat_ws(" ", *(at(i, k) for k in range(5)))
    pairs = F.when(F.col("_again"), F.array_sort(F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.struct(joined(i).alias("w"), i.alias("i")))))
    out = out.withColumn("_pairs", pairs).drop("_keys", "_again")
    p = F.col("_pairs")
    seen = F.transform(p, lambda x, j: F.when((F.get(p, j - 1)["w"] == x["w"]) | (F.get(p, j + 1)["w"] == x["w"]), x["i"]))
    out = out.withColumn("_at", F.array_sort(F.filter(seen, lambda x: x.isNotNull()))).drop("_pairs")
    spots = F.col("_at")
    covered = F.aggregate(F.transform(spots, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(spots, j + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    out = (
        out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    )
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).drop("_at")


def _furniture(lowered: Column) -> Column:
    return reduce(or_, (lowered.contains(p) for p in BOILERPLATE))


def line_verdict(line: Column, furniture: Column, menus: Column, shouts: Column) -> Column:
    """``punctuation``, ``navigation``, ``boilerplate`` or null for a line that stays.

    The other arguments tell whether the whole text has any sign of the rule, so most texts skip its tests.
    """
    w = tokens(line)
    n = F.size(w)
    menu, shout = F.size(F.filter(w, lambda x: x.rlike(MENU))), F.size(F.filter(w, lambda x: x.rlike(SHOUT)))
    return (
        F.when(furniture & _furniture(F.lower(line)), "boilerplate")
        .when(menus & (10 * menu >= 3 * n), "navigation")
        .when((shouts & (10 * shout >= 3 * n)) | (~line.rlike(TERMINAL) & (n >= 3)), "punctuation")
    )


def clean_lines(docs: DataFrame, text: str = "text", most_lost: int = 50) -> DataFrame:
    """Base metrics, lines dropped by rule, the cleaned text, and ``kept``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    # one array, read three times below: a column read once would be moved into the loop over lines
    signs = F.array(_furniture(F.lower(whole)), whole.rlike(MENU_SIGN), whole.rlike(SHOUT_SIGN))
    out = base_metrics(docs, text).withColumn("_signs", signs)
    size = lambda s: F.length(F.translate(s, " \t\n\x0b\x0c\r", ""))
    judged = F.transform("_lines", lambda s: F.struct(s.alias("line"), size(s).alias("chars"), line_verdict(s, *(F.get("_signs", F.lit(k)) for k in range(3))).alias("rule")))
    out = out.withColumn("_judged", judged)
    j = F.col("_judged")
    lost = F.aggregate(F.filter(j, lambda x: x["rule"].isNotNull()), F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    n_rule = lambda name: F.size(F.filter(j, lambda x: x["rule"] == name)).cast("long")
    return (
        out.withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumns({f"n_{name}": n_rule(name) for name in ("punctuation", "navigation", "boilerplate")})
        .withColumn("lost_chars", lost)
        .withColumn("clean_text", F.array_join(F.transform(F.filter(j, lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n"))
        .withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= most_lost * F.col("word_chars")))
        .drop("_words", "_lines", "_judged", "_signs")
    )


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_punctuation", "n_navigation", "n_boilerplate", "lost_chars", "kept"]


def op3_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean_lines(docs).select(*COLUMNS, F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))


def _quoted(pattern: str) -> str:
    """A Java pattern as an RE2 literal."""
    import re

    return "'" + re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", pattern).replace("'", "''") + "'"


OP3_SQL = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, list_filter(string_split_regex(t, {_quoted(SPACE)}), lambda x: x <> '') as ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from d),
win as (select doc_id, i, array_to_string(ws[i:i+4], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
dup as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1),
cov as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from dup) group by doc_id),
lines as (select doc_id, k, ls[k] as line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as k from w)),
parts as (select *, list_filter(string_split_regex(line, {_quoted(SPACE)}), lambda x: x <> '') as lw from lines),
rated as (select doc_id, k, line, length(array_to_string(lw, '')) as chars,
  case when regexp_matches(lower(line), {_quoted('|'.join(BOILERPLATE))}) then 'boilerplate'
       when 10 * len(list_filter(lw, lambda x: regexp_matches(x, {_quoted(MENU)}))) >= 3 * len(lw) then 'navigation'
       when 10 * len(list_filter(lw, lambda x: regexp_matches(x, {_quoted(SHOUT)}))) >= 3 * len(lw)
         or (not regexp_matches(line, {_quoted(TERMINAL)}) and len(lw) >= 3) then 'punctuation' end as rule from parts),
agg as (select doc_id, count(*) filter (where rule = 'punctuation') as np, count(*) filter (where rule = 'navigation') as nn,
  count(*) filter (where rule = 'boilerplate') as nb, coalesce(sum(chars) filter (where rule is not null), 0) as lost,
  coalesce(string_agg(line, chr(10) order by k) filter (where rule is null), '') as clean from rated group by doc_id),
m as (select w.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
  length(t) - length(translate(t, '{SYMBOLS}', '')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
  coalesce(cov.n, 0) as n_repeat_words, len(ls) as n_lines, coalesce(np, 0) as np, coalesce(nn, 0) as nn, coalesce(nb, 0) as nb,
  coalesce(lost, 0) as lost, coalesce(clean, '') as clean from w left join cov using (doc_id) left join agg using (doc_id))
select doc_id, n_words::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed, n_lines::bigint as n_lines,
  np::bigint as n_punctuation, nn::bigint as n_navigation, nb::bigint as n_boilerplate, lost::bigint as lost_chars,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * lost <= 50 * word_chars as kept, sha256(clean) as clean_sha256 from m
"""
