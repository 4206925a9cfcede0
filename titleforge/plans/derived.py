"""State tables derived from the landed tables, so that every operator runs over whole tables; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleforge.functions import fixed as X
from titleforge.functions import html as H
from titleforge.functions import text as T
from titleforge.functions import vectors as V
from titleforge.functions.text import Rules

RULES = Rules()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, domain, title)."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", "url", H.domain_of(F.col("url")).alias("domain"), H.title_candidate(F.col("html")).alias("title"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, title, display, tokens): page titles and their meaningful words."""
    p = pages(spark, sf_dir).select(F.col("page_id").alias("idx"), "title").withColumn("display", T.display(F.col("title"), RULES, False))
    return p.withColumn("tokens", T.meaningful(T.tokens_of(F.col("display"), RULES), RULES))


def state(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    p = pages(spark, sf_dir)
    score = (F.col("page_id") * 37 % 100) / 100.0
    raw = p.select(
        F.col("page_id").alias("id"), F.concat(F.lit("run"), (F.col("page_id") % 2).cast("string")).alias("run_id"), F.col("domain").alias("source_domain"), F.col("url").alias("source_url"),
        F.col("title").alias("raw_title"), T.normalize(F.col("title"), RULES, False).alias("normalized_title"), score.alias("topic_score"),
        V.relevance(score, F.lit(0.6), F.lit(0.3)).alias("is_relevant"), F.get(F.array(*map(F.lit, ("", "a", "b", "c"))), (F.col("page_id") % 4).cast("int")).alias("category"),
    )
    kept = raw.where("is_relevant")
    ids = kept.groupBy("run_id", "normalized_title").agg(F.min("id").alias("id"), F.min("raw_title").alias("canonical_title"), F.count("*").alias("n"))
    canonical = ids.select(
        "id", "run_id", "canonical_title", F.array().cast("array<string>").alias("entity_tokens"), F.round(1.0 / F.col("n"), 3).alias("merge_confidence"), (F.col("id") % 5 == 0).alias("needs_review"),
        F.when(F.col("id") % 3 == 0, "has_suggest").when(F.col("id") % 3 == 1, "no_suggest").alias("suggest_status"),
    )
    mapping = kept.select(F.col("id").alias("raw_id"), "run_id", "normalized_title").join(ids.select("run_id", "normalized_title", F.col("id").alias("canonical_id")), ["run_id", "normalized_title"]).select("raw_id", "canonical_id")
    words = F.array_distinct(F.filter(F.split(F.lower("canonical_title"), " "), lambda w: w != ""))
    keywords = canonical.where("suggest_status = 'has_suggest'").select(F.col("id").alias("canonical_id"), F.posexplode(words).alias("p", "keyword"), F.col("canonical_title").alias("source_query"))
    keywords = keywords.select("canonical_id", "keyword", (F.col("p") + 1).alias("position"), "source_query")
    return {"raw": raw, "canonical": canonical, "mapping": mapping, "keywords": keywords}


# --- the same in SQL ---


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def title_sql(html: str = "html") -> str:
    bare = f"regexp_replace(regexp_extract({html}, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g')"
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        bare = f"replace({bare}, {q(entity)}, {q(char)})"
    return f"trim(regexp_replace({bare}, '\\s+', ' ', 'g'))"


def display_sql(text: str) -> str:
    letters = f"translate(nfc_normalize(coalesce({text}, '')), {q(''.join(X.LETTERS))}, {q(''.join(X.LETTERS.values()))})"
    digits = f"lower(translate({letters}, {q(X.EN_DIGITS + X.AR_DIGITS)}, {q(X.FA_DIGITS * 2)}))"
    return f"trim(regexp_replace(regexp_replace({digits}, {q(f'[^{X.KEPT}]')}, ' ', 'g'), '[ \\t\\n]+', ' ', 'g'))"


def tokens_sql(text: str) -> str:
    return f"list_filter(string_split({display_sql(text)}, ' '), lambda w: w <> '')"


def meaningful_sql(text: str) -> str:
    stops = "[" + ", ".join(q(w) for w in RULES.stopwords) + "]"
    return f"list_filter({tokens_sql(text)}, lambda w: not list_contains({stops}, w) and not regexp_matches(translate(w, {q(X.FA_DIGITS)}, {q(X.EN_DIGITS)}), {q(X.YEAR)}))"


DOMAIN_SQL = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1))"
PAGES_SQL = f"p as (select page_id, url, {DOMAIN_SQL} as domain, {title_sql()} as title from pages)"
FEATURES_SQL = f"{PAGES_SQL}, f as (select page_id as idx, title, {display_sql('title')} as display, {meaningful_sql('title')} as tokens from p)"
SPREAD_SQL = f"{FEATURES_SQL}, s as (select distinct idx, unnest(tokens) as token from f), df as (select token, count(*) as df from s group by token)"
RARE_SQL = f"{SPREAD_SQL}, rare as (select idx, token from (select idx, s.token, row_number() over (partition by idx order by df, s.token desc) as r from s join df using (token)) where r <= 3)"
PAIRS_SQL = f"{RARE_SQL}, big as (select token from rare group by token having count(*) between 2 and 400), pairs as (select distinct x.idx as a, y.idx as b from rare x join rare y on x.token = y.token and x.idx < y.idx join big on big.token = x.token)"
JACCARD_SQL = f"""{PAIRS_SQL}, jac as (select a, b, round(len(list_intersect(list_distinct(x.tokens), list_distinct(y.tokens)))::double / len(list_distinct(list_concat(x.tokens, y.tokens))), 6) as jaccard
  from pairs join f x on x.idx = a join f y on y.idx = b)"""
STATE_SQL = f"""{PAGES_SQL},
raw as (select page_id as id, 'run' || (page_id % 2) as run_id, domain as source_domain, url as source_url, title as raw_title, array_to_string({meaningful_sql('title')}, ' ') as normalized_title,
  (page_id * 37 % 100) / 100.0 as topic_score, case when (page_id * 37 % 100) >= 60 then true when (page_id * 37 % 100) >= 30 then null else false end as is_relevant, ['', 'a', 'b', 'c'][page_id % 4 + 1] as category from p),
kept as (select * from raw where is_relevant),
ids as (select run_id, normalized_title, min(id) as id, min(raw_title) as canonical_title, count(*) as n from kept group by all),
canonical as (select id, run_id, canonical_title, round(1.0::double / n, 3) as merge_confidence, id % 5 = 0 as needs_review, case id % 3 when 0 then 'has_suggest' when 1 then 'no_suggest' end as suggest_status from ids),
mapping as (select kept.id as raw_id, ids.id as canonical_id from kept join ids using (run_id, normalized_title)),
kw0 as (select id as canonical_id, canonical_title as source_query, list_filter(string_split(lower(canonical_title), ' '), lambda w: w <> '') as ws from canonical where suggest_status = 'has_suggest'),
kw1 as (select canonical_id, source_query, ws[i] as keyword, i from (select *, unnest(range(1, len(ws) + 1)) as i from kw0)),
keywords as (select canonical_id, keyword, row_number() over (partition by canonical_id order by min(i))::int as position, min(source_query) as source_query from kw1 group by canonical_id, keyword)"""
WIDE_SQL = f"""{STATE_SQL},
cat as (select canonical_id as id, category from (select canonical_id, category, row_number() over (partition by canonical_id order by count(*) desc, category) as r from mapping join raw on raw.id = raw_id where category <> '' group by canonical_id, category) where r = 1),
mem as (select canonical_id as id, string_agg(source_url, ' | ' order by raw_id) as urls, count(*) as n_urls from mapping join raw on raw.id = raw_id group by canonical_id),
dom as (select id, string_agg(source_domain, ' | ' order by first) as domains from (select canonical_id as id, source_domain, min(raw_id) as first from mapping join raw on raw.id = raw_id where source_domain <> '' group by all) group by id),
kws as (select canonical_id as id, list(keyword order by position) as ks from keywords group by canonical_id),
wide as (select c.*, coalesce(category, '') as category, coalesce(urls, '') as source_urls, coalesce(n_urls, 0) as merge_count, coalesce(domains, '') as source_domains, coalesce(ks, []) as ks, round(merge_confidence, 3) as confidence
  from canonical c left join cat using (id) left join mem using (id) left join dom using (id) left join kws using (id))"""
