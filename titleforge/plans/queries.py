"""The library's queries over the provided tables, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from titleforge.functions import fixed as X
from titleforge.functions import html as H
from titleforge.functions import similarity as S
from titleforge.functions import text as T
from titleforge.functions import vectors as V
from titleforge.operators import enrich, graph, reports, resolve
from titleforge.operators import state as st
from titleforge.plans.derived import (
    DOMAIN_SQL,
    FEATURES_SQL,
    JACCARD_SQL,
    PAGES_SQL,
    PAIRS_SQL,
    RARE_SQL,
    RULES,
    SPREAD_SQL,
    STATE_SQL,
    WIDE_SQL,
    display_sql,
    features,
    meaningful_sql,
    pages,
    q,
    state,
    table,
    title_sql,
    tokens_sql,
)
from titleforge.plans.run import topics
from titleforge.sources import landing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- text ---


@query(f"with {PAGES_SQL} select page_id, domain, title from p")
def page_titles(spark, sf):
    return pages(spark, sf).select("page_id", "domain", "title")


@query(f"select page_id, {display_sql(title_sql())} as display, array_to_string({meaningful_sql(title_sql())}, ' ') as normalized from pages")
def normalize_titles(spark, sf):
    p = table(spark, sf, "pages").withColumn("t", H.title_candidate(F.col("html")))
    return p.select("page_id", T.display(F.col("t"), RULES).alias("display"), T.normalize(F.col("t"), RULES).alias("normalized"))


@query(f"select doc_id, md5(translate(text, {q(X.EN_DIGITS + X.AR_DIGITS)}, {q(X.FA_DIGITS * 2)})) as fa, md5(translate(text, {q(X.FA_DIGITS + X.AR_DIGITS)}, {q(X.EN_DIGITS * 2)})) as en from documents")
def map_digits(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", *(F.md5(T.map_digits(F.col("text"), to).cast("binary")).alias(to) for to in ("fa", "en")))


@query(f"select token, count(*)::bigint as n from (select unnest({tokens_sql('text')}) as token from documents) group by token")
def token_counts(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.explode(T.tokenize(F.col("text"), RULES, False)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def _variants_sql() -> str:
    shown = f"(select p_partkey, {display_sql('p_name')} as d from part)"
    words = f"(select p_partkey, d, list_filter(string_split(d, ' '), lambda w: len({meaningful_sql('w')}) > 0) as ws from {shown})"
    kept = f"(select p_partkey, d, list_filter(ws, lambda w, i: list_position(ws, w) = i)[1:8] as ws from {words})"
    return f"select p_partkey, case when len(ws) > 0 then array_to_string(ws, ' ') else d end as query from {kept}"


@query(_variants_sql())
def search_queries(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.search_query(F.col("p_name"), RULES, compose=False, collapse=False).alias("query"))


@query(f"""with b as ({_variants_sql()}), w as (select p_partkey, query, string_split(query, ' ') as ws from b),
v as (select p_partkey, 0 as k, query as v from w union all
  select p_partkey, 2 * (len(ws) - n) - 1, array_to_string(ws[1:n], ' ') from (select *, unnest(range(3, len(ws))) as n from w) union all
  select p_partkey, 2 * i, prefix || ' ' || array_to_string(ws[1:4], ' ') from w, (values (1, {q(X.QUERY_PREFIXES[0])}), (2, {q(X.QUERY_PREFIXES[1])})) t(i, prefix)),
d as (select p_partkey, v, min(k) as k from v where v <> '' group by p_partkey, v)
select p_partkey, string_agg(v, ' | ' order by k) as variants from d group by p_partkey""")
def search_variants(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.search_variants(F.col("p_name"), RULES, compose=False, collapse=False), " | ").alias("variants"))


@query(f"""with m as (select conv_id, turn, role, list_distinct({meaningful_sql('text')}) as ws from conversations)
select a.conv_id, a.turn, round(case when len(u.ws) = 0 then 1.0 else len(list_intersect(u.ws, a.ws))::double / len(u.ws) end, 6) as coverage
from m a join m u on u.conv_id = a.conv_id and u.turn = a.turn - 1 where a.role = 'assistant' and u.role = 'user'""")
def keyword_coverage(spark, sf):
    m = table(spark, sf, "conversations").select("conv_id", "turn", "role", T.meaningful_tokens(F.col("text"), RULES, False).alias("ws"))
    u = m.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("ws").alias("wanted"))
    return m.where("role = 'assistant'").join(u, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.coverage(F.col("ws"), F.col("wanted")), 6).alias("coverage"))


# --- pages ---


@query(f"""with h as (select page_id, url, regexp_extract(url, '^[a-zA-Z]+://[^/]+', 0) as origin, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) as href from pages),
a as (select page_id, regexp_replace(case when href like '/%' then origin || href else href end, '#.*$', '') as u from h where not regexp_matches(href, '^(mailto:|tel:|javascript:|#)'))
select distinct page_id, case when rtrim(u, '/') = '' then u else rtrim(u, '/') end as link from a""")
def page_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(H.links(F.col("html"), F.col("url"))).alias("link"))


@query(f"""select page_id, {DOMAIN_SQL} as domain, regexp_matches(url, '\\?[^#]') or trim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/') <> '' as listing,
  {DOMAIN_SQL} = 'example.com' or ends_with({DOMAIN_SQL}, '.example.com') as inside from pages""")
def listing_seeds(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", H.domain_of(u).alias("domain"), landing.is_listing(u).alias("listing"), H.same_domain(u, F.lit("example.com")).alias("inside"))


@query(f"""with u as (select page_id, regexp_replace(url, '#.*$', '') as url from pages),
k as (select page_id, url, row_number() over (partition by url order by page_id) as r from u where not regexp_matches(url, 'page=[2-9]') and regexp_matches(url, '/') and ({DOMAIN_SQL} = 'example.com' or ends_with({DOMAIN_SQL}, '.example.com')))
select page_id, url from k where r = 1""")
def url_filter(spark, sf):
    urls = table(spark, sf, "pages").select("page_id", "url")
    return landing.filter_urls(urls, "example.com", include=("/",), exclude=("page=[2-9]",), pos="page_id")


@query(f"""with s as (select page_id, html, regexp_matches(html, {q('(?i)' + X.NOT_PRODUCT[0][1])}) as article, regexp_matches(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), {q('(?i)' + X.NOT_PRODUCT_PATH)}) as path,
  {' or '.join(f"regexp_matches(html, {q('(?i)' + p)})" for p in X.STRONG_PRODUCT)} as strong from pages)
select page_id, strong as is_product, case when strong then {q(X.STRONG_REASON)} else '' end as reasons,
  case when strong then '' else array_to_string(list_filter([case when article then {q(X.NOT_PRODUCT[0][0])} end, case when path then {q(X.PATH_BLOCKER)} end], lambda x: x is not null), ' | ') end as blockers from s""")
def product_signals(spark, sf):
    s = table(spark, sf, "pages").select("page_id", H.product_signals(F.col("html"), F.col("url")).alias("s"))
    return s.select("page_id", "s.is_product", F.array_join("s.reasons", " | ").alias("reasons"), F.array_join("s.blockers", " | ").alias("blockers"))


def _strip_sql(fragment: str) -> str:
    bare = f"regexp_replace({fragment}, '<[^>]+>', ' ', 'g')"
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        bare = f"replace({bare}, {q(entity)}, {q(char)})"
    return f"trim(regexp_replace({bare}, '\\s+', ' ', 'g'))"


@query(f"""with b as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', ' ', 'g') as body from pages),
a as (select page_id, body, list_sort(list_transform(regexp_extract_all(body, '(?is)<article[^>]*>(.*?)</article>', 1), lambda x, i: {{'n': -length(x), 'i': i, 'x': x}}))[1].x as art from b),
m as (select page_id, len(list_filter(string_split({_strip_sql('art')}, ' '), lambda w: w <> '')) as word_count, len(regexp_extract_all(body, '(?i)<h2[\\s>]')) as h2_count, len(regexp_extract_all(body, '(?i)<h3[\\s>]')) as h3_count,
  regexp_matches(body, '(?i)<table[\\s>]') as has_table, regexp_matches(body, '(?i)<(ul|ol)[\\s>]') as has_list, len(regexp_extract_all(body, '(?i)<img[\\s>]')) as image_count from a)
select page_id, word_count::int as word_count, h2_count::int as h2_count, h3_count::int as h3_count, has_table, has_list, image_count::int as image_count,
  round(least(word_count / 1500.0::double, 1) * 4.0 + least((h2_count + h3_count) / 8.0::double, 1) * 2.5 + has_table::int + has_list::int + least(image_count / 4.0::double, 1), 2) as score from m""")
def content_metrics(spark, sf):
    m = table(spark, sf, "pages").select("page_id", H.content_metrics(F.col("html")).alias("m"))
    return m.select("page_id", "m.*", H.content_score(F.col("m")).alias("score")).drop("published")


@query()
def collapsed_titles(spark, sf):
    return H.with_title(table(spark, sf, "pages"), F.col("html"), H.domain_of(F.col("url"))).select("page_id", "title")


# --- blocking and similarity ---


@query(f"with {SPREAD_SQL} select token, df::bigint as df from df")
def document_frequency(spark, sf):
    return resolve.document_frequency(features(spark, sf))


@query(f"with {RARE_SQL} select idx, token from rare")
def rare_tokens(spark, sf):
    return resolve.rare_tokens(features(spark, sf))


@query(f"with {PAIRS_SQL} select a, b from pairs")
def candidate_pairs(spark, sf):
    return resolve.candidate_pairs(features(spark, sf))


def _both(spark, sf) -> DataFrame:
    f = features(spark, sf)
    return resolve.with_features(resolve.candidate_pairs(f), f, ["tokens"])


@query(f"with {JACCARD_SQL} select a, b, jaccard from jac where jaccard >= 0.5")
def title_pairs(spark, sf):
    score = F.round(S.jaccard(F.col("tokens_a"), F.col("tokens_b")), 6)
    return _both(spark, sf).select("a", "b", score.alias("jaccard")).where("jaccard >= 0.5")


@query(f"""with {PAIRS_SQL} select a, b, round(2.0::double * len(list_intersect(list_distinct(x.tokens), list_distinct(y.tokens))) / (len(list_distinct(x.tokens)) + len(list_distinct(y.tokens))), 6) as dice
from pairs join f x on x.idx = a join f y on y.idx = b""")
def dice_pairs(spark, sf):
    return _both(spark, sf).select("a", "b", F.round(S.dice(F.col("tokens_a"), F.col("tokens_b")), 6).alias("dice"))


@query()
def similar_titles(spark, sf):
    f = features(spark, sf).withColumn("normalized", F.array_join("tokens", " "))
    both = resolve.with_features(resolve.candidate_pairs(f), f, ["normalized"])
    return both.select("a", "b", S.ratio(F.col("normalized_a"), F.col("normalized_b")).alias("ratio"), S.title_similarity(F.col("normalized_a"), F.col("normalized_b")).alias("score"))


@query(f"""with recursive {JACCARD_SQL}, e as (select a, b from jac where jaccard >= 0.5 union all select b, a from jac where jaccard >= 0.5),
r as (select a as node, a as label from e union select e.b, r.label from r join e on e.a = r.node)
select node, min(label) as component from r group by node""")
def title_components(spark, sf):
    return graph.components(title_pairs(spark, sf).select(F.col("a").alias("u"), F.col("b").alias("v")))


def _raw_titles(spark, sf) -> DataFrame:
    return pages(spark, sf).select(F.col("page_id").alias("raw_id"), F.col("title").alias("raw_title"))


@query()
def pair_verdicts(spark, sf):
    f = graph.cut(resolve.candidates(_raw_titles(spark, sf), RULES))
    return resolve.decisions(f, resolve.candidate_pairs(f)).select("a", "b", "score", "verdict", "confidence", "reason", "forbids")


@query()
def title_clusters(spark, sf):
    return resolve.resolve(_raw_titles(spark, sf), RULES)[1]


@query()
def canonical_records(spark, sf):
    return resolve.resolve(_raw_titles(spark, sf), RULES)[0]


@query(f"""with {FEATURES_SQL}, v as (select *, array_to_string(tokens, ' ') as normalized from f)
select normalized, count(*)::bigint as votes, max(len(tokens))::bigint as n, arg_max(display, (len(tokens), -length(display), display)) as title from v group by normalized""")
def canonical_titles(spark, sf):
    f = features(spark, sf).withColumn("normalized", F.array_join("tokens", " "))
    best = F.max_by("display", F.struct(F.size("tokens"), -F.length("display"), "display"))
    return f.groupBy("normalized").agg(F.count("*").alias("votes"), F.max(F.size("tokens")).cast("long").alias("n"), best.alias("title"))


# --- topics ---

_CENTROIDS = """x as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings),
s as (select label, pos, sum(x) as x from x group by label, pos), n as (select label, sqrt(sum(x * x)) as n from s group by label), c as (select label, pos, case when n > 0 then x / n else x end as x from s join n using (label))"""
_COS = f"""{_CENTROIDS}, l as (select vec_id, sqrt(sum(x * x)) as n from x group by vec_id),
cs as (select x.vec_id, x.label as own, c.label, round(least(greatest(sum(x.x * c.x) / max(l.n), 0), 1), 6) as score from x join c using (pos) join l using (vec_id) group by all)"""


def _vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _scored(spark, sf) -> DataFrame:
    """Every vector against every label's centroid; labels are few and their number is the check of the broadcast."""
    v = _vectors(spark, sf)
    c = V.centroids(v, "label", "v").select(F.col("label").alias("topic"), "centroid")
    c = F.broadcast(c) if v.select("label").distinct().count() <= 10_000 else c
    return v.join(c).select("vec_id", F.col("label").alias("own"), F.col("topic").alias("label"), F.round(V.cosine(F.col("v"), F.col("centroid")), 6).alias("score"))


@query(f"with {_CENTROIDS} select label, pos::int as pos, round(x, 6) as x from c")
def topic_centroids(spark, sf):
    c = V.centroids(_vectors(spark, sf), "label", "v")
    return c.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


@query(f"with {_COS} select vec_id, label, score from (select *, row_number() over (partition by vec_id order by score desc, label) as r from cs) where r = 1")
def best_topics(spark, sf):
    return V.best_label(_scored(spark, sf), ["vec_id"], "label", "score", "label")


_THRESHOLDS = f"""{_COS}, g as (select label, list(score order by score) filter (where own = label) as pos, list(score order by score) filter (where own <> label) as neg from cs group by label),
t as (select label, pos[round_even(0.15 * (len(pos) - 1), 0)::int + 1] as low, neg[round_even(0.9 * (len(neg) - 1), 0)::int + 1] as high from g),
th as (select label, round(least(0.95, greatest(0.05, high + 0.5 * (low - high))), 4) as relevant, round(least(0.95, greatest(0.03, high + 0.25 * (low - high))), 4) as review from t where low > high)"""


def _thresholds(spark, sf) -> DataFrame:
    s = _scored(spark, sf)
    own = F.col("own") == F.col("label")
    g = s.groupBy("label").agg(F.collect_list(F.when(own, F.col("score"))).alias("pos"), F.collect_list(F.when(~own, F.col("score"))).alias("neg"))
    return g.select("label", V.calibrated(F.col("pos"), F.col("neg")).alias("t")).where("t is not null").select("label", "t.*")


@query(f"with {_THRESHOLDS} select label, relevant, review from th")
def topic_thresholds(spark, sf):
    return _thresholds(spark, sf)


@query(f"""with {_THRESHOLDS}, b as (select vec_id, label, score from (select *, row_number() over (partition by vec_id order by score desc, label) as r from cs) where r = 1),
j as (select b.*, coalesce(relevant, 0.3) as relevant, coalesce(review, 0.2) as review from b left join th using (label))
select vec_id, label, case when score >= relevant then true when score >= review then null else false end as is_relevant from j""")
def topic_relevance(spark, sf):
    b = best_topics(spark, sf).join(F.broadcast(_thresholds(spark, sf)), "label", "left")
    return b.select("vec_id", "label", V.relevance(F.col("score"), F.coalesce("relevant", F.lit(0.3)), F.coalesce("review", F.lit(0.2))).alias("is_relevant"))


@query()
def hashed_topics(spark, sf):
    """Page titles against the built-in categories, by hashed features."""
    references = spark.createDataFrame([(i, label, v) for i, (label, v, _, _) in enumerate(topics(list(X.CATEGORIES)))], "ord int, label string, centroid array<double>")
    f = graph.cut(graph.cut(features(spark, sf).select("idx", F.array_join("tokens", " ").alias("t"))).select("idx", V.hashing_encoder(F.col("t")).alias("v")))
    s = f.join(F.broadcast(references)).select("idx", "ord", "label", F.round(V.cosine(F.col("v"), F.col("centroid")), 4).alias("score"))
    return V.best_label(s, ["idx"], "label", "score", "ord")


# --- state, enrichment, reports ---


@query("select source, lang from (select source, lang, row_number() over (partition by source order by count(*) desc, lang) as r from documents where lang <> '' group by source, lang) where r = 1")
def category_mode(spark, sf):
    return table(spark, sf, "documents").where("lang <> ''").groupBy("source").agg(F.mode("lang", True).alias("lang"))


@query(f"""with {STATE_SQL} select (select count(*) from raw)::bigint as raw, (select count(*) from raw where is_relevant)::bigint as relevant, (select count(*) from raw where is_relevant is null)::bigint as borderline,
  (select count(*) from canonical)::bigint as canonical, (select count(*) from canonical where needs_review)::bigint as needs_review, (select count(*) from canonical where suggest_status = 'has_suggest')::bigint as has_suggest,
  (select count(*) from canonical where suggest_status = 'no_suggest')::bigint as no_suggest, (select count(*) from canonical where suggest_status is null)::bigint as pending, (select count(*) from keywords)::bigint as keywords""")
def run_counters(spark, sf):
    s = state(spark, sf)
    return reports.counters(s["raw"], s["canonical"], s["keywords"])


@query(f"with {STATE_SQL} select id, canonical_title, needs_review from canonical where lower(canonical_title) like '%on%' order by needs_review desc, id limit 20 offset 5")
def browse_page(spark, sf):
    s = state(spark, sf)
    return reports.browse(s["canonical"], s["mapping"], "all", "ON", 20, 5).select("id", "canonical_title", "needs_review")


@query(f"with {STATE_SQL} select canonical_id as id from mapping group by canonical_id having count(*) > 1")
def merged_products(spark, sf):
    return reports.merged_products(state(spark, sf)["mapping"])


def _wide(spark, sf) -> DataFrame:
    s = state(spark, sf)
    return reports.wide(s["canonical"], s["mapping"], s["raw"], s["keywords"])


_CELLS = ", ".join(f"coalesce(ks[{i}], '') as suggest_{i}" for i in range(1, 4))
_TAIL = "category, source_domains, source_urls, merge_count::bigint as merge_count, confidence"


@query(f"with {WIDE_SQL} select canonical_title, array_to_string(ks, ' | ') as lsi_keywords, len(ks)::bigint as lsi_count, {_TAIL}, {_CELLS} from wide where suggest_status = 'has_suggest'")
def report_ready(spark, sf):
    return reports.ready(_wide(spark, sf), 3)


@query(f"with {WIDE_SQL} select canonical_title, len(ks)::bigint as lsi_count, {_TAIL} from wide where coalesce(suggest_status, '') <> 'has_suggest'")
def report_archive(spark, sf):
    return reports.archive(_wide(spark, sf))


@query(f"""with {WIDE_SQL} select canonical_title, case suggest_status when 'has_suggest' then {q(X.SUGGEST_LABELS['has_suggest'])} when 'no_suggest' then {q(X.SUGGEST_LABELS['no_suggest'])} else {q(X.SUGGEST_LABELS[''])} end as suggest,
  array_to_string(ks, ' | ') as lsi_keywords, len(ks)::bigint as lsi_count, {_TAIL}, {_CELLS} from wide""")
def report_all(spark, sf):
    return reports.everything(_wide(spark, sf), 3)


@query(f"""with {WIDE_SQL} select {q(X.REVIEW_MERGE[0])} as type, canonical_title as title, {q(X.REVIEW_MERGE[1])} as reason, confidence as score, source_urls from wide where needs_review
union all select {q(X.REVIEW_TOPIC[0])}, raw_title, {q(X.REVIEW_TOPIC[1])}, round(topic_score::double, 3), source_url from raw where is_relevant is null""")
def report_review(spark, sf):
    return reports.review(_wide(spark, sf), state(spark, sf)["raw"])


@query(f"with {STATE_SQL} select id, raw_title, round(topic_score::double, 4) as topic_score, source_url from raw where is_relevant is null")
def borderline_rows(spark, sf):
    raw = state(spark, sf)["raw"]
    return reports.borderline(raw).orderBy(F.col("topic_score").desc()).select("id", "raw_title", F.round("topic_score", 4).alias("topic_score"), "source_url")


@query(f"""with {STATE_SQL}, k as (select canonical_id, keyword from keywords where position % 2 = 0), n as (select canonical_id as id, count(*) as n from k group by canonical_id)
select id, case when suggest_status is null then null when coalesce(n, 0) > 0 then 'has_suggest' else 'no_suggest' end as suggest_status from canonical left join n using (id)""")
def status_refresh(spark, sf):
    s = state(spark, sf)
    return st.refreshed(s["canonical"], s["keywords"].where("position % 2 = 0")).select("id", "suggest_status")


@query(f"""with {STATE_SQL}, c as (select k.*, len(list_intersect([k.keyword], list_distinct(string_split(lower(canonical_title), ' '))))::double / len(list_distinct(list_concat([k.keyword], string_split(lower(canonical_title), ' ')))) as score, count(*) over (partition by keyword) as n from keywords k join canonical on id = canonical_id)
select canonical_id, keyword, position from (select *, row_number() over (partition by keyword order by round(score, 6) desc, position, canonical_id) as r from c) where r = 1""")
def keyword_owners(spark, sf):
    s = state(spark, sf)
    score = F.round(S.jaccard(F.array("keyword"), F.split(F.lower("canonical_title"), " ")), 6)
    return enrich.owners(s["keywords"], s["canonical"], RULES, score).select("canonical_id", "keyword", "position")


@query("""with e as (select event_id, user_id, event_type, value from events), old as (select * from (select *, row_number() over (partition by user_id, event_type order by event_id) as r from e where event_id % 2 = 0) where r = 1),
fresh as (select * from (select *, row_number() over (partition by user_id, event_type order by event_id) as r from e where event_id % 2 = 1) where r = 1)
select event_id, user_id, event_type, value from old union all select event_id, user_id, event_type, value from fresh f where not exists (select 1 from old where old.user_id = f.user_id and old.event_type = f.event_type)""")
def upsert_keep_first(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    keys = ["user_id", "event_type"]
    return st.insert_or_ignore(st.keep_first(e.where("event_id % 2 = 0"), keys, "event_id"), e.where("event_id % 2 = 1"), keys, "event_id")


@query("select event_id, user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by event_id % 2 desc, event_id desc) as r from events) where r = 1")
def upsert_keep_last(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return st.insert_or_replace(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


@query("""with m as (select max(ts) as now from events), c as (select event_id, ts >= now - interval 5 day and props is not null and trim(props) <> 'null' as good, props from events, m)
select event_id, case when good then md5(props) end as response, coalesce(good, false) as hit from c""")
def cache_ttl(spark, sf):
    e = table(spark, sf, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    cache = e.select(F.col("event_id").alias("cache_key"), F.col("props").alias("response"), F.col("ts").alias("created_at"))
    out = st.cached(e.select(F.col("event_id").alias("cache_key")), cache, now, 5)
    return out.select(F.col("cache_key").alias("event_id"), F.md5(F.col("response").cast("binary")).alias("response"), "hit")


_OUTCOME = "case when event_id % 7 in (1, 2, 3) then 'error' when event_id % 7 = 5 then 'empty' else 'ok' end"


@query(f"""with a as (select user_id as client, event_id as seq, {_OUTCOME} as outcome from events),
i as (select *, sum((outcome <> 'error')::int) over w as g1, sum((outcome = 'ok')::int) over w as g2, row_number() over w as sent from a window w as (partition by client order by seq)),
k as (select *, sum((outcome = 'error')::int) over (partition by client, g1 order by seq) as error_streak, sum((outcome = 'empty')::int) over (partition by client, g2 order by seq) as empty_streak from i)
select client, seq, error_streak::bigint as error_streak, empty_streak::bigint as empty_streak, max((error_streak >= 2 or empty_streak >= 3 or sent >= 300)::int) over (partition by client order by seq) = 1 as tripped from k""")
def breaker_log(spark, sf):
    a = table(spark, sf, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("seq"), F.expr(_OUTCOME).alias("outcome"))
    return enrich.breakers(a, errors=2, empties=3).select("client", "seq", "error_streak", "empty_streak", "tripped")


_EDGES = f"""p0 as (select page_id, {DOMAIN_SQL} as domain from pages), o as (select page_id, domain, lead(page_id) over (partition by domain order by page_id) as n1, lead(page_id, 3) over (partition by domain order by page_id) as n3 from p0),
e as (select page_id as src, n1 as dst from o where n1 is not null union select page_id, n3 from o where n3 is not null)"""


def _edges(spark, sf) -> DataFrame:
    w = Window.partitionBy("domain").orderBy("page_id")
    o = pages(spark, sf).select("page_id", "domain", F.lead("page_id").over(w).alias("n1"), F.lead("page_id", 3).over(w).alias("n3"))
    return o.select(F.col("page_id").alias("src"), F.explode(F.array("n1", "n3")).alias("dst")).where("dst is not null").distinct()


@query(f"with recursive {_EDGES}, s as (select min(page_id) as url from p0 group by domain), r as (select url, 0 as depth from s union select e.dst, depth + 1 from r join e on e.src = r.url where depth < 3) select url, min(depth)::int as depth from r group by url")
def crawl_bfs(spark, sf):
    seeds = pages(spark, sf).groupBy("domain").agg(F.min("page_id").alias("url"))
    return landing.crawl(_edges(spark, sf), seeds, 3)


@query(f"with {_EDGES}, r as (select page_id, domain, row_number() over (partition by domain order by page_id) as r from p0) select page_id, domain from r where r <= 3")
def capped_sources(spark, sf):
    return landing.capped(pages(spark, sf).select("page_id", "domain"), "domain", "page_id", 3)


@query("""with b as (select item_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') as ws from benchmark)
select item_id, (i - 1)::int as position, ws[i] as keyword from (select item_id, ws, unnest(range(1, len(ws) + 1)) as i from b)""")
def suggestion_lists(spark, sf):
    b = table(spark, sf, "benchmark")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    response = F.concat(F.lit('["q",'), F.to_json(words), F.lit("]"))
    return landing.suggestions(b.select("item_id", response.alias("response"))).select("item_id", "position", "keyword")


@query()
def enriched_keywords(spark, sf):
    """Landed answers hold the titles that share a product's first word; relevant ones become keywords."""
    s = state(spark, sf)
    asked = enrich.queries_of(enrich.pending(s["canonical"]), RULES, compose=False)
    first = F.split(F.lower("raw_title"), " ")[0]
    answers = s["raw"].groupBy(first.alias("w")).agg(F.array_sort(F.collect_set("raw_title")).alias("l"))
    responses = asked.select("query").distinct().withColumn("w", F.split(F.lower("query"), " ")[0]).join(answers, "w").select("query", F.concat(F.lit('["q",'), F.to_json("l"), F.lit("]")).alias("response"))
    return enrich.keywords(asked, responses, RULES, 0.5, compose=False)


@query()
def parsed_sitemaps(spark, sf):
    urls = pages(spark, sf).groupBy("domain").agg(F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>")))), ""), F.lit("</urlset>")).alias("xml"))
    return urls.select("domain", F.explode(landing.parse_sitemap(F.col("xml"))["urls"]).alias("url"))


@query(f"with {STATE_SQL} select 'runs' as t, 0::bigint as n union all select 'raw', count(*) from raw where run_id <> 'run0' union all select 'canonical', count(*) from canonical where run_id <> 'run0' union all select 'mapping', count(*) from mapping m join canonical c on c.id = m.canonical_id where run_id <> 'run0' union all select 'keywords', count(*) from keywords k join canonical c on c.id = k.canonical_id where run_id <> 'run0'")
def delete_run(spark, sf):
    s = state(spark, sf)
    runs = spark.createDataFrame([("run0",)], "run_id string")
    left = st.delete_run({"runs": runs, "raw_products": s["raw"], "canonical_products": s["canonical"], "product_mapping": s["mapping"], "lsi_keywords": s["keywords"]}, "run0")
    names = {"runs": "runs", "raw_products": "raw", "canonical_products": "canonical", "product_mapping": "mapping", "lsi_keywords": "keywords"}
    counts = [df.agg(F.lit(names[n]).alias("t"), F.count("*").alias("n")) for n, df in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
