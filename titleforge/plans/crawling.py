"""Queries of the crawl's rules over the provided pages, and of a run's plan, sheets and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleforge.functions import html as H
from titleforge.operators import reports, resolve
from titleforge.operators import state as st
from titleforge.plans.derived import DOMAIN_SQL, WIDE_SQL, state, table
from titleforge.plans.queries import ORACLES, QUERIES, query
from titleforge.sources import fetching, schemas

__all__ = ["ORACLES", "QUERIES"]

# Every http origin has this file, the https ones have none.
_ROBOTS = "User-agent: *\nAllow: /en/1\nDisallow: /en/\nDisallow: /fr/2\nSitemap: "
_PATH_SQL = "regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', '')"
_MAY_SQL = f"(not starts_with(url, 'http://') or starts_with({_PATH_SQL}, '/en/1') or not (starts_with({_PATH_SQL}, '/en/') or starts_with({_PATH_SQL}, '/fr/2')))"
_STATUS = "case page_id % 11 when 1 then 403 when 2 then 404 when 3 then 503 else 200 end"
_HTTP = "case when page_id % 5 = 0 then substring(html, 1, 150) else html end"


def _rules(p: DataFrame) -> DataFrame:
    origins = p.select(fetching.origin_of(F.col("url")).alias("origin")).distinct().where("origin like 'http://%'")
    return fetching.parsed_robots(origins.withColumn("text", F.concat(F.lit(_ROBOTS), "origin", F.lit("/map.xml"))))


def _answers(p: DataFrame) -> DataFrame:
    http = p.where("page_id % 13 <> 4").select("page_id", F.expr(_STATUS).alias("status"), F.expr(_HTTP).alias("html"))
    browser = p.where("page_id % 2 = 0").select("page_id", F.expr("if(page_id % 6 = 0, 500, 200)").alias("status"), F.concat(F.lit("browser "), "html").alias("html"))
    return fetching.fetched(p.select("page_id", "url", (F.col("page_id") % 7 == 0).alias("force")), http, _rules(p), browser, key="page_id")


@query(f"select page_id, {_MAY_SQL} as may from pages")
def robots_allowed(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url").withColumn("origin", fetching.origin_of(F.col("url")))
    return p.join(_rules(p), "origin", "left").select("page_id", fetching.permitted(F.col("url"), F.col("rules")).alias("may"))


_FETCHED_SQL = f"""a as (select *, {_MAY_SQL} as may, case when page_id % 13 = 4 then 0 else {_STATUS} end as s0, case when page_id % 13 = 4 then '' else {_HTTP} end as h0,
  page_id % 2 = 0 as has_b, case when page_id % 6 = 0 then 500 else 200 end as s1, 'browser ' || html as h1 from pages),
b as (select *, has_b and (s0 in (0, 403, 429, 503) or (s0 = 200 and length(trim(h0, chr(9) || chr(10) || chr(13) || ' ')) < 200) or (page_id % 7 = 0 and s1 = 200 and trim(h1) <> '')) as use_b from a),
f as (select page_id, url, case when not may then 999 when use_b then s1 else s0 end as status, case when not may then '' when use_b then h1 else h0 end as html, case when not may then 'robots-disallow' when use_b then 'browser' else 'http' end as via from b)"""


@query(f"with {_FETCHED_SQL} select page_id, status::int as status, via, md5(html) as page, status = 200 and trim(html) <> '' as ok from f")
def fetch_outcomes(spark, sf):
    return _answers(table(spark, sf, "pages")).select("page_id", "status", "via", F.md5(F.col("html").cast("binary")).alias("page"), "ok")


@query(f"""with {_FETCHED_SQL}, o as (select page_id, {DOMAIN_SQL} as site, status = 200 and trim(html) <> '' as ok, page_id % 4 <> 1 as is_product, case when page_id % 3 > 0 then 't' else ' ' end as title from f)
select site, count(*) as pages_fetched, count(*) filter (not ok) as failures, count(*) filter (ok and not is_product) as not_product, count(*) filter (ok and is_product and trim(title) <> '') as titles_found from o group by site""")
def crawl_counters(spark, sf):
    opened = _answers(table(spark, sf, "pages")).select(H.domain_of(F.col("url")).alias("site"), "ok", (F.col("page_id") % 4 != 1).alias("is_product"), F.when(F.col("page_id") % 3 > 0, "t").otherwise(" ").alias("title"))
    return reports.crawl_counters(opened)


_LANG_SQL = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]*/([a-z]+)/', 1)"


@query(f"""with p as (select page_id, url, {DOMAIN_SQL} as site, {_LANG_SQL} as lang from pages), n as (select site, lang, count(*) as n from p group by all),
b as (select site, lang, coalesce(sum(n) over (partition by site order by lang rows between unbounded preceding and 1 preceding), 0) as before from n)
select site, (before + row_number() over (partition by site, lang order by page_id) - 1)::bigint as place, url from p join b using (site, lang) where before < 4""")
def sitemap_urls(spark, sf):
    """Each site's index names itself, a map that is not there, and one map a language."""
    p = table(spark, sf, "pages").select("page_id", "url", H.domain_of(F.col("url")).alias("site"), F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]*/([a-z]+)/", 1).alias("lang"))
    loc = lambda tag, u: F.concat(F.lit(f"<{tag}><loc>"), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit(f"</loc></{tag}>"))
    at = lambda name: F.concat(F.lit("https://"), "site", F.lit("/"), name, F.lit(".xml"))
    ordered = lambda key, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), text.alias("t")))), lambda x: x["t"]), "")
    maps = p.groupBy("site", "lang").agg(F.concat(F.lit("<urlset>"), ordered("page_id", loc("url", F.col("url"))), F.lit("</urlset>")).alias("html")).select(at(F.col("lang")).alias("url"), "html")
    listed = p.select("site", "lang").distinct().groupBy("site").agg(ordered("lang", loc("sitemap", at(F.col("lang")))).alias("all"))
    index = listed.select(at(F.lit("sitemap")).alias("url"), F.concat(F.lit("<sitemapindex>"), loc("sitemap", at(F.lit("sitemap"))), loc("sitemap", at(F.lit("gone"))), "all", F.lit("</sitemapindex>")).alias("html"))
    none = fetching.parsed_robots(spark.createDataFrame([], "origin string, text string"))
    starts = fetching.sitemap_starts(p.select("site", F.concat(F.lit("https://"), "site").alias("base_url")).distinct(), none)
    return fetching.sitemap_walk(starts, maps.unionByName(index).withColumn("status", F.lit(200)), 1).withColumn("place", F.col("place").cast("long"))


@query(f"""with p as (select page_id, url, {DOMAIN_SQL} as site from pages), s as (select site, min(page_id) % 3 as kind from p group by site),
f as (select site, page_id as place, regexp_replace(url, '#.*$', '') as url from p join s using (site) where case kind when 0 then page_id % 2 = 0 when 1 then page_id % 4 = 1 else true end
  or (kind = 1 and site not in (select site from p where page_id % 4 = 1))),
k as (select site, url, min(place) as place from f where regexp_matches(url, '(?:/en/)|(?:/fr/)') and not regexp_matches(url, '(?:[?]page=)') group by all)
select site, rank, url from (select site, row_number() over (partition by site order by place, url)::int as rank, url from k) where rank <= 3""")
def site_candidates(spark, sf):
    """A third of the sites is seeded by a listing, a third has sitemaps for some, the rest is crawled."""
    p = table(spark, sf, "pages").select("page_id", "url", H.domain_of(F.col("url")).alias("site"))
    kinds = p.groupBy("site").agg((F.min("page_id") % 3).alias("kind"))
    sites = kinds.select("site", "kind", F.concat(F.lit("https://"), "site", F.when(F.col("kind") == 0, "/list").otherwise("")).alias("base_url"))
    rows = p.select("site", F.col("page_id").alias("place"), "url").join(kinds, "site")
    found = fetching.dispatched(sites, rows.where("kind = 0 and place % 2 = 0"), rows.where("kind = 1 and place % 4 = 1"), rows)
    table_of = sites.select("site", F.col("site").alias("domain"), F.lit("(?:/en/)|(?:/fr/)").alias("include"), F.lit("(?:[?]page=)").alias("exclude"), F.lit(fetching.pool_of(3, 2)).alias("pool"))
    return fetching.candidates(found, table_of)


@query(f"""with {WIDE_SQL} select 'ready' as sheet, count(*) filter (suggest_status = 'has_suggest') as n from wide union all select 'archive', count(*) filter (coalesce(suggest_status, '') <> 'has_suggest') from wide
union all select 'all', count(*) from wide union all select 'review', (select count(*) from wide where needs_review) + (select count(*) from raw where is_relevant is null)""")
def sheet_counts(spark, sf):
    s = state(spark, sf)
    return reports.sheet_counts(reports.sheets(s["canonical"], s["mapping"], s["raw"], s["keywords"]))


@query("""select c_custkey::varchar as run_id, case when c_custkey = 7 then 'roman' else c_mktsegment end as target_topic, case when c_custkey = 7 then 'a.ir,b.ir' else '' end as sites,
  case when c_custkey = 7 then 5 end as cap, null::varchar as categories from customer""")
def run_plan(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("run_id"), F.col("c_mktsegment").alias("target_topic"))
    runs = st.set_run_plan(schemas.reconciled(c, "runs"), "7", sites=["a.ir", "b.ir"], topic="roman", options={"max_products_per_site": 5})
    joined = lambda name: F.array_join(name, ",")
    return runs.select("run_id", "target_topic", F.coalesce(joined("sites"), F.lit("")).alias("sites"), F.col("options.max_products_per_site").alias("cap"), joined("categories").alias("categories"))


@query("""with k as (select o_orderkey, l_linenumber, l_returnflag from orders join lineitem on l_orderkey = o_orderkey)
select o_orderkey as canonical_id, l_returnflag as keyword, count(*) as n from k where not (o_orderkey = (select min(o_orderkey) from orders) and l_returnflag = 'N') group by all""")
def deleted_keyword(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    first = table(spark, sf, "orders").agg(F.min("o_orderkey")).first()[0]
    keywords = rows.select(F.col("l_orderkey").alias("canonical_id"), F.col("l_returnflag").alias("keyword"))
    return st.delete_keyword(keywords, first, "N").groupBy("canonical_id", "keyword").agg(F.count("*").alias("n"))


@query(f"""with p as (select page_id, {DOMAIN_SQL} as site from pages), r as (select page_id, site, row_number() over (partition by site order by page_id) as r from p)
select page_id, case when r = 1 then site else site || ' #' || r end as title from r""")
def unique_titles(spark, sf):
    p = table(spark, sf, "pages").select(F.col("page_id").alias("root"), H.domain_of(F.col("url")).alias("title"), F.array().cast("array<string>").alias("tokens"))
    return resolve.unique_titles(p).select(F.col("root").alias("page_id"), "title")
