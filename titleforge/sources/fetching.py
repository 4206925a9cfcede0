"""What a crawler may fetch and what it gets, over landed robots files, sitemaps and responses."""

from __future__ import annotations

import urllib.robotparser
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from titleforge.functions import html as H
from titleforge.operators.graph import cut
from titleforge.sources import landing

AGENT = "Mozilla/5.0"
DISALLOWED = 999

# Answers after which a browser is tried, the length under which a page is an empty shell,
# places of sitemaps where robots.txt names none, and how many sitemaps of a site are opened.
BROWSER_STATUSES = (0, 403, 429, 503)
SHELL = 200
SITEMAP_GUESSES = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/wp-sitemap.xml")
MOST_SITEMAPS = 60

_RULES = StructType([
    StructField("rules", ArrayType(StructType([StructField("allow", BooleanType()), StructField("path", StringType())]))),
    StructField("sitemaps", ArrayType(StringType())),
])


def robots_of(text: str | None, agent: str = AGENT) -> tuple[list[tuple[bool, str]], list[str]]:
    """The rules that hold for the agent, in order, with decoded paths; and the named sitemaps."""
    parser = urllib.robotparser.RobotFileParser()
    try:
        parser.parse((text or "").splitlines())
    except ValueError:
        return [], []
    entry = next((e for e in parser.entries if e.applies_to(agent)), parser.default_entry)
    rules = [(line.allowance, unquote(line.path)) for line in entry.rulelines] if entry else []
    return rules, list(parser.site_maps() or [])


def parsed_robots(robots: DataFrame, agent: str = AGENT) -> DataFrame:
    """(origin, rules, sitemaps) of landed files (origin, text), each parsed once; the greatest text of equal origins counts."""

    @F.pandas_udf(_RULES)
    def parse(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([robots_of(t, agent) for t in text], columns=["rules", "sitemaps"])

    one = robots.groupBy("origin").agg(F.max("text").alias("text"))
    return one.select("origin", parse("text").alias("r")).select("origin", "r.rules", "r.sitemaps")


def origin_of(url: Column) -> Column:
    """Scheme and host as they stand in the URL: a strict parser would refuse one with a space in it."""
    scheme, host = (F.regexp_extract(url, r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?//([^/?#]*)", i) for i in (1, 2))
    return F.concat(F.when(scheme == "", "https").otherwise(F.lower(scheme)), F.lit("://"), host)


def permitted(url: Column, rules: Column) -> Column:
    """The first rule whose path begins the URL's decides; no rules or none that fits: permitted."""
    decoded = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)
    path = F.regexp_replace(decoded, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    first = F.get(F.filter(rules, lambda r: F.startswith(path, r["path"])), F.lit(0))
    return F.coalesce(first["allow"], F.lit(True))


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def fetched(requests: DataFrame, http: DataFrame, rules: DataFrame | None = None, browser: DataFrame | None = None, key: str = "url") -> DataFrame:
    """(.., status, html, via, ok) of requests (url, [force]) over landed answers (key, status, html).

    Where one URL is asked for more than once and each request has its own answer, ``key`` names the column of both that
    tells the requests apart; by default an answer serves every request for its URL.

    A disallowed URL has status 999 and no page; one that never answered has status 0. A browser's answer stands in for
    a refused, failed or empty one, and comes first, if it is good, for a forced request. Each request has one row: of several answers to a key one of status 200
    counts before others, then the greatest.
    """
    force = F.coalesce("force", F.lit(False)) if "force" in requests.columns else F.lit(False)
    asked = requests.withColumn("_force", force)
    if rules is None:
        asked = asked.withColumn("_may", F.lit(True))
    else:
        asked = asked.withColumn("_origin", origin_of(F.col("url"))).join(rules.select(F.col("origin").alias("_origin"), F.col("rules").alias("_rules")), "_origin", "left")
        asked = asked.withColumn("_may", permitted(F.col("url"), F.col("_rules"))).drop("_origin", "_rules")
    # a disallowed request has no answer, so it meets none
    answer = lambda df, name: df.groupBy(F.col(key).alias(f"_u{name}")).agg(F.max(F.struct(F.col("status").eqNullSafe(200).alias("first"), "status", "html")).alias(name))
    both = asked.join(answer(http, "_h"), F.col("_may") & (F.col(key) == F.col("_u_h")), "left").drop("_u_h")
    status, page = F.coalesce("_h.status", F.lit(0)), F.coalesce("_h.html", F.lit(""))
    if browser is None:
        use = F.lit(False)
        both = both.withColumn("_b", F.lit(None).cast("struct<status int, html string>"))
    else:
        both = both.join(answer(browser, "_b"), F.col("_may") & (F.col(key) == F.col("_u_b")), "left").drop("_u_b")
        good = (F.col("_b.status") == 200) & (stripped(F.col("_b.html")) != "")
        poor = status.isin(*BROWSER_STATUSES) | ((status == 200) & (F.length(stripped(page)) < SHELL))
        use = F.col("_b").isNotNull() & (poor | (F.col("_force") & good))
    out = both.withColumn("_use", F.coalesce(use, F.lit(False)))
    out = out.withColumns({
        "status": F.when(~F.col("_may"), DISALLOWED).when(F.col("_use"), F.col("_b.status")).otherwise(status).cast("int"),
        "html": F.when(~F.col("_may"), "").when(F.col("_use"), F.coalesce("_b.html", F.lit(""))).otherwise(page),
        "via": F.when(~F.col("_may"), "robots-disallow").when(F.col("_use"), "browser").otherwise("http"),
    }).drop("_may", "_force", "_use", "_h", "_b")
    return out.withColumn("ok", (F.col("status") == 200) & (stripped(F.col("html")) != ""))


def sitemap_starts(sites: DataFrame, robots: DataFrame) -> DataFrame:
    """(site, url, pos): the sitemaps that robots.txt names for each of the sites (site, base_url), else the usual places."""
    named = sites.withColumn("origin", origin_of(F.col("base_url"))).join(robots.select("origin", "sitemaps"), "origin", "left")
    guesses = F.array(*(F.concat("origin", F.lit(g)) for g in SITEMAP_GUESSES))
    return named.select("site", F.posexplode(F.when(F.size(F.coalesce("sitemaps", F.array().cast("array<string>"))) > 0, F.col("sitemaps")).otherwise(guesses)).alias("pos", "url"))


def sitemap_walk(starts: DataFrame, maps: DataFrame, most: int) -> DataFrame:
    """(site, place, url): URLs of each site's sitemaps, breadth first in the order of ``starts`` (site, url, pos).

    ``maps`` are landed answers (url, status, html). A sitemap past the 60th queues no further ones, and none is opened
    once four times ``most`` URLs are found. Each round is one level for all sites at once.
    """
    parsed = cut(maps.where((F.col("status") == 200) & (stripped(F.col("html")) != "")).select("url", landing.parse_sitemap("html").alias("p")).select("url", "p.urls", "p.nested"))
    of_site = Window.partitionBy("site")
    first = starts.groupBy("site", "url").agg(F.min("pos").alias("pos"))
    front = cut(first.select("site", "url", F.row_number().over(of_site.orderBy("pos")).alias("rank")))
    seen = front
    while True:
        nested = front.where(F.col("rank") < MOST_SITEMAPS).join(parsed, "url").select("site", "rank", F.posexplode("nested").alias("pos", "url"))
        fresh = nested.groupBy("site", "url").agg(F.min(F.struct("rank", "pos")).alias("o")).join(seen.select("site", "url"), ["site", "url"], "left_anti")
        sizes = seen.groupBy("site").agg(F.max("rank").alias("n"))
        front = cut(fresh.join(sizes, "site").select("site", "url", (F.col("n") + F.row_number().over(of_site.orderBy("o"))).alias("rank")))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    opened = seen.join(parsed.select("url", "urls"), "url")
    before = F.coalesce(F.sum(F.size("urls")).over(of_site.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = opened.withColumn("before", before).where(F.col("before") < 4 * most)
    return found.select("site", "before", F.posexplode("urls").alias("pos", "url")).select("site", (F.col("before") + F.col("pos")).alias("place"), "url")


def dispatched(sites: DataFrame, listing: DataFrame, sitemap: DataFrame, crawl: DataFrame) -> DataFrame:
    """(site, source, place, url): a listing seed's own links; for a root the sitemap's, or the crawl's where that has none.

    ``sites`` are (site, base_url); the three found frames are (site, place, url).
    """
    frames = [df.select("site", F.lit(i).alias("order"), F.lit(name).alias("source"), "place", "url") for i, (name, df) in enumerate((("listing", listing), ("sitemap", sitemap), ("crawl", crawl)))]
    found = frames[0].unionByName(frames[1]).unionByName(frames[2])
    found = found.join(sites.select("site", landing.is_listing(F.col("base_url")).alias("listed")), "site").where(F.col("listed") == (F.col("order") == 0))
    best = found.groupBy("site").agg(F.min("order").alias("order"))
    return found.join(best, ["site", "order"]).select("site", "source", "place", "url")


def candidates(found: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, rank, url, ..): found URLs (site, place, url) by their site's patterns, each once, the first ``pool`` in order.

    ``sites`` are (site, domain, include, exclude, pool) with one pattern for all of a kind; an empty one holds for none
    of them, and a pool of 0 is no cap.
    """
    url = F.regexp_replace("url", "#.*$", "")
    rows = found.withColumn("url", url).join(sites.select("site", "domain", "include", "exclude", "pool"), "site")
    keep = H.same_domain(F.col("url"), F.col("domain")) & ((F.col("include") == "") | F.rlike("url", F.col("include"))) & ~((F.col("exclude") != "") & F.rlike("url", F.col("exclude")))
    first = rows.where(keep).groupBy("site", "url", "pool").agg(F.min("place").alias("place"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy("place", "url")))
    return ranked.where((F.col("pool") == 0) | (F.col("rank") <= F.col("pool"))).select("site", "rank", "url")


def cap_of(limit: int | None = None, option: int | None = None, setting: int | None = None) -> int:
    """Products of a site at most: the first given of a command's limit, a run's option and a setting; 0 is none."""
    return next((int(n) for n in (limit, option, setting) if n), 0)


def pool_of(max_pages: int, cap: int) -> int:
    """How many candidate URLs of a site are opened for ``cap`` products."""
    return min(max_pages, cap * 6) if cap else max_pages
