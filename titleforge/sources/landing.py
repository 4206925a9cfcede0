"""Landed inputs: pages, sitemaps, site lists, names, suggestions; and walks over landed pages."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from titleforge.functions import fixed as X
from titleforge.functions import html as H
from titleforge.functions.text import Rules, plain
from titleforge.operators.graph import cut

MOST_SITES = 300


@dataclass(frozen=True)
class Site:
    """How one site is read."""

    domain: str = ""
    base_url: str = ""
    product_url_include: tuple[str, ...] = ()
    product_url_exclude: tuple[str, ...] = ()
    title_selector: str = ""
    site_name: str = ""
    seed_urls: tuple[str, ...] = ()
    js: bool = False
    max_pages: int = 500
    max_depth: int = 3

    @classmethod
    def of(cls, entry: str | dict, defaults: dict | None = None) -> Site:
        """From a URL or a mapping; the domain follows from the URL."""
        given = {**(defaults or {}), **({"base_url": entry} if isinstance(entry, str) else entry)}
        url = given.get("base_url") or given.get("domain", "")
        url = url if "://" in url else f"https://{url}"
        given |= {"base_url": url, "domain": given.get("domain") or url.split("://", 1)[1].split("/")[0].lower()}
        names = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in names and v is not None})


@dataclass
class Config:
    """A tree of settings over defaults; a dotted look-up gives the default for what is missing or null."""

    data: dict = field(default_factory=dict)

    @staticmethod
    def merged(base: dict, over: dict) -> dict:
        both = dict(base)
        for k, v in over.items():
            both[k] = Config.merged(both[k], v) if isinstance(v, dict) and isinstance(both.get(k), dict) else v
        return both

    def get(self, dotted: str, default=None):
        node = self.data
        for part in dotted.split("."):
            node = node.get(part) if isinstance(node, dict) else None
            if node is None:
                return default
        return node


def clean_sites(lines: DataFrame, column: str = "raw", most: int = MOST_SITES) -> DataFrame:
    """(pos, url) of pasted lists: trimmed, with a scheme, a host with a dot, each host and path once, in order."""
    parts = lines.select(F.posexplode(F.split(column, r"[\n,]")).alias("pos", "u"))
    bare = F.regexp_replace(F.replace(F.trim(F.regexp_replace("u", r"(?U)^\s+|\s+$", "")), F.lit(X.ZWNJ), F.lit("")), "/+$", "")
    urls = parts.withColumn("url", bare).where((F.col("url") != "") & ~F.startswith("url", F.lit("#")))
    urls = urls.withColumn("url", F.when(F.col("url").contains("://"), F.col("url")).otherwise(F.concat(F.lit("https://"), "url")))
    host = H.domain_of(F.col("url"))
    urls = urls.where(F.col("url").rlike("(?i)^https?://") & host.contains("."))
    key = F.concat(host, F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")))
    first = urls.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where("r = 1")
    return first.orderBy("pos").limit(most).select("pos", "url")


def is_listing(url: Column) -> Column:
    """A seed with a query or a path is a listing."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")).rlike(".") | (F.regexp_replace(path, "^/+|/+$", "") != "")


def filter_urls(urls: DataFrame, domain: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), url: str = "url", pos: str = "pos") -> DataFrame:
    """URLs of the domain that no exclude and any include matches, without fragments, the first of equal ones."""
    plain_url = F.regexp_replace(url, "#.*$", "")
    keep = H.same_domain(plain_url, F.lit(domain))
    for p in exclude:
        keep &= ~plain_url.rlike(p)
    if include:
        keep &= plain_url.rlike("|".join(f"(?:{p})" for p in include))
    kept = urls.withColumn(url, plain_url).where(keep)
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy(url).orderBy(pos))).where("_r = 1").drop("_r")


def sitemap_of(text: str | None) -> tuple[list[str], list[str]]:
    try:
        root = ET.fromstring((text or "").strip())
    except ET.ParseError:
        return [line.strip() for line in (text or "").splitlines() if line.startswith("http")], []
    found = [loc.text.strip() for child in root if (loc := child.find("{*}loc")) is not None and (loc.text or "").strip()]
    return ([], found) if root.tag.rpartition("}")[2] == "sitemapindex" else (found, [])


@F.pandas_udf(StructType([StructField(n, ArrayType(StringType())) for n in ("urls", "nested")]))
def parse_sitemap(xml: pd.Series) -> pd.DataFrame:
    """Malformed XML would fail a native xpath, so parsing is guarded in Python."""
    return pd.DataFrame([sitemap_of(x) for x in xml], columns=["urls", "nested"])


def suggestions(responses: DataFrame, column: str = "response") -> DataFrame:
    """(.., position, keyword): the list inside JSON answers ["query", ["a", ..]]; malformed answers have none."""
    found = F.from_json(F.get_json_object(column, "$[1]"), "array<string>")
    return responses.select("*", F.posexplode(F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")).alias("position", "keyword"))


def names(spark: SparkSession, path: str, rules: Rules = Rules()) -> tuple[str, ...]:
    """A gazetteer: one name a line, # for comments. Bounded: it is a word list."""
    rows = spark.read.text(path).where(~F.startswith(F.trim("value"), F.lit("#")) & (F.trim("value") != "")).collect()
    return tuple(sorted({plain(r["value"], rules).replace(X.ZWNJ, "") for r in rows}))


def crawl(links: DataFrame, seeds: DataFrame, max_depth: int = 3, max_pages: int | None = None) -> DataFrame:
    """(url, depth) reached over landed links (src, dst), breadth first; each round is one anti-join.

    With ``max_pages`` a round takes the first pages by (parent's order is lost on purpose) url.
    """
    seen = cut(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for depth in range(1, max_depth + 1):
        step = front.join(links.select(F.col("src").alias("url"), "dst"), "url").select(F.col("dst").alias("url")).distinct()
        front = step.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth))
        if max_pages is not None:
            left = max_pages - seen.count()
            if left <= 0:
                break
            front = front.orderBy("url").limit(left)
        front = cut(front)
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def listing_pages(pages: DataFrame, seeds: DataFrame, max_depth: int = 10) -> DataFrame:
    """(url, step): a listing and the pages that follow it by (url, next_url)."""
    now = seeds.select("url").withColumn("step", F.lit(0))
    seen = now
    for step in range(1, max_depth + 1):
        now = cut(now.join(pages, "url").where("next_url is not null").select(F.col("next_url").alias("url")).distinct().join(seen, "url", "left_anti").withColumn("step", F.lit(step)))
        if now.isEmpty():
            break
        seen = cut(seen.unionByName(now))
    return seen


def next_page(page: Column, base: Column) -> Column:
    """The link marked as next; only root-relative, absolute and query links are joined natively."""
    tag = F.regexp_extract(page, r"""(?is)<(?:a|link)\b[^>]*(?:rel|class)=["'][^"']*\bnext\b[^"']*["'][^>]*>""", 0)
    href = H.unescape(F.regexp_extract(tag, r"""(?i)href=["']([^"']+)["']""", 1))
    origin = F.regexp_extract(base, r"^[a-zA-Z]+://[^/]+", 0)
    return H.some(F.when(href.rlike("^https?://"), href).when(F.startswith(href, F.lit("/")), F.concat(origin, href)).when(F.startswith(href, F.lit("?")), F.concat(F.regexp_replace(base, r"[?#].*$", ""), href)).otherwise(F.lit("")))


def capped(rows: DataFrame, site: str, order: str, cap: int) -> DataFrame:
    """The first ``cap`` rows of each site; 0 means no cap."""
    if cap <= 0:
        return rows
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(site).orderBy(order))).where(F.col("_r") <= cap).drop("_r")
