"""A whole run on landed tables: titles and topics, products, keywords, reports; resumable by phase."""

from __future__ import annotations

import secrets
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from titleforge.functions import fixed as X
from titleforge.functions import html as H
from titleforge.functions import text as T
from titleforge.functions import vectors as V
from titleforge.functions.text import Rules
from titleforge.operators import enrich, reports, resolve
from titleforge.operators import state as st
from titleforge.operators.graph import cut
from titleforge.sources import fetching, landing, schemas

# Settings that hold where a configuration says nothing.
DEFAULTS = {
    "run": {"categories": [], "target_topic": "", "topic_examples": [], "auto_threshold": True, "relevance_threshold": 0.65, "review_threshold": 0.50},
    "sites": [],
    "crawl": {"max_depth": 3, "max_pages": 500},
    "normalizer": {},
    "resolve": {"similarity_threshold": 0.80, "blocking_top_tokens": 3, "strong_match_threshold": 0.88, "no_entity_threshold": 0.95},
    "suggest": {"max_query_words": 8, "max_variants_per_product": 4, "enough_keywords": 8, "min_keyword_coverage": 1.0, "query_prefixes": list(X.QUERY_PREFIXES)},
    "output": {"sheets": list(X.SHEETS), "keyword_columns": 10},
}
RUN_TABLES = list(schemas.KEYS)


def config(given: dict | None = None) -> landing.Config:
    return landing.Config(landing.Config.merged(DEFAULTS, given or {}))


def new_run_id() -> str:
    return f"{datetime.now(UTC):%Y%m%d-%H%M%S}-{secrets.token_hex(3)}"


def clean_options(raw: object) -> dict:
    """The known options of a run, in their ranges."""
    data = raw if isinstance(raw, dict) else {}
    try:
        cap = int(data.get("max_products_per_site") or 0)
    except (TypeError, ValueError):
        cap = 0
    return {"max_products_per_site": min(100_000, max(0, cap)), "require_product_signals": bool(data.get("require_product_signals", True)), "js": bool(data.get("js"))}


def categories(names: str | list[str] | None) -> list[tuple[str, tuple[str, ...]]]:
    """(label, examples) by key or label, each once; unknown names are categories without examples."""
    by_label = {label: examples for label, examples in X.CATEGORIES.values()}
    out: dict[str, tuple[str, ...]] = {}
    for name in [names] if isinstance(names, str) else names or []:
        label = X.CATEGORIES[name][0] if name in X.CATEGORIES else str(name).strip()
        if label:
            out.setdefault(label, by_label.get(label, ()))
    return list(out.items())


def topics(names: str | list[str] | None, topic: str = "", examples: tuple[str, ...] = ()) -> list[tuple[str, list[float], float | None, float | None]]:
    """(label, reference, relevant, review) of the categories, or of the one topic; limits are null where uncalibrated.

    The references come from a few fixed examples, so they are made on the driver.
    """
    chosen = [(label, own or tuple(examples)) for label, own in categories(names)] or ([(topic, tuple(examples))] if topic else [])
    if not chosen:
        raise ValueError("neither a category nor a topic is given")
    dot = lambda a, b: min(1.0, max(0.0, sum(x * y for x, y in zip(a, b, strict=True))))
    rank = lambda xs, f: sorted(xs)[round(f * (len(xs) - 1))]
    out = []
    for label, own in chosen:
        vectors = [V.hashed_vector(t) for t in (label, *own)]
        total = [sum(xs) for xs in zip(*vectors, strict=True)]
        size = sum(x * x for x in total) ** 0.5
        reference = [x / size for x in total] if size else total
        limits: tuple[float | None, float | None] = (None, None)
        if own:
            low, high = rank([dot(v, reference) for v in vectors[1:]], 0.15), rank([dot(V.hashed_vector(t), reference) for t in X.NEGATIVES], 0.90)
            if low > high:
                limits = (round(min(0.95, max(0.05, high + 0.5 * (low - high))), 4), round(min(0.95, max(0.03, high + 0.25 * (low - high))), 4))
        out.append((label, reference, *limits))
    return out


def scored(raw: DataFrame, references: list[tuple], relevant: float = 0.65, review: float = 0.50, auto: bool = True) -> DataFrame:
    """Sets topic_score, category and is_relevant of all rows; the raw title counts where the normal one is empty."""
    spark = raw.sparkSession
    rows = [(i, label, v, r if auto and r is not None else relevant, b if auto and b is not None else review) for i, (label, v, r, b) in enumerate(references)]
    known = spark.createDataFrame(rows, "ord int, label string, ref array<double>, relevant double, review double")
    text = F.when(F.coalesce("normalized_title", F.lit("")) != "", F.col("normalized_title")).otherwise(F.coalesce("raw_title", F.lit("")))
    vectors = cut(cut(raw.select("id", text.alias("t"))).select("id", V.hashing_encoder(F.col("t")).alias("v")))
    each = vectors.join(F.broadcast(known)).withColumn("score", V.cosine(F.col("v"), F.col("ref")))
    best = each.groupBy("id").agg(F.max_by(F.struct("label", "score", "relevant", "review"), F.struct(F.col("score"), -F.col("ord"))).alias("b"))
    out = raw.drop("topic_score", "category", "is_relevant").join(best, "id")
    out = out.withColumns({"topic_score": F.col("b.score"), "category": F.col("b.label"), "is_relevant": V.relevance(F.col("b.score"), F.col("b.relevant"), F.col("b.review"))})
    return schemas.reconciled(out, "raw_products")


def sites_table(spark: SparkSession, sites: list[landing.Site], cap: int = 0) -> DataFrame:
    """(site, domain, base_url, name, include, exclude, pool): the sites of a run, in their order."""
    either = lambda patterns: "|".join(f"(?:{p})" for p in patterns)
    rows = [(i, s.domain, s.base_url, s.site_name, either(s.product_url_include), either(s.product_url_exclude), fetching.pool_of(s.max_pages, cap)) for i, s in enumerate(sites)]
    return spark.createDataFrame(rows, "site int, domain string, base_url string, name string, include string, exclude string, pool int")


def crawl_phase(pages: DataFrame, sites: list[landing.Site], run_id: str, options: dict, rules: Rules = Rules(), limit: int | None = None, setting: int | None = None) -> DataFrame:
    """Raw products of landed pages (url, html): each site's pages by its patterns, product pages only, capped.

    Landed pages have no order of their own, so theirs is that of the URLs. Sites are few and given by hand; their rows
    are broadcast to one scan of the URLs, and pages are read again only for the candidates.
    """
    cap = fetching.cap_of(limit, options.get("max_products_per_site"), setting)
    known = F.broadcast(sites_table(pages.sparkSession, sites, cap))
    bare = F.regexp_replace("url", "#.*$", "")
    mine = pages.select("url").join(known.select("site", "domain"), H.same_domain(bare, F.col("domain"))).select("site", F.col("url").alias("place"), "url")
    chosen = cut(fetching.candidates(mine, known))
    found = pages.select(F.col("url").alias("landed"), bare.alias("url"), "html").join(chosen.select("site", "url"), "url").join(known.select("site", "name"), "site")
    if options.get("require_product_signals", True):
        found = found.where(H.product_signals(F.col("html"), F.col("url"))["is_product"])
    # pages are left behind here: only their titles are kept and finished in Python
    found = cut(found.select("site", "url", "landed", H.domain_of(F.col("url")).alias("domain"), H.title_candidate(F.col("html"), H.domain_of(F.col("url")), F.col("name")).alias("title")))
    titled = cut(found.withColumn("title", H.finished_title(F.col("title")))).where("title <> ''")
    # of pages that differ in their fragment the first counts
    single = titled.groupBy("site", "url", "domain").agg(F.min(F.struct("landed", "title"))["title"].alias("title"))
    kept = landing.capped(single, "site", "url", cap)
    first = kept.groupBy("url").agg(F.min(F.struct("site", "domain", "title")).alias("f")).select("url", "f.*")
    ids = first.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy("url"))).withColumn("id", (F.col("site") * F.lit(1_000_000_000) + F.col("rank")).cast("long"))
    rows = ids.select("id", F.lit(run_id).alias("run_id"), F.col("domain").alias("source_domain"), F.col("url").alias("source_url"), F.col("title").alias("raw_title"), T.normalize(F.col("title"), rules).alias("normalized_title"))
    return cut(schemas.reconciled(rows, "raw_products"))


def resolve_phase(raw: DataFrame, run_id: str, settings: landing.Config, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame]:
    """(canonical products, mapping) of a run's relevant rows."""
    rows = reports.relevant(raw).select(F.col("id").alias("raw_id"), "raw_title")
    limits = {"threshold": settings.get("resolve.similarity_threshold"), "strong": settings.get("resolve.strong_match_threshold"), "no_entity": settings.get("resolve.no_entity_threshold")}
    records, clusters, _ = resolve.resolve(rows, rules, settings.get("resolve.blocking_top_tokens"), **limits)
    records = cut(records)
    products = records.select(F.col("root").alias("id"), F.lit(run_id).alias("run_id"), F.col("title").alias("canonical_title"), F.col("tokens").alias("entity_tokens"), F.col("confidence").alias("merge_confidence"), "needs_review")
    return schemas.reconciled(products, "canonical_products"), clusters.select(F.col("idx").alias("raw_id"), F.col("root").alias("canonical_id"))


def enrich_phase(canonical: DataFrame, responses: DataFrame, settings: landing.Config, rules: Rules = Rules(), old: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(canonical, keywords) after pending products were asked; products without answers have no suggestion.

    Ownership is settled over the whole run, old keywords too.
    """
    s = lambda name: settings.get(f"suggest.{name}")
    asked = cut(enrich.queries_of(enrich.pending(canonical), rules, s("max_variants_per_product"), max_words=s("max_query_words"), prefixes=tuple(s("query_prefixes"))))
    found = cut(enrich.keywords(asked, responses, rules, s("min_keyword_coverage"), s("enough_keywords")))
    claims = found if old is None else st.insert_or_ignore(old.select(*found.columns), found, schemas.KEYS["lsi_keywords"], "position")
    owned = cut(enrich.owners(claims, canonical, rules))
    asked_now = F.coalesce("suggest_status", F.lit(st.NO))
    return st.refreshed(canonical.withColumn("suggest_status", asked_now), owned), owned


def run(spark: SparkSession, pages: DataFrame, sites: list[landing.Site], responses: DataFrame | None = None, given: dict | None = None, options: dict | None = None, run_id: str | None = None) -> dict[str, DataFrame]:
    """All phases; the tables of the run, with its sheets under ``sheet_<key>``."""
    settings, options, run_id = config(given), clean_options(options), run_id or new_run_id()
    rules = Rules.of(settings.get("normalizer"))
    refs = topics(settings.get("run.categories"), settings.get("run.target_topic", ""), tuple(settings.get("run.topic_examples")))
    raw = crawl_phase(pages, sites, run_id, options, rules, setting=settings.get("crawl.max_products_per_site"))
    raw = cut(scored(raw, refs, settings.get("run.relevance_threshold"), settings.get("run.review_threshold"), settings.get("run.auto_threshold")))
    canonical, mapping = resolve_phase(raw, run_id, settings, rules)
    canonical, mapping = cut(canonical), cut(mapping)
    keywords = schemas.empty(spark, "lsi_keywords").select("canonical_id", "keyword", "position", "source_query")
    if responses is not None:
        canonical, keywords = enrich_phase(canonical, responses, settings, rules)
        canonical = cut(canonical)
    sheets = reports.sheets(canonical, mapping, raw, keywords, settings.get("output.sheets"), settings.get("output.keyword_columns"))
    return {"raw_products": raw, "canonical_products": canonical, "product_mapping": mapping, "lsi_keywords": keywords} | {f"sheet_{k}": df for k, df in sheets.items()}
