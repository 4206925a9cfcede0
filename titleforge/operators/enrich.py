"""Keyword enrichment on landed suggestions: coverage, early stop, positions, ownership, status; breaker log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleforge.functions import similarity as S
from titleforge.functions import text as T
from titleforge.functions.text import Rules
from titleforge.sources.landing import suggestions


def pending(canonical: DataFrame) -> DataFrame:
    return canonical.where("suggest_status is null")


def queries_of(products: DataFrame, rules: Rules = Rules(), most: int = 4, **options) -> DataFrame:
    """(canonical_id, variant, query): search forms by rank; the title itself where there is none."""
    shape = {k: options.pop(k) for k in ("min_words", "prefixes") if k in options}
    asked = products.withColumn("_q", T.search_query(F.col("canonical_title"), rules, **options))
    forms = F.slice(T.variants_of(F.col("_q"), **shape), 1, most)
    forms = F.when(F.size(forms) > 0, forms).otherwise(F.array("canonical_title"))
    return asked.select(F.col("id").alias("canonical_id"), F.posexplode(forms).alias("variant", "query"))


def keywords(asked: DataFrame, responses: DataFrame, rules: Rules = Rules(), min_ratio: float = 1.0, enough: int = 8, compose: bool = True) -> DataFrame:
    """(canonical_id, keyword, position, source_query) from queries and landed (query, response).

    A keyword counts where it first appears; a variant is read only while the ones before gave fewer than
    ``enough`` keywords; positions go by discovery.
    """
    found = suggestions(asked.join(responses, "query"), "response").withColumnRenamed("position", "place")
    kept = found.where(T.covers(F.col("keyword"), F.col("query"), rules, min_ratio, compose))
    first = kept.withColumn("r", F.row_number().over(Window.partitionBy("canonical_id", "keyword").orderBy("variant", "place"))).where("r = 1")
    before = F.count("*").over(Window.partitionBy("canonical_id").orderBy("variant").rangeBetween(Window.unboundedPreceding, -1))
    read = first.withColumn("before", before).where(F.col("before") < enough)
    position = F.row_number().over(Window.partitionBy("canonical_id").orderBy("variant", "place")).cast("int")
    return read.select("canonical_id", "keyword", position.alias("position"), F.col("query").alias("source_query"))


def owners(claims: DataFrame, canonical: DataFrame, rules: Rules = Rules(), score: Column | None = None) -> DataFrame:
    """Each keyword's one owner: the closest title, then the least position, then the least id.

    Only keywords with several claims are scored.
    """
    counted = claims.withColumn("n", F.count("*").over(Window.partitionBy("keyword")))
    titles = canonical.select(F.col("id").alias("canonical_id"), "canonical_title")
    contested = counted.where("n > 1").join(titles, "canonical_id", "left").withColumn("canonical_title", F.coalesce("canonical_title", F.lit("")))
    if score is None:
        score = S.title_similarity(T.normalize(F.col("keyword"), rules), T.normalize(F.col("canonical_title"), rules))
    ranked = contested.withColumn("score", score).withColumn("r", F.row_number().over(Window.partitionBy("keyword").orderBy(F.col("score").desc(), "position", "canonical_id")))
    return counted.where("n = 1").select(*claims.columns).unionByName(ranked.where("r = 1").select(*claims.columns))


def breakers(attempts: DataFrame, errors: int = 3, empties: int = 40, session: int = 300) -> DataFrame:
    """Attempts (seq, outcome: ok, empty or error) with running streaks, and whether a breaker had tripped by then.

    One log is one client's session, at most ``session`` long before it stops.
    """
    order = Window.partitionBy("client").orderBy("seq")
    out = attempts
    for name, broken_by in (("error", "outcome <> 'error'"), ("empty", "outcome = 'ok'")):
        island = F.sum(F.expr(f"cast({broken_by} as int)")).over(order)
        out = out.withColumn(f"_{name}", island).withColumn(f"{name}_streak", F.sum(F.expr(f"cast(outcome = '{name}' as int)")).over(Window.partitionBy("client", f"_{name}").orderBy("seq"))).drop(f"_{name}")
    out = out.withColumn("sent", F.row_number().over(order))
    tripped = (F.col("error_streak") >= errors) | (F.col("empty_streak") >= empties) | (F.col("sent") >= session)
    return out.withColumn("tripped", F.max(tripped.cast("int")).over(order) == 1)
