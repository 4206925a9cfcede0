"""Changes of state tables as functions from frames to frames, and snapshots that replace each other whole."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HAS, NO = "has_suggest", "no_suggest"
_POINTER = "n long, name string"


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")


def insert_or_ignore(table: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows whose key is new are added, the first of equal ones; existing rows stay as they are."""
    fresh = keep_first(new, keys, order).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(fresh, allowMissingColumns=True).select(*table.columns)


def insert_or_replace(table: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, new ones over old."""
    both = table.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.col("_n").desc(), F.col(order).desc())
    return both.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_n")


def set_columns(table: DataFrame, where: Column, values: dict[str, Column | None], allowed: set[str]) -> DataFrame:
    """Sets whitelisted columns on matching rows; a value of None leaves its column."""
    bad = set(values) - allowed
    if bad:
        raise ValueError(f"not to be set: {sorted(bad)}")
    return table.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items() if v is not None})


def create_run(runs: DataFrame, run: DataFrame) -> DataFrame:
    return insert_or_ignore(runs, run, ["run_id"], "created_at")


def set_run_status(runs: DataFrame, run_id: str, status: str, phase: int | None = None) -> DataFrame:
    return set_columns(runs, F.col("run_id") == run_id, {"status": F.lit(status), "current_phase": None if phase is None else F.lit(phase)}, {"status", "current_phase"})


def set_run_plan(runs: DataFrame, run_id: str, categories: list[str] | None = None, sites: list[str] | None = None, topic: str | None = None, options: dict | None = None) -> DataFrame:
    """Sets what is given of a run's plan; None leaves a column, an empty list empties it."""
    kinds = {f.name: f.dataType for f in runs.schema}
    listed = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    values = {
        "categories": None if categories is None else listed(categories),
        "sites": None if sites is None else listed(sites),
        "target_topic": None if topic is None else F.lit(topic),
        "options": None if options is None else F.from_json(F.lit(json.dumps(options)), kinds["options"]),
    }
    return set_columns(runs, F.col("run_id") == run_id, values, set(values))


def delete_keyword(keywords: DataFrame, canonical_id: int, keyword: str) -> DataFrame:
    return keywords.where(~((F.col("canonical_id") == canonical_id) & (F.col("keyword") == keyword)))


def refreshed(canonical: DataFrame, keywords: DataFrame, only: Column | None = None) -> DataFrame:
    """A known suggest status follows the number of keywords; a pending one stays null."""
    counts = keywords.groupBy(F.col("canonical_id").alias("id")).agg(F.count("*").alias("_n"))
    status = F.when(F.coalesce("_n", F.lit(0)) > 0, HAS).otherwise(NO)
    where = F.col("suggest_status").isNotNull() & (F.lit(True) if only is None else only)
    return canonical.join(counts, "id", "left").withColumn("suggest_status", F.when(where, status).otherwise(F.col("suggest_status"))).select(*canonical.columns)


def merge_products(canonical: DataFrame, mapping: DataFrame, keywords: DataFrame, target: int, source: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Moves members and keywords of ``source`` to ``target``; (canonical, mapping, keywords, members moved)."""
    both = {r["id"]: r for r in canonical.where(F.col("id").isin(target, source)).collect()}
    if target == source or len(both) != 2 or both[target]["run_id"] != both[source]["run_id"]:
        raise ValueError("two products of one run are needed")
    moved = mapping.where(F.col("canonical_id") == source).count()
    at = F.when(F.col("canonical_id") == source, target).otherwise(F.col("canonical_id")).cast("long")
    new_mapping = mapping.withColumn("canonical_id", at).distinct()
    top = keywords.where(F.col("canonical_id") == target).agg(F.coalesce(F.max("position"), F.lit(0))).first()[0]
    from_source = F.col("canonical_id") == source
    arriving = keywords.where(from_source).join(keywords.where(F.col("canonical_id") == target).select("keyword"), "keyword", "left_anti")
    # keywords that move lose their query and line up after the target's own
    arriving = arriving.withColumn("position", (F.lit(top) + F.row_number().over(Window.partitionBy("canonical_id").orderBy("position"))).cast("int"))
    arriving = arriving.withColumn("canonical_id", F.lit(target).cast("long")).withColumn("source_query", F.lit("")).select(*keywords.columns)
    new_keywords = keywords.where(~from_source).unionByName(arriving)
    tokens = list(dict.fromkeys([*(both[target]["entity_tokens"] or []), *(both[source]["entity_tokens"] or [])]))
    token_array = F.array(*map(F.lit, tokens)).cast("array<string>") if tokens else F.array().cast("array<string>")
    is_target = F.col("id") == target
    new_canonical = canonical.where(F.col("id") != source).withColumns({
        "entity_tokens": F.when(is_target, token_array).otherwise(F.col("entity_tokens")),
        "needs_review": F.when(is_target, False).otherwise(F.col("needs_review")),
        "merge_confidence": F.when(is_target, 1.0).otherwise(F.col("merge_confidence")),
    })
    return refreshed(new_canonical, new_keywords, F.col("id") == target), new_mapping, new_keywords, moved


def detach(canonical: DataFrame, mapping: DataFrame, raw: DataFrame, raw_id: int) -> tuple[DataFrame, DataFrame, int]:
    """Gives one member a product of its own, with its title made unique in the run; (canonical, mapping, new id)."""
    owners = [r["canonical_id"] for r in mapping.where(F.col("raw_id") == raw_id).collect()]
    row = raw.where(F.col("id") == raw_id).first()
    if not owners or row is None:
        raise ValueError("no such member")
    if mapping.where(F.col("canonical_id") == owners[0]).count() < 2:
        raise ValueError("the only member can't be detached")
    new_id = canonical.agg(F.max("id")).first()[0] + 1
    taken = {r["canonical_title"] for r in canonical.where((F.col("run_id") == row["run_id"]) & F.startswith("canonical_title", F.lit(row["raw_title"]))).select("canonical_title").collect()}
    title, n = row["raw_title"], 2
    while title in taken:
        title, n = f"{row['raw_title']} #{n}", n + 1
    record = canonical.sparkSession.createDataFrame([(new_id, row["run_id"], title, [], 1.0, True, None)], "id long, run_id string, canonical_title string, entity_tokens array<string>, merge_confidence double, needs_review boolean, suggest_status string")
    at = F.when((F.col("raw_id") == raw_id) & (F.col("canonical_id") == owners[0]), new_id).otherwise(F.col("canonical_id")).cast("long")
    return canonical.unionByName(record), mapping.withColumn("canonical_id", at), new_id


def rename(canonical: DataFrame, product: int, title: str) -> DataFrame:
    title = title.strip()
    row = canonical.where(F.col("id") == product).first()
    if not title or row is None:
        raise ValueError("a product and a title are needed")
    if not canonical.where((F.col("run_id") == row["run_id"]) & (F.col("canonical_title") == title) & (F.col("id") != product)).isEmpty():
        raise ValueError("the run has this title already")
    return set_columns(canonical, F.col("id") == product, {"canonical_title": F.lit(title)}, {"canonical_title"})


def set_review(canonical: DataFrame, product: int, flag: bool) -> DataFrame:
    return set_columns(canonical, F.col("id") == product, {"needs_review": F.lit(flag)}, {"needs_review"})


def delete_run(tables: dict[str, DataFrame], run_id: str) -> dict[str, DataFrame]:
    """All rows of a run go, with what hangs on them; the response cache stays."""
    gone = tables["canonical_products"].where(F.col("run_id") == run_id).select(F.col("id").alias("canonical_id"))
    out = {n: tables[n].where(F.col("run_id") != run_id) for n in ("runs", "raw_products", "canonical_products")}
    return tables | out | {n: tables[n].join(gone, "canonical_id", "left_anti").select(*tables[n].columns) for n in ("product_mapping", "lsi_keywords")}


def cache_key(namespace: str, params: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the namespace and the parameters as compact JSON in the order of their names."""
    return F.sha2(F.concat(F.lit(f"{namespace}:"), F.to_json(F.struct(*(F.col(c) for c in sorted(columns))))), 256)


def cached(requests: DataFrame, cache: DataFrame, now: Column, ttl_days: int | None) -> DataFrame:
    """Requests (cache_key, ..) with ``response`` (null: a miss) and ``hit``; 0 or no days never expire, nor do entries without time."""
    fresh = F.lit(True) if not ttl_days else F.coalesce(F.col("created_at") >= now - F.make_interval(days=F.lit(ttl_days)), F.lit(True))
    usable = F.try_parse_json("response").isNotNull() & (F.trim("response") != "null")
    good = cache.where(fresh & usable).select("cache_key", "response")
    return requests.join(good, "cache_key", "left").withColumn("hit", F.col("response").isNotNull())


def save(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> str:
    """Writes a snapshot beside the current one, then adds a numbered pointer to it; readers see all or nothing.

    Of two writers at once both take one number, and the greater name counts for every reader.
    """
    name = uuid.uuid4().hex
    for table, df in tables.items():
        df.write.parquet(f"{path}/snapshots/{name}/{table}")
    try:
        last = _pointers(spark, path).agg(F.max("n")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        last = 0
    spark.createDataFrame([(last + 1, name)], _POINTER).coalesce(1).write.mode("append").parquet(f"{path}/current")
    return name


def _pointers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_POINTER).parquet(f"{path}/current")


def load(spark: SparkSession, path: str, tables: list[str]) -> dict[str, DataFrame]:
    newest = _pointers(spark, path).agg(F.max(F.struct("n", "name"))["name"]).first()[0]
    return {t: spark.read.parquet(f"{path}/snapshots/{newest}/{t}") for t in tables}
