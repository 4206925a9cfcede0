"""Schemas of the state tables, and readers that add what an older table lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_DDL = {
    "runs": "run_id string, target_topic string, created_at timestamp, status string, current_phase int, categories array<string>, sites array<string>, options struct<max_products_per_site:int,require_product_signals:boolean,js:boolean>",
    "raw_products": "id long, run_id string, source_domain string, source_url string, raw_title string, normalized_title string, topic_score double, is_relevant boolean, category string",
    "canonical_products": "id long, run_id string, canonical_title string, entity_tokens array<string>, merge_confidence double, needs_review boolean, suggest_status string",
    "product_mapping": "raw_id long, canonical_id long",
    "lsi_keywords": "id long, canonical_id long, keyword string, position int, source_query string",
    "api_cache": "cache_key string, response string, created_at timestamp",
}
KEYS = {"runs": ["run_id"], "raw_products": ["run_id", "source_url"], "canonical_products": ["run_id", "canonical_title"], "product_mapping": ["raw_id", "canonical_id"], "lsi_keywords": ["canonical_id", "keyword"], "api_cache": ["cache_key"]}


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])


def reconciled(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the table's columns, missing ones as nulls, in order."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)))


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return reconciled(spark.read.parquet(f"{path}/{name}"), name)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], _DDL[name])


def structured(text, ddl: str):
    """JSON text as a list or object; malformed text and other kinds give an empty one."""
    got = F.from_json(text, ddl)
    if ddl.startswith("array"):
        return F.coalesce(F.when(F.ltrim(text).startswith("["), got), F.array().cast(ddl))
    return got
