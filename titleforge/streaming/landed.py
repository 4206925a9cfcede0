"""Pages that land continuously: the same transforms in micro-batches. An extension, not parity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleforge.functions import html as H


def titles(pages: DataFrame) -> DataFrame:
    """(url, domain, title) of pages with a title, of any frame, streaming or not."""
    out = H.with_title(pages, F.col("html")).select("url", H.domain_of(F.col("url")).alias("domain"), "title")
    return out.where("title <> ''")


def start(spark: SparkSession, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None], once: bool = True):
    """Streams landed Parquet pages; each URL passes once a day of landing."""
    pages = spark.readStream.schema("url string, html string, landed timestamp").parquet(path)
    fresh = pages.withWatermark("landed", "1 day").dropDuplicatesWithinWatermark(["url"])
    writer = titles(fresh).writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if once else writer).start()
