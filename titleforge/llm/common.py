"""Shared pieces: table access, scratch storage, and Arrow-level splitting of texts into words.

Every helper that handles text works on Arrow buffers with numpy, so no Python object exists per word.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

pa.set_memory_pool(pa.system_memory_pool())  # freed buffers can go back to the system

#: Bytes of text that one numpy step handles; a longer document is a step by itself.
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset (tests), a temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-scratch-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class Scratch:
    """Tables written for the time of one ``with`` block in the shared folder.

    They cut lineage like a checkpoint, but compressed and column-wise. What outlives the block must be
    made with :func:`held`, whose files Spark's own cleaner drops with the last frame that uses them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        for name in self.tables:
            self.spark.sql(f"drop table if exists {name}")
        self.drop(self.root)

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count}"

    def drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def bucketed(self, df: DataFrame, column: str, buckets: int) -> DataFrame:
        """A table in the shared warehouse whose joins by ``column`` need no shuffle of it."""
        self.tables.append(f"llm_{uuid.uuid4().hex}")
        df.write.option("compression", "zstd").bucketBy(buckets, column).sortBy(column).saveAsTable(self.tables[-1])
        return self.spark.table(self.tables[-1])

    def save(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Ids that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def identified(docs: DataFrame, key: str) -> tuple[DataFrame, str]:
    """Documents and a column that identifies every row: ``key``, or where some rows lack it, one that numbers those.

    The numbers lie above all ids, so a row without id never stands for one with it. They are held, as a second
    reading may deal rows out otherwise. Rows of a key that isn't a whole number can't be numbered.
    """
    if dict(docs.dtypes)[key] not in ("bigint", "int", "smallint", "tinyint") or docs.where(F.col(key).isNull()).isEmpty():
        return docs, key
    top = docs.agg(F.max(key)).first()[0]
    name = next(f"_row{i}" for i in range(len(docs.columns) + 1) if f"_row{i}" not in docs.columns)
    return held(docs.withColumn(name, F.coalesce(F.col(key).cast("long"), F.lit(1 + max(0, top or 0)) + F.monotonically_increasing_id()))), name


def without(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose id isn't among ``ids``; rows without id stay. Texts stay in place while the ids are few."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(ids, key, "left_anti").select(*docs.columns)


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on after its task, beside an executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a GNU C library
        pass


def tidy(run: Callable, forget: Callable[[], None] | None = None) -> Callable:
    """``run`` over Arrow batches; at the task's end the worker keeps neither caches nor freed memory."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if forget:
                forget()
            give_back()

    return whole


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ``n + 1`` offsets of a string or binary column; nulls are empty."""
    give_back()  # what the batch before took
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type) or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows of (key, text) batches in tables of about ``most`` bytes of text, whatever the batches; a longer text is alone."""
    kept: list[pa.RecordBatch] = []
    room = most
    for batch in batches:
        _, offsets = utf8(batch.column(1))
        lo, n = 0, len(batch)
        while lo < n:
            hi = min(int(np.searchsorted(offsets, offsets[lo] + room, "right")) - 1, n)
            if hi > lo:
                kept.append(batch.slice(lo, hi - lo))
                room -= int(offsets[hi] - offsets[lo])
            elif not kept:  # one text that is longer than a table
                hi = lo + 1
                kept.append(batch.slice(lo, 1))
            if hi < n:
                yield pa.Table.from_batches(kept).combine_chunks()
                kept, room = [], most
            lo = max(hi, lo)
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def lean(spark: SparkSession, most: str = "16m") -> None:
    """Arrow batches of texts small enough that their buffers beside the heap stay small; of rows longer than ``most``, one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """A binary array over adjoining pieces of ``data``."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of adjoining documents.

    Returns the distinct words, the index of each occurrence in them, and each document's first occurrence
    (``n + 1`` offsets). Only A-Z are lower-cased.
    """
    solid = ~_SPACE[data]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = solid[first]
    kept = data[solid]
    if lower:
        kept = _LOWER[kept]
    spans = np.append(np.flatnonzero(starts[solid]), len(kept))
    found = binary(spans, kept).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(np.flatnonzero(starts), offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of a binary array's values."""
    import xxhash

    one = xxhash.xxh3_64_intdigest
    return np.fromiter((one(w, seed) for w in distinct.to_pylist()), np.uint64, len(distinct))


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves remainder 0 by 5; such rows never teach a model."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
