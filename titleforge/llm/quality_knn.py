"""Nearest-neighbour quality voting in a latent-semantic space.

Texts become hashed counts of words, word shapes and shape pairs, weighted by the inverse document
frequencies of the whole corpus. A truncated singular value decomposition of a bounded labelled sample
gives the latent axes. Each document is held against every labelled vector, in blocks of exact cosine
products, and its nearest neighbours' labels are averaged by similarity.

Bounds: ``per_class`` labelled rows a class (those with the smallest hash of their id) and ``DIMS`` features,
so the broadcast model is at most 2 * per_class * rank + DIMS * rank floats, whatever the corpus. Corpus
statistics and scores cover every document and every word.

Defined results: a null, empty or wordless text has the zero vector, similarity 0 to all, and scores the
sample's mean label. Without any labelled row all score 0.5. Repeated rows are scored one by one; ties in
similarity go to the earlier labelled row; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleforge.llm.common import held_out, lean, mixed, steps, table, tidy, utf8, words

#: Hashed dimensions: shapes, shape pairs, words, and one for words that repeat the one before.
SHAPES, PAIRS, WORDS = 512, 1536, 2048
DIMS = SHAPES + PAIRS + WORDS
_CLASS = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


#: Hashes of (shape, word) by raw word; emptied when full, so its memory is bounded.
_known: dict[bytes, tuple[int, int]] = {}
_MOST_KNOWN = 100_000


def _word_hashes(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if len(_known) > _MOST_KNOWN:
        _known.clear()
    one = xxhash.xxh3_64_intdigest
    raw = distinct.to_pylist()
    for w in raw:
        if w not in _known:
            _known[w] = (one(_RUNS.sub(rb"\1", w.translate(_CLASS)), 1), one(w.lower(), 2))
    both = np.array([_known[w] for w in raw], np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _forget() -> None:
    _known.clear()


def features(data: np.ndarray, offsets: np.ndarray, chunk: int = 192) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of adjoining documents and their dense counts (documents x DIMS)."""
    distinct, codes, first = words(data, offsets, lower=False)
    n = len(offsets) - 1
    shapes, hashed = _word_hashes(distinct)
    of_shape = (shapes % np.uint64(SHAPES - 1) + np.uint64(1)).astype(np.int64)
    of_word = (hashed % np.uint64(WORDS)).astype(np.int64) + SHAPES + PAIRS
    for lo in range(0, n, chunk):
        hi = min(lo + chunk, n)
        got = codes[first[lo] : first[hi]]
        row = np.repeat(np.arange(hi - lo) * DIMS, np.diff(first[lo : hi + 1]))
        same = row[1:] == row[:-1]
        shape = shapes[got]
        pair = (mixed(shape[:-1] * np.uint64(0x9E3779B97F4A7C15) + shape[1:]) % np.uint64(PAIRS)).astype(np.int64) + SHAPES
        again = row[1:][same & (got[1:] == got[:-1])]
        keys = np.concatenate([row + of_shape[got], (row[1:] + pair)[same], row + of_word[got], again])
        yield lo, hi, np.bincount(keys, minlength=(hi - lo) * DIMS).reshape(hi - lo, DIMS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Square roots of frequencies times idf; shapes, pairs and words each scaled to a length of their own."""
    out = np.sqrt(counts, dtype=np.float32)
    for lo, hi, weight in ((0, SHAPES, 1.0), (SHAPES, SHAPES + PAIRS, 1.0), (SHAPES + PAIRS, DIMS, 0.25)):
        part = out[:, lo:hi]
        part *= idf[lo:hi]
        norm = np.sqrt((part * part).sum(1, keepdims=True))
        part *= weight / np.maximum(norm, 1e-9)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def axes(x: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors by subspace iteration."""
    rng = np.random.default_rng(seed)
    q = rng.standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :rank].astype(np.float32)


class Model:
    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray, k: int):
        self.idf, self.basis, self.vectors, self.labels, self.k = idf.astype(np.float32), basis, vectors, labels, k

    def vote(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        close = unit(rows @ self.basis) @ self.vectors.T
        k = min(self.k, close.shape[1])
        # ties go to the earlier labelled row
        order = np.argpartition(-close.astype(np.float64) + np.arange(close.shape[1]) * 1e-12, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(close, order, 1), 0).astype(np.float64) ** 4
        total = weight.sum(1)
        mean = float(self.labels.mean())
        return np.where(total > 0, (weight * self.labels[order]).sum(1) / np.maximum(total, 1e-300), mean)


def fit(rows: np.ndarray, labels: np.ndarray, idf: np.ndarray, rank: int = 48, k: int = 15) -> Model:
    if not len(labels):
        return Model(idf, np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), k)
    basis = axes(rows, min(rank, len(rows)))
    return Model(idf, basis, unit(rows @ basis).astype(np.float32), labels.astype(np.float64), k)


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """How many of all documents have each feature, and how many documents there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            n += len(offsets) - 1
            for lo, hi in steps(offsets):
                for _, _, counts in features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]):
                    total += np.count_nonzero(counts, axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": np.append(np.arange(DIMS), DIMS), "n": np.append(total, n)})

    sums = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(tidy(count, _forget), "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(DIMS, np.int64), 0
    for r in sums:
        if r["dim"] == DIMS:
            n = r["n"]
        else:
            df[r["dim"]] = r["n"]
    return df, n


def train(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", per_class: int = 2048, k: int = 15) -> Model:
    """Fits on at most ``per_class`` labelled, not held-out rows a class; ``docs`` gives the corpus statistics."""
    df, n = document_frequencies(docs, text)
    idf = np.log((1 + n) / (1 + df)) + 0.1
    idf[0] = idf[:SHAPES].max()
    eligible = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    chosen = {}
    for value in (0, 1):
        for r in eligible.where(F.col("y") == value).orderBy(F.xxhash64("k"), "k").limit(per_class).collect():
            chosen.setdefault(r["k"], value)
    if not chosen:
        return fit(np.zeros((0, DIMS), np.float32), np.zeros(0), idf)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0)
            for lo, hi in steps(offsets):
                for a, b, counts in features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]):
                    cells = [np.flatnonzero(row) for row in counts]
                    yield pa.RecordBatch.from_pydict({"k": ids[lo + a : lo + b], "dims": [c.astype("<u2").tobytes() for c in cells], "counts": [row[c].astype("<f4").tobytes() for c, row in zip(cells, counts, strict=True)]})

    kind = dict(docs.dtypes)[key]
    wanted = docs.sparkSession.createDataFrame([(x,) for x in chosen], f"k {kind}")
    picked = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(F.broadcast(wanted), "k").mapInArrow(tidy(sparse, _forget), f"k {kind}, dims binary, counts binary").collect()
    picked = sorted({r["k"]: r for r in sorted(picked, key=lambda r: (r["k"], bytes(r["dims"]), bytes(r["counts"])), reverse=True)}.values(), key=lambda r: r["k"])
    counts = np.zeros((len(picked), DIMS), np.float32)
    for row, r in zip(counts, picked, strict=True):
        row[np.frombuffer(r["dims"], "<u2")] = np.frombuffer(r["counts"], "<f4")
    rows = weighted(counts, idf.astype(np.float32))
    return fit(rows, np.array([chosen[r["k"]] for r in picked]), idf, k=k)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Adds the vote, from 0 to 1, of each document's nearest labelled neighbours."""
    keep = [c for c in docs.columns if c != into]
    schema = docs.select(*keep).schema.add(into, "double")
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            out = np.zeros(len(offsets) - 1)
            for lo, hi in steps(offsets):
                for a, b, counts in features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]):
                    out[lo + a : lo + b] = model.vote(weighted(counts, model.idf))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*keep, into])

    return docs.select(*keep).mapInArrow(tidy(run, _forget), schema)


#: The score from which a document counts as good.
THRESHOLD = 0.3


def op9_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), "quality")
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
