"""Topic vectors: hashed features, centroids, calibrated thresholds, best labels."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

DIM = 512


def hashed_vector(text: str, dim: int = DIM, gram: int = 3) -> list[float]:
    """Words (twice) and character grams, each at a hashed place with a hashed sign; of length 1."""
    counts: Counter[str] = Counter()
    for token in text.split():
        counts[f"w:{token}"] += 2
        padded = f" {token} "
        counts.update(f"c:{padded[i : i + gram]}" for i in range(len(padded) - gram + 1))
    out = [0.0] * dim
    for feature, n in counts.items():
        digest = hashlib.blake2b(feature.encode(), digest_size=8).digest()
        out[int.from_bytes(digest[:4], "big") % dim] += (1.0 if digest[4] & 1 else -1.0) * (1.0 + math.log(n))
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else out


@F.pandas_udf(ArrayType(DoubleType()))
def hashing_encoder(text: pd.Series) -> pd.Series:
    return text.map(lambda t: hashed_vector(t or ""))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x * x)))


def unit(v: Column) -> Column:
    """Length 1; the zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """Clamped to 0..1; a zero vector counts as of length 1."""
    size = lambda v: F.when(norm(v) > 0, norm(v)).otherwise(F.lit(1.0))
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    return F.least(F.greatest(dot / (size(a) * size(b)), F.lit(0.0)), F.lit(1.0))


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): the normalised sum of each label's vectors; partial sums by place."""
    sums = vectors.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.sum("x").alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])
    return sums.groupBy(label).agg(ordered.alias("s")).select(label, unit(F.col("s")).alias("centroid"))


def percentile(values: Column, fraction: float) -> Column:
    """Nearest rank with halves to even; 0 for none. ``values`` is an array."""
    n = F.size(values)
    at = F.greatest(F.least(F.bround(F.lit(fraction) * (n - 1)).cast("int"), n - 1), F.lit(0))
    return F.when(n > 0, F.get(F.array_sort(values), at)).otherwise(F.lit(0.0))


def calibrated(positive: Column, negative: Column) -> Column:
    """struct(relevant, review) between the lowest own and the highest foreign scores; null where they overlap."""
    low, high = percentile(positive, 0.15), percentile(negative, 0.90)
    at = lambda share, least: F.round(F.least(F.lit(0.95), F.greatest(F.lit(least), high + share * (low - high))), 4)
    return F.when(low > high, F.struct(at(0.50, 0.05).alias("relevant"), at(0.25, 0.03).alias("review")))


def best_label(scored: DataFrame, row: list[str], label: str, score: str, order: str) -> DataFrame:
    """The best label of each row; of equal scores the first in ``order``."""
    best = F.max_by(F.struct(label, score), F.struct(F.col(score), -F.col(order)))
    return scored.groupBy(*row).agg(best.alias("b")).select(*row, f"b.{label}", f"b.{score}")


def relevance(score: Column, relevant: Column, review: Column) -> Column:
    """True, null (borderline) or false."""
    return F.when(score >= relevant, F.lit(True)).when(score >= review, F.lit(None).cast("boolean")).otherwise(F.lit(False))
