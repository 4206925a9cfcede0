"""MinHash near-duplicates through an LSH forest.

Texts with equal shingle sets form a class at once. One text of each class enters the forest: TREES sorted
orders of its signature, each by DEPTH signature values. Texts that share the first LEAST values of an order form a
region. A pair of similarity 0.8 shares them in one order with probability 0.33, so all 32 orders part it with
probability 3e-6.

* Small regions, of up to SMALL texts: all pairs are candidates.
* Crowded regions: the depth adapts. In sorted order each text first meets the next NEIGHBOURS, with whom it has the
  longest common prefix, and the region's hubs, the HUBS texts closest to the majority of its sketches (copies of one
  original lie closer to it than to each other). That links a group of copies without all its pairs. Then the pairs
  of the region whose texts still lie in different components follow, without any cap. Components that meet in
  a crowded region form a family; its members are cut into blocks, and each task compares a pair of blocks, but
  never two blocks of the family's largest component. A task confirms its pairs on the sets themselves and returns
  no pairs, only links that join components: at most one for each component it holds.

Candidates pass a 128-bit sketch of the signature and are then confirmed on full shingle sets. They are confirmed by
region, so a set travels once to each region that needs it, however many pairs it has there; where many pairs are
asked, common shingles come from a product of incidence matrices. Links go to components in rounds: each text's
closest pairs first, then the closest pairs between components, then all that still cross.

Orders are cut into ranges and regions into blocks, so a hot region spreads over many tasks. A region is whole
wherever its pairs are made, whatever the Arrow batches.

Defined results: a null, empty or wordless text has 0 shingles and stays alone; a text with fewer words than a
shingle has all its words as its only shingle. ``near_duplicates`` puts a row without id in no component; ``mark``
numbers such rows, so they are judged too. Rows that repeat an id are one node. Very long texts are read whole, as blocks by themselves. Only ``key`` and ``text`` are read, so other
columns may have any name; ``mark`` passes them through. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleforge.llm.common import BROADCAST_IDS, Scratch, hashes, held, identified, lean, mixed, steps, table, tidy, utf8, without, words
from titleforge.llm.components import components

PERMUTATIONS, TREES, DEPTH, LEAST, NEIGHBOURS, SMALL, HUBS = 128, 32, 8, 5, 2, 24, 2
#: Equal bits of two 128-bit sketches, at least: 115 are expected at similarity 0.8, 96 lie 5 deviations below.
EQUAL_BITS = 96
#: Texts and shingles of a block of a family, about: what a task holds of each side at once.
BLOCK_TEXTS, BLOCK_SHINGLES = 2048, 4_000_000

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)[:, None]
_ORDER = np.stack([_rng.permutation(PERMUTATIONS)[:DEPTH] for _ in range(TREES)])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 2) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each of adjoining documents."""
    distinct, codes, first = words(data, offsets)
    word = hashes(distinct, 11)[codes] if len(codes) else np.zeros(0, np.uint64)
    chain = word.copy()
    for k in range(1, size):
        head = max(len(chain) - k, 0)
        chain[:head] = mixed(chain[:head] * np.uint64(0x9E3779B97F4A7C15) + word[k:])
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            yield np.unique(chain[a : b - size + 1])
        elif b > a:
            whole = word[a]
            for w in word[a + 1 : b]:
                whole = mixed(np.array([whole * np.uint64(3) + w]))[0]
            yield np.array([whole], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full((PERMUTATIONS, 1), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 4096):
        out = np.minimum(out, (_A * x[a : a + 4096] + _B).min(1, keepdims=True))
    return mixed(out[:, 0].astype(np.uint64) + (np.arange(PERMUTATIONS, dtype=np.uint64) << np.uint64(32)))


def keys_of(sig: np.ndarray) -> tuple[bytes, bytes]:
    """All orders' keys, one after the other, and the sketch of one bit a value."""
    return (sig >> np.uint64(48)).astype(">u2")[_ORDER].tobytes(), np.packbits((sig & np.uint64(1)).astype(np.uint8)).tobytes()


def signatures(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, n, f1, f2, keys, sketch): set size, a 128-bit fingerprint of the set, and the forest's entries."""
    names = ["id", "n", "f1", "f2", "keys", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in steps(offsets):
                n, f1, f2, keys, sketch = [], [], [], [], []
                for s in shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size):
                    n.append(len(s))
                    f1.append(int(s.sum(dtype=np.uint64)))
                    f2.append(int(mixed(s ^ np.uint64(0xABCDEF)).sum(dtype=np.uint64)))
                    k, b = keys_of(signature(s)) if len(s) else (None, None)
                    keys.append(k)
                    sketch.append(b)
                wide = [pa.array(np.array(f, np.uint64).view(np.int64)) for f in (f1, f2)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(n, pa.int64()), *wide, pa.array(keys, pa.binary()), pa.array(sketch, pa.binary())], names)

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(tidy(run), f"id {kind}, n long, f1 long, f2 long, keys binary, sketch binary")


def _passed(ids: np.ndarray, n: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs pass the sketches and the sizes of their sets; and their equal bits."""
    same = 128 - np.bitwise_count(bits[i] ^ bits[j]).sum(1).astype(np.int64)
    return (ids[i] != ids[j]) & (same >= EQUAL_BITS) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])), same


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def _bits(table: pa.Table) -> np.ndarray:
    return utf8(table.column("sketch"))[0].view(np.uint64).reshape(-1, 2)


def _candidates(a: np.ndarray, b: np.ndarray, near: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(near), pa.array(part)], ["a", "b", "near", "part"])


def _schema(entries: DataFrame) -> str:
    kind = dict(entries.dtypes)["id"]
    return f"a {kind}, b {kind}, near long, part long"


def _whole(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables that never part rows with equal values of ``column``, by which the rows come sorted."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        value = batch.column(column).to_numpy()
        last = int(np.flatnonzero(value[1:] != value[:-1])[-1]) + 1 if (value[1:] != value[:-1]).any() else 0
        if kept and (last or kept[-1].column(column)[-1].as_py() != value[0]):
            head = batch.slice(0, last) if kept[-1].column(column)[-1].as_py() == value[0] else batch.slice(0, 0)
            yield pa.Table.from_batches([*kept, head]).combine_chunks()
            kept, batch = [], batch.slice(len(head))
            last -= len(head)
        if last > 0:
            yield pa.Table.from_batches([batch.slice(0, last)])
        kept.append(batch.slice(max(last, 0)))
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def _all_pairs(small: DataFrame, percent: int) -> DataFrame:
    """(a, b, near, part) of all pairs of small regions, in frames sorted by region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, "region"):
            (region, ids, n), bits = _columns(rows, "region", "id", "n"), _bits(rows)
            for j in range(1, len(region)):
                at = np.flatnonzero(region[:-j] == region[j:])
                if not len(at):
                    break
                ok, same = _passed(ids, n, bits, at, at + j, percent)
                yield _candidates(ids[at[ok]], ids[at[ok] + j], same[ok], region[at[ok]])

    return small.mapInArrow(tidy(run), _schema(small))


def _neighbours(crowded: DataFrame, percent: int) -> DataFrame:
    """(a, b, near, part) of neighbours, and of the hubs of each stretch of a region that a batch holds.

    Frames come sorted by (tree, key, id). Pairs with hubs count as nearer than any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            rows = (now if tail is None else pa.concat_tables([tail, now])).combine_chunks()
            (region, ids, n), bits = _columns(rows, "region", "id", "n"), _bits(rows)
            found = []
            for j in range(1, min(NEIGHBOURS, len(ids) - 1) + 1):
                at = np.flatnonzero(region[:-j] == region[j:])
                found.append((at, at + j, np.zeros(len(at), np.int64)))
            starts = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
            for lo, hi in zip(starts, np.append(starts[1:], len(ids)), strict=True):
                if hi - lo > NEIGHBOURS + 1:
                    flat = np.unpackbits(bits[lo:hi].view(np.uint8), axis=1)
                    majority = (2 * flat.sum(0, dtype=np.int64) > len(flat)).astype(np.uint8)
                    hubs = np.argsort((flat != majority).sum(1), kind="stable")[:HUBS]
                    i, j = np.tile(np.arange(lo, hi), len(hubs)), np.repeat(hubs + lo, hi - lo)
                    found.append((i[i != j], j[i != j], np.full(int((i != j).sum()), 128)))
            if found:
                i, j, hub = (np.concatenate(x) for x in zip(*found, strict=True))
                ok, same = _passed(ids, n, bits, i, j, percent)
                yield _candidates(ids[i[ok]], ids[j[ok]], same[ok] + hub[ok], region[i[ok]])
            tail = rows.slice(max(0, len(rows) - NEIGHBOURS))

    return crowded.mapInArrow(tidy(run), _schema(crowded))


def sets_of(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in steps(offsets):
                sets = list(shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size))
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                flat = np.concatenate(sets).view(np.int64)
                for a in range(0, hi - lo, 256):
                    b = min(a + 256, hi - lo)
                    yield pa.RecordBatch.from_arrays([batch.column(0)[lo + a : lo + b], pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]).astype(np.int32)), pa.array(flat[ends[a] : ends[b]]))], ["id", "s"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(tidy(run), f"id {kind}, s array<long>")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set, by products of incidence matrices."""
    flat, owner = [], []
    for sets in (left, right):
        x, y = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(x, kind="stable")
        flat.append(x[order])
        owner.append(y[order])
    both = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(both), 4096):
        some, part = both[lo : lo + 4096], []
        for x, y, n in zip(flat, owner, out.shape, strict=True):
            a, b = np.searchsorted(x, some[0]), np.searchsorted(x, some[-1], "right")
            column = np.minimum(np.searchsorted(some, x[a:b]), len(some) - 1)
            ok = some[column] == x[a:b]
            part.append(np.zeros((n, len(some)), np.float32))
            part[-1][y[a:b][ok], column[ok]] = 1
        out += part[0] @ part[1].T
    return out.astype(np.int64)


def _shared(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``left[i]`` and ``right[j]``, each pair by itself or all by products."""
    (rows, x), (columns, y) = (np.unique(k, return_inverse=True) for k in (i, j))
    if 12 * len(i) > len(rows) * len(columns) and len(i) > 16:
        return _common([left[k] for k in rows], [right[k] for k in columns])[x, y]
    return np.array([np.intersect1d(left[p], right[q], assume_unique=True).size for p, q in zip(i, j, strict=True)], np.int64)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have at least ``percent`` of their union in common, by ``part``."""
    kind = dict(pairs.dtypes)["a"]
    need = pairs.select("part", F.explode(F.array("a", "b")).alias("id")).distinct()
    shipped = need.join(sets, "id").select("part", F.lit(0).alias("what"), F.col("id").alias("a"), F.lit(None).cast(kind).alias("b"), "s")
    asked = pairs.select("part", F.lit(1).alias("what"), "a", "b", F.lit(None).cast("array<long>").alias("s"))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = shipped.unionByName(asked).repartition(parts, "part").sortWithinPartitions("part", "what")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, {}
        for batch in batches:
            part, what, a = (batch.column(c).to_numpy() for c in ("part", "what", "a"))
            lists = batch.column("s")
            flat, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            cuts = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (what[1:] != what[:-1]))) if len(part) else part
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True):
                if part[lo] != now:
                    now, own = part[lo], {}
                if what[lo] == 0:
                    own |= {a[i]: flat[ends[i] : ends[i + 1]].copy() for i in range(lo, hi)}
                    continue
                x, y = a[lo:hi], batch.column("b").slice(lo, hi - lo).to_numpy()
                known = np.sort(np.fromiter(own, x.dtype, len(own)))
                sets = [own[i] for i in known]
                i, j = np.searchsorted(known, x), np.searchsorted(known, y)
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                k = _shared(sets, sets, i, j)
                ok = 100 * k >= percent * (size[i] + size[j] - k)
                yield pa.RecordBatch.from_arrays([pa.array(x[ok]), pa.array(y[ok])], ["a", "b"])

    return both.mapInArrow(tidy(run), f"a {kind}, b {kind}").distinct()


def _labelled(rest: DataFrame, label: DataFrame, *ends: str) -> DataFrame:
    """Adds each end's component; a node without links is its own."""
    for end in ends:
        rest = rest.drop(f"c{end}").join(label.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return rest


def _linked(label: DataFrame, rest: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Components after the pairs (a, b, near, part) are confirmed too: the closest between components, then all that still cross."""
    for last in (False, True):
        label = scratch.save(label)
        rest = scratch.save(_labelled(rest, label, "a", "b").where("ca <> cb").select("a", "b", "near", "part", "ca", "cb"))
        if rest.isEmpty():
            break
        chosen = rest
        if not last:
            sides = (F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y"))
            chosen = scratch.save(rest.groupBy(*sides).agg(F.max_by(F.struct("a", "b", "part"), F.struct("near", -F.col("a"), -F.col("b"))).alias("p")).select("p.a", "p.b", "p.part"))
        more = scratch.save(confirmed(chosen, sets, percent))
        old = label.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        label = components(old.unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v"))), scratch)
        rest = rest.join(chosen.select("a", "b"), ["a", "b"], "left_anti")
    return label


def _spanning(u: np.ndarray, v: np.ndarray) -> list[int]:
    """Which of the links (u, v) join what those before left apart."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            kept.append(k)
    return kept


def _families(crowded: DataFrame, label: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(id, n, sketch, c, family): texts of crowded regions that hold more than one component; null without any."""
    within = scratch.save(_labelled(crowded.select("region", "id", "n", "sketch"), label, "id").withColumnRenamed("cid", "c"))
    mixed_up = scratch.save(within.groupBy("region").agg(F.min("c").alias("v"), F.max("c").alias("w")).where("v <> w").select("region", "v"))
    count = mixed_up.count()
    if not count:
        return None
    within = scratch.save(within.join(F.broadcast(mixed_up) if count <= BROADCAST_IDS else mixed_up, "region"))
    family = components(within.select(F.col("c").alias("u"), "v").distinct(), scratch).withColumnsRenamed({"node": "c", "component": "family"})
    return scratch.save(within.groupBy("id").agg(*(F.min(x).alias(x) for x in ("n", "sketch", "c"))).join(family, "c"))


def _crossing(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join the components of each family wherever two of its texts are similar enough."""
    kind = dict(members.dtypes)["id"]
    sizes = members.groupBy("family", "c").agg(F.count("*").alias("k"), F.sum("n").alias("m"))
    sizes = sizes.groupBy("family").agg(F.max_by(F.struct("c", "k", "m"), F.struct("k", "c")).alias("main"), F.sum("k").alias("k"), F.sum("m").alias("m"))
    blocks = lambda k, m: F.ceil(F.greatest(k / BLOCK_TEXTS, m / BLOCK_SHINGLES)).cast("int")
    sizes = scratch.save(sizes.select("family", F.col("main.c").alias("main"), blocks(F.col("main.k"), F.col("main.m")).alias("p"), blocks(F.col("k") - F.col("main.k"), F.col("m") - F.col("main.m")).alias("q")))
    # blocks 0 to p - 1 hold the largest component, p to p + q - 1 the others; two of the first are never compared
    spot = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    placed = members.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_IDS else sizes, "family")
    placed = placed.withColumn("block", F.when(F.col("c") == F.col("main"), spot(F.col("p"))).otherwise(F.col("p") + spot(F.col("q"))))
    others = F.sequence(F.when(F.col("c") == F.col("main"), F.col("p")).otherwise(0), F.col("p") + F.col("q") - 1)
    dealt = placed.join(sets, "id").withColumn("with", F.explode(others)).select(F.xxhash64("family", F.least("block", "with"), F.greatest("block", "with")).alias("part"), "block", "with", "id", "n", "sketch", "c", "s")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, "part"):
            (part, block, other, ids, n, c), bits = _columns(rows, "part", "block", "with", "id", "n", "c"), _bits(rows)
            lists = rows.column("s").combine_chunks()
            flat, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            for lo, hi in zip(starts, np.append(starts[1:], len(part)), strict=True):
                left = np.arange(lo, hi)[block[lo:hi] <= other[lo:hi]]
                right = np.arange(lo, hi)[block[lo:hi] >= other[lo:hi]]
                own, links = [[flat[ends[k] : ends[k + 1]] for k in side] for side in (left, right)], []
                for x in range(0, len(left), 256):
                    i, j = np.repeat(np.arange(x, min(x + 256, len(left))), len(right)), np.tile(np.arange(len(right)), min(256, len(left) - x))
                    # inside one block each pair comes twice
                    ok = (c[left[i]] != c[right[j]]) & ((block[left[i]] != block[right[j]]) | (ids[left[i]] < ids[right[j]]))
                    i, j = i[ok], j[ok]
                    ok = _passed(ids, n, bits, left[i], right[j], percent)[0]
                    i, j = i[ok], j[ok]
                    if len(i):
                        k = _shared(*own, i, j)
                        ok = 100 * k >= percent * (n[left[i]] + n[right[j]] - k)
                        links.append((left[i[ok]], right[j[ok]]))
                if links:
                    a, b = (np.concatenate(side) for side in zip(*links, strict=True))
                    kept = _spanning(c[a], c[b])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a[kept]]), pa.array(ids[b[kept]])], ["a", "b"])

    return dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(tidy(run), f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) of each row; computed, and held in the checkpoint folder."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = lambda df, n: F.broadcast(df) if n <= BROADCAST_IDS else df
    source = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t"))
    with Scratch(spark) as scratch:
        sig = scratch.save(signatures(source, "id", "t", size))
        classes = sig.where("n > 0 and id is not null").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"))
        # one row of each class carries the forest's entries
        reps = sig.where("n > 0").join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"])
        cut = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substring("keys", t * (2 * DEPTH) + 1, F.lit(2 * DEPTH)).alias("key")))
        entries = scratch.save(reps.select("id", "n", "keys", "sketch")).select("id", "n", "sketch", F.explode(cut).alias("e"))
        entries = entries.select(F.xxhash64("e.tree", F.substring("e.key", 1, 2 * LEAST)).alias("region"), F.col("e.tree").alias("tree"), F.col("e.key").alias("key"), "id", "n", "sketch")
        hot = scratch.save(entries.groupBy("region").count().where(F.col("count") > SMALL).select("region"))
        many = hot.count()
        small = entries.select("region", "id", "n", "sketch").join(few(hot, many), "region", "left_anti")
        pairs = _all_pairs(small.repartition(4 * parts, "region").sortWithinPartitions("region"), percent)
        crowded = None
        if many:
            crowded = scratch.save(entries.join(few(hot, many), "region", "left_semi"))
            pairs = pairs.unionByName(_neighbours(crowded.repartitionByRange(4 * parts, "tree", "key", "id").sortWithinPartitions("tree", "key", "id"), percent))
        pairs = scratch.save(pairs.groupBy("a", "b").agg(F.max("near").alias("near"), F.min("part").alias("part")))

        def sets(ids: DataFrame) -> DataFrame:
            """Sets by id. Rows that repeat an id: one of them stands for it, as one does above."""
            return scratch.save(sets_of(source.join(few(ids, ids.count()), "id", "left_semi"), "id", "t", size)).dropDuplicates(["id"])

        # first each text's closest two pairs
        ends = pairs.select("a", "b", "near", "part", F.explode(F.array("a", "b")).alias("end"))
        pair = F.struct("a", "b", "part")
        best = F.max_by(pair, F.struct("near", -F.col("a"), -F.col("b")))
        low = F.max_by(pair, F.struct(F.col("a") * -1, "near"))
        chosen = scratch.save(ends.groupBy("end").agg(F.array(best, low).alias("p")).select(F.explode("p").alias("p")).select("p.a", "p.b", "p.part").distinct())
        own = sets(scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
        links = scratch.save(confirmed(chosen, own, percent))
        label = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
        label = scratch.save(_linked(label, pairs.join(chosen, ["a", "b"], "left_anti"), own, percent, scratch))
        # pairs of crowded regions that are neither neighbours nor of a hub
        members = _families(crowded, label, scratch) if many else None
        if members is not None:
            links = _crossing(members, sets(members.select("id")), percent, scratch)
            old = label.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
            label = components(old.unionByName(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), scratch)
        out = (
            sig.select("id", "n", "f1", "f2")
            .join(classes, ["n", "f1", "f2"], "left")
            .join(label.select(F.col("node").alias("rep"), "component"), "rep", "left")
            .select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))
        )
        return held(out)


def mark(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay: one of each component (its smallest id), with all their columns.

    Rows without id are told by numbers above all ids, so they go where a row with id stands for them.
    """
    rows, told = identified(docs, key)
    found = near_duplicates(rows, told, text, size, percent)
    return without(rows, found.where(F.col(told) != F.col("component_id")).select(told).distinct(), told).select(*docs.columns)


def op10_minhash_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean(spark)
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP10_SQL = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) = 1 then [ws[1]] else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
e as (select a, b from c join n p on p.doc_id = a join n q on q.doc_id = b where 100 * k >= 80 * (p.n + q.n - k)),
u as (select a, b from e union all select b, a from e),
r as (select doc_id as node, doc_id as label from documents union select u.b, r.label from r join u on u.a = r.node)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id, d.doc_id = m.component_id as kept
from documents d left join n using (doc_id) join (select node, min(label) as component_id from r group by node) m on m.node = d.doc_id
"""
