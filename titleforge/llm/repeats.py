"""Removal of repeated byte strings by prefix-free parsing.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier in the corpus (a smaller id, or the
same document and an earlier place). Strings never cross documents and are judged on the input.

Parsing. Every LENGTH-byte window has one trigger: its leftmost place of least rolling hash over GRAM bytes.
(A trigger by remainder would leave some windows without any.) Neighbouring windows with one trigger form a
phrase, which reaches over all their bytes, so phrases overlap by LENGTH - 1 bytes and no window reaches beyond its
phrase. A trigger depends on its window's bytes alone, so equal windows lie in phrases with equal triggers.

Dictionary and parse. The parse lists the corpus's phrases by place. Ordered by phrase, then by place (its suffix
array; as no window reaches into the next phrase, one phrase is all the depth it needs), it tells the first place of
each distinct phrase: all windows at its other places repeat. The dictionary keeps each distinct phrase once. Phrases
that share no trigger with another are done: their windows stand nowhere else. The rest, at the edges of
repeated passages, meet in the bucket of their trigger, where a suffix array of their letters, by prefix doubling up
to LENGTH letters, orders all their suffixes. Suffixes of the dictionary that agree on LENGTH letters are one
window; combined with the places of the parse that is the corpus order of the windows, and all but the first repeat.

Documents travel in packed blocks. A block sends the hashes of its distinct phrases, sorted, to buckets that are ranges
of the trigger's hash, then the letters of those phrases that must be told apart, and gets small answers back; so
a passage that a third of all documents share weighs as one phrase a block. A phrase is told from others by 128 bits,
its windows by their letters. The number of buckets follows ``spark.sql.shuffle.partitions``, without a limit.

Defined results: null and empty texts, and texts under LENGTH bytes, keep all their bytes. Rows that repeat an id
count as later ones in the order they are read. Rows without id come last. A very long text is a block by itself, of
any length. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleforge.llm.common import Scratch, gathered, held, lean, mixed, table, tidy, utf8

LENGTH, GRAM = 100, 32
BLOCK_BYTES = 2 << 20
#: Letters of a bucket that are sorted at once, about; phrases of one trigger stay together.
MOST_LETTERS = 4 << 20
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(99)
_TABLE = _rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64)[0] * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _powers.append(np.cumprod(x, dtype=np.uint64))
    return _powers


def _forget() -> None:
    _powers.clear()


class Hashes:
    """Rolling hashes of any stretches of a block."""

    def __init__(self, data: np.ndarray):
        powers, self.inverse = _powers_to(max(len(data) + 1, BLOCK_BYTES + 1))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours: least from block starts and to block ends."""
    n = len(x) - width + 1
    pad = -len(x) % width
    y = np.append(x, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))).reshape(-1, width)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


#: Windows whose triggers are looked for at once; places inside so many fit the low bits.
_STRETCH = 1 << 27


def _triggers(gram: np.ndarray) -> np.ndarray:
    """The place of each window's least gram; of equal ones the leftmost."""
    width, low = LENGTH - GRAM + 1, np.uint64((1 << 28) - 1)
    out = np.empty(len(gram) - width + 1, np.int64)
    for a in range(0, len(out), _STRETCH):
        some = gram[a : a + _STRETCH + width - 1]
        out[a : a + _STRETCH] = a + (_sliding_least((some & ~low) | np.arange(len(some), dtype=np.uint64), width) & low).astype(np.int64)
    return out


class Parse:
    """Phrases of a block, and which of them stand first in the block.

    ``order``: one phrase for each distinct (trigger, phrase), sorted; ``same``: each phrase's place in it.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray):
        self.data, self.offsets = data, offsets
        lengths = np.diff(offsets)
        empty = np.zeros(0, np.int64)
        self.first = self.last = self.doc = self.order = self.same = empty
        self.h = self.x = np.zeros(0, np.uint64)
        if len(data) < LENGTH or lengths.max(initial=0) < LENGTH:
            return
        self.hashes = Hashes(data)
        gram = self.hashes.grams(GRAM)
        trigger = _triggers(gram)
        inside = np.zeros(len(trigger) + 1, np.int64)
        long = lengths >= LENGTH
        np.add.at(inside, offsets[:-1][long], 1)
        np.add.at(inside, offsets[1:][long] - LENGTH + 1, -1)
        windows = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        got = trigger[windows]
        # a phrase ends where the trigger changes or windows stop adjoining
        cut = np.flatnonzero(np.append(True, (got[1:] != got[:-1]) | (windows[1:] != windows[:-1] + 1)))
        self.first, self.last = windows[cut], windows[np.append(cut[1:], len(windows)) - 1]
        self.doc = np.searchsorted(offsets, self.first, "right") - 1
        # least hashes are small: mixed anew, they fill all buckets alike
        self.h = mixed(gram[got[cut]])
        self.x = self.hashes.of(self.first, self.last + LENGTH) ^ mixed((got[cut] - self.first).astype(np.uint64))
        self.ids = ids[self.doc]
        rank = np.lexsort((self.first, self.ids, self.x, self.h))
        new = np.append(True, (self.h[rank][1:] != self.h[rank][:-1]) | (self.x[rank][1:] != self.x[rank][:-1]))
        self.order = rank[new]
        self.same = np.empty(len(rank), np.int64)
        self.same[rank] = np.cumsum(new) - 1


def _pack(*columns: np.ndarray) -> bytes:
    import zstandard

    n = len(columns[0])
    flat = [np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(n, 8).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", n) + b"".join(flat))


def _unpack(blob: bytes, width: int) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<I", raw)[0]
    planes = np.frombuffer(raw, np.uint8, offset=4).reshape(width, 8, n)
    return [np.ascontiguousarray(p.T).view("<u8").reshape(-1) for p in planes]


def _deltas(x: np.ndarray) -> np.ndarray:
    """Sorted numbers as differences: their high bytes are zeros."""
    return np.diff(x.astype(np.uint64), prepend=np.uint64(0))


_MESSAGE = "block long, bucket int, kind int, body binary"
_NAMES = ["block", "bucket", "kind", "body"]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
TEXT, PHRASES, LETTERS = 0, 1, 2


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets, ranges of 64-bit hashes, begin among sorted keys."""
    return np.append(np.searchsorted(keys, np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)), len(keys))


def _sent(block: int, kind: int, keys: np.ndarray, second: np.ndarray, ids: np.ndarray, at: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Messages of sorted distinct entries: a bucket is a range of the first hash, so order stays."""
    cuts = _cuts(keys, buckets).tolist()
    for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if lo < hi:
            yield block, b, kind, _pack(_deltas(keys[lo:hi]), second[lo:hi], ids[lo:hi].astype(np.int64).view(np.uint64), at[lo:hi].astype(np.uint64))


def _packed_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Documents in blocks: (block, bucket, kind TEXT, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        count = TaskContext.get().partitionId() << 32
        for whole in gathered(batches, BLOCK_BYTES):
            data, offsets = utf8(whole.column(1))
            ids = whole.column(0).combine_chunks().cast(pa.int64())
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            head = struct.pack("<I", len(whole)) + ids.astype("<i8").tobytes() + known.astype(np.uint8).tobytes() + np.diff(offsets).astype("<i8").tobytes()
            yield _rows([(count, -1, TEXT, zstandard.ZstdCompressor(level=6).compress(head + data.tobytes()))])
            count += 1

    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(tidy(run, _forget), _MESSAGE)


def _opened(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, known, data, offsets) of a block; ids that are null order last."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(body)
    n = struct.unpack_from("<I", raw)[0]
    ids = np.frombuffer(raw, "<i8", n, 4)
    known = np.frombuffer(raw, np.uint8, n, 4 + 8 * n).astype(bool)
    offsets = np.concatenate(([0], np.cumsum(np.frombuffer(raw, "<i8", n, 4 + 9 * n))))
    return ids, known, np.frombuffer(raw, np.uint8, offset=4 + 17 * n), offsets


def _parsed(body: bytes) -> tuple[Parse, np.ndarray, np.ndarray]:
    ids, known, data, offsets = _opened(body)
    return Parse(data, offsets, np.where(known, ids, np.iinfo(np.int64).max)), ids, known


def _ask_phrases(blocks: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, _, _ = _parsed(body)
                if len(p.order):
                    o = p.order
                    rows = list(_sent(block, PHRASES, p.h[o], p.x[o], p.ids[o], p.first[o], buckets))
                    for a in range(0, len(rows), 64):
                        yield _rows(rows[a : a + 64])

    return blocks.mapInArrow(tidy(run, _forget), _MESSAGE)


def _answer(asked: DataFrame, buckets: int) -> DataFrame:
    """One byte an entry: 1 if an equal entry stands earlier, else 2 if another entry has its first hash, else 0."""

    def judged(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        parts = [_unpack(body, 4) for *_, body in rows]
        many = [len(p[0]) for p in parts]
        h = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        out = np.zeros(len(h), np.uint8)
        by = np.argsort(h, kind="stable")
        equal = h[by][1:] == h[by][:-1]
        some = by[np.append(equal, False) | np.append(False, equal)]
        if len(some):
            x, ids, at = (np.concatenate([p[k] for p in parts])[some] for k in (1, 2, 3))
            ids = ids.view(np.int64)
            block = np.repeat(np.array([r[0] for r in rows], np.int64), many)[some]
            rank = np.lexsort((at, block, ids, x, h[some]))
            hs, xs = h[some][rank], x[rank]
            again = np.append(False, (hs[1:] == hs[:-1]) & (xs[1:] == xs[:-1]))
            start = np.flatnonzero(np.append(True, hs[1:] != hs[:-1]))
            kinds = np.add.reduceat((~again).astype(np.int64), start)
            shared = np.repeat(kinds > 1, np.diff(np.append(start, len(hs))))
            out[some[rank]] = np.where(again, 1, np.where(shared, 2, 0))
        import zstandard

        ends = np.concatenate(([0], np.cumsum(many)))
        squeeze = zstandard.ZstdCompressor(level=1).compress
        return _rows([(block, bucket, kind, squeeze(out[a:b].tobytes())) for (block, bucket, kind, _), a, b in zip(rows, ends[:-1], ends[1:], strict=True)])

    return _by_bucket(asked, buckets, judged)


def _by_bucket(asked: DataFrame, buckets: int, judged: Callable) -> DataFrame:
    """``judged`` over all messages of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kept and row[1] != kept[0][1]:
                    yield judged(kept)
                    kept = []
                kept.append(row)
        if kept:
            yield judged(kept)

    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return asked.repartition(min(parts, buckets), "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run, _forget), _MESSAGE)


def _with_answers(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Messages by block: answers in the order of their buckets, then the text."""
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = blocks
    for a in answers:
        both = both.unionByName(a)
    return both.repartition(parts, "block").sortWithinPartitions("block", F.col("kind") == TEXT, "kind", "bucket")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, np.ndarray], bytes]]:
    import zstandard

    got: dict[int, list[bytes]] = {}
    for batch in batches:
        for block, _, kind, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind != TEXT:
                got.setdefault(kind, []).append(zstandard.ZstdDecompressor().decompress(body))
                continue
            yield block, {k: np.frombuffer(b"".join(v), np.uint8) for k, v in got.items()}, body
            got = {}


def _verdicts(p: Parse, answers: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases whose windows all repeat, and phrases whose windows must be looked at one by one."""
    said = answers.get(PHRASES, np.zeros(0, np.uint8))
    leads = np.zeros(len(p.first), bool)
    leads[p.order] = True
    own = said[p.same] if len(p.same) else said[:0]
    return ~leads | (own == 1), leads & (own == 2)


def _told_apart(p: Parse, ambiguous: np.ndarray) -> np.ndarray:
    """Phrases whose letters are sent, in the order in which they are."""
    some = np.flatnonzero(ambiguous)
    return some[np.argsort(p.h[some], kind="stable")]


def _ask_letters(messages: DataFrame, buckets: int) -> DataFrame:
    """Messages of the letters of phrases that share a trigger with another: its hash, ids, places, sizes, letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for block, answers, body in _by_block(batches):
            p, _, _ = _parsed(body)
            o = _told_apart(p, _verdicts(p, answers)[1]) if len(p.order) else p.order
            cuts = _cuts(p.h[o], buckets)
            rows = []
            for k, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if lo < hi:
                    some = o[lo:hi]
                    ends = p.last[some] + LENGTH
                    head = _pack(_deltas(p.h[some]), p.ids[some].view(np.uint64), p.first[some].astype(np.uint64), (ends - p.first[some]).astype(np.uint64))
                    letters = zstandard.ZstdCompressor(level=1).compress(b"".join(p.data[x:y].tobytes() for x, y in zip(p.first[some].tolist(), ends.tolist(), strict=True)))
                    rows.append((block, k, LETTERS, struct.pack("<I", len(head)) + head + letters))
            for a in range(0, len(rows), 64):
                yield _rows(rows[a : a + 64])

    return messages.mapInArrow(tidy(run, _forget), _MESSAGE)


def suffix_ranks(letters: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes of adjoining phrases, cut to LENGTH letters: equal ranks, equal letters; -1 if shorter.

    ``ends`` are the phrases' ends. Ranks double their depth: 8 letters as one number, then 16, 32, 64 and LENGTH.
    """
    n = len(letters)
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = letters
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | wide[k : k + n]
    rank = np.full(n, -1, np.int64)
    ok = left >= 8
    rank[ok] = np.unique(key[ok], return_inverse=True)[1]
    depth = 8
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        at = np.flatnonzero(left >= depth + step)
        most = int(rank.max(initial=0)) + 1
        rank_of = np.unique(rank[at] * most + rank[at + step], return_inverse=True)[1]
        rank = np.full(n, -1, np.int64)
        rank[at] = rank_of
        depth += step
    return rank


def _answer_letters(asked: DataFrame, buckets: int) -> DataFrame:
    """For each phrase of a message a bit a window: whether the window stands earlier in the corpus."""

    def judged(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        import zstandard

        heads, texts = [], []
        for *_, body in rows:
            size = struct.unpack_from("<I", body)[0]
            heads.append(_unpack(body[4 : 4 + size], 4))
            texts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(body[4 + size :]), np.uint8))
        h = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in heads])
        ids, place, size = (np.concatenate([x[k] for x in heads]).view(np.int64) for k in (1, 2, 3))
        block = np.repeat(np.array([r[0] for r in rows], np.int64), [len(x[0]) for x in heads])
        begin = np.cumsum(size) - size
        letters = np.concatenate(texts)
        many = size - LENGTH + 1
        to = np.cumsum(many) - many
        again = np.zeros(int(many.sum()), np.uint8)
        # phrases of one trigger together, some triggers at a time
        by = np.argsort(h, kind="stable")
        fresh = np.append(True, h[by][1:] != h[by][:-1])
        lo = 0
        while lo < len(by):
            far = np.flatnonzero(fresh[lo + 1 :] & (np.cumsum(size[by[lo:]])[:-1] >= MOST_LETTERS))
            hi = lo + 1 + int(far[0]) if len(far) else len(by)
            some = by[lo:hi]
            ends = np.cumsum(size[some])
            at = np.arange(int(ends[-1])) + np.repeat(begin[some] - (ends - size[some]), size[some])
            rank = suffix_ranks(letters[at], ends)
            windows = np.flatnonzero(rank >= 0)
            phrase = np.repeat(np.arange(len(some)), size[some])[windows]
            offset = windows - (ends - size[some])[phrase]
            own = some[phrase]
            # equal windows in the order of the corpus
            order = np.lexsort((place[own] + offset, block[own], ids[own], rank[windows]))
            same = np.append(False, rank[windows][order][1:] == rank[windows][order][:-1])
            again[(to[own] + offset)[order[same]]] = 1
            lo = hi
        squeeze = zstandard.ZstdCompressor(level=1).compress
        out, spot = [], 0
        for (b, bucket, kind, _), x in zip(rows, heads, strict=True):
            n = int((x[3].astype(np.int64) - LENGTH + 1).sum())
            out.append((b, bucket, kind, squeeze(again[spot : spot + n].tobytes())))
            spot += n
        return _rows(out)

    return _by_bucket(asked, buckets, judged)


def _finished(messages: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, answers, body in _by_block(batches):
            p, ids, known = _parsed(body)
            data, offsets = p.data, p.offsets
            depth = np.zeros(len(data) + 1, np.int64)
            if len(p.order):
                all_repeat, ambiguous = _verdicts(p, answers)
                np.add.at(depth, p.first[all_repeat], 1)
                np.add.at(depth, p.last[all_repeat] + LENGTH, -1)
                o = _told_apart(p, ambiguous)
                if len(o):
                    many = p.last[o] - p.first[o] + 1
                    at = np.arange(int(many.sum())) + np.repeat(p.first[o] - (np.cumsum(many) - many), many)
                    again = at[answers[LETTERS] == 1]
                    np.add.at(depth, again, 1)
                    np.add.at(depth, again + LENGTH, -1)
            gone = np.cumsum(depth[:-1]) > 0
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            starts = offsets[:-1][offsets[:-1] < offsets[1:]]
            opens[starts] = gone[starts]
            removed, spans = (np.concatenate(([0], np.cumsum(x)))[offsets] for x in (gone, opens))
            left = data[~gone]
            to = offsets - removed
            for a in range(0, len(ids), 256):
                b = min(a + 256, len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], mask=~known[a:b]), pa.array(np.diff(offsets[a : b + 1])), pa.array(np.diff(removed[a : b + 1])), pa.array(np.diff(spans[a : b + 1])), pa.array([left[x:y].tobytes() for x, y in zip(to[a:b], to[a + 1 : b + 1], strict=True)], pa.binary())], [key, "n_bytes", "n_removed", "n_spans", "kept"])

    return messages.mapInArrow(tidy(run, _forget), f"{key} long, n_bytes long, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept binary) of each row. The result reads tables of ``scratch``."""
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = scratch.save(_packed_blocks(docs, key, text))
    phrases = scratch.save(_answer(_ask_phrases(blocks, buckets), buckets))
    letters = _answer_letters(_ask_letters(_with_answers(blocks, phrases), buckets), buckets)
    return _finished(_with_answers(blocks, phrases, letters), key, dict(docs.dtypes)[key])


def op8_prefix_free_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean(spark)
    with Scratch(spark) as scratch:
        out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch)
        return held(out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")))
