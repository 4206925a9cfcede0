"""Benchmark decontamination: CGK walks, bit-sampling LSH over item-sized windows, exact verification.

Items and documents are sequences of normal words (lower case, outer marks stripped, empty ones dropped).

* CGK embedding. A random walk reads a window word by word; at each step it repeats the word or goes on, by a random
  bit of (repetition, step, word). Two sequences that differ by few edits give walks that differ in few steps, so
  edit distance becomes Hamming distance. A repetition walks over a stretch of at most STRETCH words from a random
  place of the item-sized window, so that one edit does not part all that follows it in a long item.
* Bit sampling. The key of a repetition is the walk at SAMPLES random steps. A window and an item of its size that
  have one of their REPETITIONS keys in common are candidates. Nothing else makes candidates. Of items with a fifth
  of their words deleted, the worst kind of edits, a key agrees with probability 0.25 to 0.4 on average and 0.09 at
  least among 60 samples of each length from 10 to 200 words, so 96 repetitions miss one in ten thousand of those.
* Verification: the least word edit distance of the item to any stretch near the window, at most ``edits`` of the
  item's words.

Walks are dear, so windows that cannot match are left out beforehand, by the q-gram lemma: a stretch within k edits of
an item of n words shares at least n - q + 1 - q * k of its q-grams with it, with starts at most 2 k apart (q is the
longest size for which that number is at least 1). Only the places of such windows are kept, not which item they
resemble; so this loses nothing, and the keys find the item.

Items are broadcast in blocks of about ITEM_BLOCK rows; further blocks are further passes over the documents.

Defined results: null or empty texts, and items without words, match nothing; items too short for one edit
must occur whole. Rows that repeat a document are matched one by one, and items that repeat an id too; benchmark rows
that are equal count once. Overlapping matches of one item in one document count once, the closest (then the first)
stretch. Very long items and texts are read whole. Other columns are not read by ``find_leaks`` and pass through
``clean``; where ``key`` and ``item_key`` have one name, the item's becomes "item_" and that name. Empty tables give
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleforge.llm.common import held, identified, lean, mixed, steps, table, tidy, utf8, without, words

ITEM_BLOCK = 10_000
REPETITIONS, STRETCH, SAMPLES = 96, 16, 2
#: Windows whose walks are taken at once.
_WALKS = 2048
_rng = np.random.default_rng(20190721)
_SEEDS = _rng.integers(0, 1 << 63, REPETITIONS, dtype=np.uint64)
_PLACES = _rng.random(REPETITIONS)
_LOTS = _rng.random((REPETITIONS, 2 * STRETCH))
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…“”‘’«»¿¡–—·•"
_MOST_KNOWN = 300_000


def normal(word: bytes) -> str:
    return word.decode("utf-8", "replace").strip(_MARKS).lower()


def cgk_keys(codes: np.ndarray, starts: np.ndarray, n: int, ends: np.ndarray) -> np.ndarray:
    """(windows x REPETITIONS) keys of the windows of ``n`` words from ``starts``, none read beyond its ``ends``."""
    size = min(n, STRETCH)
    place = (_PLACES * (n - size + 1)).astype(np.int64)
    # the sampled steps of each repetition: those with the least lots among the steps of its stretch
    sampled = np.sort(np.argsort(_LOTS[:, : 2 * size], axis=1)[:, :SAMPLES], axis=1)
    out = np.empty((len(starts), REPETITIONS), np.uint64)
    for lo in range(0, len(starts), _WALKS):
        at = starts[lo : lo + _WALKS, None] + place
        stop = np.minimum(at + size, ends[lo : lo + _WALKS, None])
        key = np.broadcast_to(_SEEDS, at.shape).copy()
        # repetitions that read on come first, so that the others are done with
        order = np.argsort(-sampled[:, -1], kind="stable")
        at, stop, key = at[:, order], stop[:, order], key[:, order]
        for t in range(int(sampled.max()) + 1):
            live = int((sampled[order, -1] >= t).sum())
            now = at[:, :live]
            word = np.where(now < stop[:, :live], codes[np.minimum(now, len(codes) - 1)] + 1, 0).astype(np.uint64)
            mine = np.flatnonzero((sampled[order[:live]] == t).any(1))
            key[:, mine] = mixed(key[:, mine] * np.uint64(0x9E3779B97F4A7C15) + word[:, mine])
            bit = mixed(_SEEDS[order[:live]] + word * np.uint64(0xD1342543DE82EF95) + np.uint64(t * 0x9E37)) & np.uint64(1)
            at[:, :live] = now + bit.astype(np.int64)
        out[lo : lo + _WALKS, order] = key
    return out


class Items:
    """Item words, the grams they share with documents, and their keys by length."""

    def __init__(self, ids: list[int], texts: list[str | None], percent: int):
        self.ids = ids
        split = [[w for w in map(normal, (t or "").encode().split()) if w] for t in texts]
        #: 0 stands for words that no item has.
        self.vocabulary: dict[str, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], np.int64) for ws in split]
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.edits = self.n * percent // 100
        self.q = np.maximum(1, np.minimum(8, self.n // (self.edits + 1)))
        self.need = np.maximum(1, self.n - self.q + 1 - self.q * self.edits)
        self.grams = {}
        for q in sorted({int(q) for q, n in zip(self.q, self.n, strict=True) if n}):
            of = [i for i in range(len(ids)) if self.q[i] == q and self.n[i]]
            keys = np.concatenate([_grams(self.words[i], q) for i in of])
            item = np.repeat(of, [self.n[i] - q + 1 for i in of])
            offset = np.concatenate([np.arange(self.n[i] - q + 1) for i in of])
            order = np.argsort(keys, kind="stable")
            distinct, first = np.unique(keys[order], return_index=True)
            self.grams[q] = (distinct, np.append(first, len(keys)), item[order], offset[order])
        self.known: dict[bytes, int] = {}
        #: Of each length: sorted keys of all repetitions, and the items that have them.
        self.keys = {}
        for n in sorted(set(self.n.tolist()) - {0}):
            of = np.flatnonzero(self.n == n)
            starts = np.arange(len(of)) * n
            keys = cgk_keys(np.concatenate([self.words[i] for i in of]), starts, n, starts + n).ravel()
            order = np.argsort(keys, kind="stable")
            self.keys[n] = (keys[order], np.repeat(of, REPETITIONS)[order])

    def alike(self, codes: np.ndarray, n: int, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all windows of ``n`` words and items of that length with a key in common."""
        keys, item = self.keys[n]
        pairs = [np.zeros((0, 2), np.int64)]
        for first in range(0, len(starts), 8 * _WALKS):
            asked = cgk_keys(codes, starts[first : first + 8 * _WALKS], n, ends[first : first + 8 * _WALKS]).ravel()
            lo, hi = np.searchsorted(keys, asked), np.searchsorted(keys, asked, "right")
            some = np.flatnonzero(hi > lo)
            many = (hi - lo)[some]
            flat = np.repeat(lo[some] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            pairs.append(np.unique(np.stack([first + np.repeat(some // REPETITIONS, many), item[flat]], 1), axis=0))
        return tuple(np.concatenate(pairs).T)

    def codes(self, distinct: pa.Array) -> np.ndarray:
        """Item word numbers of distinct raw words; 0 for others, -1 for words that are marks only."""
        if len(self.known) > _MOST_KNOWN:
            self.known.clear()
        raw = distinct.to_pylist()
        got = [self.known.get(w) for w in raw]
        for i, w in enumerate(raw):
            if got[i] is None:
                plain = normal(w)
                got[i] = self.known[w] = self.vocabulary.get(plain, 0) if plain else -1
        return np.array(got, np.int64)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    out = codes[: len(codes) - q + 1].astype(np.uint64)
    for k in range(1, q):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - q + 1 + k].astype(np.uint64))
    return out


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the stretch of ``text`` closest to the item; the earliest, then the shortest."""
    m = len(text)
    cost, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    steps_right = np.arange(m + 1)
    for k, w in enumerate(item):
        swap, drop = np.append(k + 1, cost[:-1] + (text != w)), cost + 1
        take = swap <= drop
        take[0] = False
        base = np.where(take, swap, drop)
        came = np.where(take, np.append(0, start[:-1]), start)
        # words of the text that the item lacks: a running minimum from the left
        run = np.minimum.accumulate(base - steps_right)
        source = np.maximum.accumulate(np.where(base - steps_right == run, steps_right, 0))
        cost, start = run + steps_right, came[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


def matches(items: Items, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item, start word, end word, edits) in adjoining documents; word numbers count raw words."""
    distinct, raw, first = words(data, offsets, lower=False)
    if not len(raw) or not len(items.ids):
        return
    codes = items.codes(distinct)[raw]
    solid = np.flatnonzero(codes >= 0)
    codes = codes[solid]
    bounds = np.searchsorted(solid, first)
    hits = []
    for q, (keys, spans, item, offset) in items.grams.items():
        if len(codes) < q:
            continue
        # grams without a foreign word and inside one document
        ok = np.ones(len(codes) - q + 1, bool)
        for k in range(q):
            ok &= codes[k : len(codes) - q + 1 + k] > 0
        at = np.flatnonzero(ok)
        doc = np.searchsorted(bounds, at, "right") - 1
        at, doc = at[at + q <= bounds[doc + 1]], doc[at + q <= bounds[doc + 1]]
        gram = codes[at].astype(np.uint64)
        for k in range(1, q):
            gram = mixed(gram * np.uint64(0x9E3779B97F4A7C15) + codes[at + k].astype(np.uint64))
        where = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
        found = keys[where] == gram
        at, doc, where = at[found], doc[found], where[found]
        many = spans[where + 1] - spans[where]
        flat = np.repeat(spans[where] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        hits.append((np.repeat(doc, many), item[flat], np.repeat(at, many) - offset[flat]))
    if not hits:
        return
    doc, item, diagonal = (np.concatenate(x) for x in zip(*hits, strict=True))
    order = np.lexsort((diagonal, item, doc))
    doc, item, diagonal = doc[order], item[order], diagonal[order]
    # enough shared grams with starts at most 2 k apart
    wide = np.int64(len(codes) + 4 * int(items.n.max()) + 8)
    line = (doc * len(items.ids) + item) * wide + diagonal + 2 * int(items.n.max())
    enough = np.searchsorted(line, line + 2 * items.edits[item], "right") - np.arange(len(line)) >= items.need[item]
    reach = np.zeros(len(line) + 1, np.int64)
    until = np.searchsorted(line, line[enough] + 2 * items.edits[item[enough]], "right")
    np.add.at(reach, np.flatnonzero(enough), 1)
    np.add.at(reach, until, -1)
    kept = np.flatnonzero(np.cumsum(reach[:-1]) > 0)
    kept = kept[np.append(True, line[kept][1:] != line[kept][:-1])] if len(kept) else kept
    doc, item, diagonal = doc[kept], item[kept], diagonal[kept]
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    size = items.n[item]
    for n in np.unique(size).tolist():
        k = int(items.edits[item[size == n][0]])
        own, at = doc[size == n], diagonal[size == n]
        # all starts within k of a place that may match, whichever item it may match
        places = (at[:, None] + np.arange(-k, k + 1)).ravel()
        own = np.repeat(own, 2 * k + 1)
        ok = (places >= bounds[own]) & (places < bounds[own + 1])
        windows, which = np.unique(places[ok], return_index=True)
        own = own[ok][which]
        w, i = items.alike(codes, n, windows, bounds[own + 1])
        order = np.lexsort((windows[w], i, own[w]))
        w, i = w[order], i[order]
        lo = 0
        while lo < len(w):
            # candidates whose starts are at most 2 k apart are verified at once
            hi = lo + 1
            while hi < len(w) and i[hi] == i[lo] and own[w[hi]] == own[w[lo]] and windows[w[hi]] - windows[w[lo]] <= 2 * k:
                hi += 1
            d, which_item = int(own[w[lo]]), int(i[lo])
            x, y = max(int(windows[w[lo]]) - k, int(bounds[d])), min(int(windows[w[hi - 1]]) + n + k, int(bounds[d + 1]))
            edits, start, end = best_stretch(items.words[which_item], codes[x:y])
            if edits <= k and end > start:
                found.setdefault((d, which_item), []).append((edits, x + start, x + end))
            lo = hi
    for (d, i), stretches in found.items():
        taken: list[tuple[int, int]] = []
        for edits, a, b in sorted(set(stretches)):
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                yield d, i, int(solid[a] - first[d]), int(solid[b - 1] + 1 - first[d]), edits


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", percent: int = 20) -> DataFrame:
    """(key, item_key, start_word, end_word, edits): stretches of documents within the allowed edits of an item."""
    kind, item_kind = dict(docs.dtypes)[key], dict(benchmark.dtypes)[item_key]
    named = f"item_{item_key}" if item_key == key else item_key
    rows = benchmark.select(F.col(item_key).alias("i"), F.col(item_text).cast("string").alias("t")).distinct()
    blocks = max(1, -(-rows.count() // ITEM_BLOCK))
    source = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    schema = f"`{key}` {kind}, `{named}` {item_kind}, start_word long, end_word long, edits long"

    def part(block: int) -> DataFrame:
        got = sorted(rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect(), key=lambda r: (r["i"] is None, r["i"], r["t"] or ""))
        ids, texts = [r["i"] for r in got], [r["t"] for r in got]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(ids, texts, percent)
            for batch in batches:
                data, offsets = utf8(batch.column(1))
                for lo, hi in steps(offsets):
                    out = sorted(matches(items, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                    if out:
                        d, i, a, b, e = zip(*out, strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([lo + x for x in d])), pa.array([ids[x] for x in i]), pa.array(a), pa.array(b), pa.array(e)], [key, named, "start_word", "end_word", "edits"])

        return source.mapInArrow(tidy(run), schema)

    return reduce(DataFrame.unionByName, (part(b) for b in range(blocks)))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without any leak; of rows that repeat an id all go, and rows without id are judged one by one."""
    rows, told = identified(docs, key)
    return without(rows, held(find_leaks(rows, benchmark, told, text).select(told).distinct()), told).select(*docs.columns)


def op1_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean(spark)
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
