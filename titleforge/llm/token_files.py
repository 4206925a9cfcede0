"""Token ids in files of canonical, length-limited Huffman codes.

File format, in a folder:

* ``codes`` (Parquet): id, length. Codes are canonical: shorter first, then smaller ids first. No code is longer
  than LIMIT bits, so one table of 2**LIMIT entries decodes.
* ``blocks`` (Parquet): one row is a block of whole documents, decodable by itself. file, block: its place; start:
  ids of the file before it; keys, n: its documents in ascending order and their ids' numbers; payload: their
  bits, each document from a byte on; marks: bit offsets of every STRIDE-th id of each document, from the
  block's first byte, so all stretches of a block are decoded side by side.

Files are ranges of keys in ascending order; rows without key come first. Global counts give the code
lengths (at most one row a vocabulary entry reaches the driver).

Defined results: null and empty texts have the end id only. Special tokens in a text get their own ids, as in the
library's default. Rows that repeat a key are written one by one, in the order of their contents. A very long text
is a block by itself. Other columns are not read. An empty table gives empty files.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleforge.llm.byte_bpe import _numbers, _numbers_back, units
from titleforge.llm.common import Scratch, gathered, held, lean, mixed, table, tidy, utf8

#: Longest code; ids between marks; ids of a block, about.
LIMIT, STRIDE, BLOCK_IDS = 16, 256, 1 << 19
BLOCK_BYTES = 8 << 20
END_ID = 0
#: Pieces that a worker remembers, past which it starts anew with those of its last block; bytes of the longest of them.
MOST_KNOWN, SHORT = 1_000_000, 31
#: A worker's libraries, by the file they were read from.
_libraries: dict[tuple, Pieces] = {}
_WHITE = frozenset(b" \t\n\v\f\r\x1c\x1d\x1e\x1f")
#: Plain pieces: all of U+00C0 to U+024F but two signs are letters. What an added token must hold to be in none of them.
_PLAIN = r"^[ \n]?[a-zA-Z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+[.,;:!?#$%&*]*$"
_FOREIGN = re.compile(r"[^\sa-zA-Z.,;:!?#$%&*\x80-\U0010FFFF]")
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?#$%&*")] = True
#: The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on.
_SPELLED = np.arange(256, dtype="<u4")
_HIDDEN = np.array([*range(33), *range(127, 161), 173])
_SPELLED[_HIDDEN] = 256 + np.arange(len(_HIDDEN))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 where the count is 0."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    level, leaves = weight, [np.ones(len(order), bool)]
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, packages])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        leaves.append(rank < len(weight))
    take = 2 * (len(order) - 1)
    for is_leaf in reversed(leaves):
        n = int(is_leaf[:take].sum())
        out[order[:n]] += 1
        take = 2 * (take - n)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0].tolist():
        code <<= int(lengths[i]) - before
        codes[i], before = code, int(lengths[i])
        code += 1
    return codes


def pack_bits(ids: np.ndarray, ends: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of documents (``ends``: n + 1 offsets into ``ids``), each from a byte on; and each id's bit offset."""
    size = lengths[ids]
    run = np.concatenate(([0], np.cumsum(size)))
    bits = np.diff(run[ends])
    base = np.concatenate(([0], np.cumsum((bits + 7) // 8 * 8)))
    at = run[:-1] + np.repeat(base[:-1] - run[ends[:-1]], np.diff(ends))
    words = np.zeros(int(base[-1]) // 32 + 2, np.uint64)
    if len(ids):
        where, shift = at >> 5, (64 - size - (at & 31)).astype(np.uint64)
        long = codes[ids] << shift
        # ids are in order, so those that touch one word are neighbours
        first = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        words[where[first]] += np.add.reduceat(long >> np.uint64(32), first)
        words[where[first] + 1] += np.add.reduceat(long & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").view(np.uint8)[: int(base[-1]) // 8], at


class Decoder:
    def __init__(self, lengths: np.ndarray):
        self.bits = max(1, int(lengths.max(initial=1)))
        codes = canonical(lengths)
        self.symbol, self.size = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int64)
        for i in np.flatnonzero(lengths).tolist():
            spare = self.bits - int(lengths[i])
            a = int(codes[i]) << spare
            self.symbol[a : a + (1 << spare)], self.size[a : a + (1 << spare)] = i, lengths[i]

    def stretches(self, payload: bytes, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of all stretches, one after the other; each from its own bit offset."""
        raw = np.frombuffer(payload + b"\0\0\0\0\0", np.uint8).astype(np.uint32)
        wide = (raw[:-4] << 24) | (raw[1:-3] << 16) | (raw[2:-2] << 8) | raw[3:-1]
        order = np.argsort(-counts, kind="stable")
        at, left = starts[order].copy(), counts[order]
        base = np.concatenate(([0], np.cumsum(counts)))[:-1][order]
        out = np.zeros(int(counts.sum()), np.int32)
        most = int(left[0]) if len(left) else 0
        live = np.searchsorted(-left, -np.arange(1, most + 1), "right")
        mask, top = np.uint32((1 << self.bits) - 1), 32 - self.bits
        for k in range(most):
            n = live[k]
            now = at[:n]
            peek = (wide[now >> 3] >> (top - (now & 7)).astype(np.uint32)) & mask
            out[base[:n] + k] = self.symbol[peek]
            at[:n] += self.size[peek]
        return out


def _is_byte_level(tok) -> bool:
    """Whether a tokenizer is the byte-level pattern and a plain BPE model, with nothing before or after them."""
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel

    before, model = tok.pre_tokenizer, tok.model
    pattern = isinstance(before, ByteLevel) and not before.add_prefix_space and before.use_regex
    merges = isinstance(model, BPE) and not (model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix)
    return pattern and merges and not (tok.normalizer or tok.truncation or tok.padding)


class Pieces:
    """The library's ids of single pieces, which are cut at places where the library cuts any text.

    Many pieces go through one call as one text. Tokens of a byte-level vocabulary have one character a byte, so the
    lengths of the tokens tell where each piece's ids end. Pieces that don't open with white space, that close with
    it or hold an added token go one by one, so the library treats them as it does in a whole text.

    Plain pieces (a space, a line's end or none, Latin letters, closing marks) are known pre-tokens. They are spelled in
    the byte-level alphabet here and handed to the same model, parted by white space, without the library's pattern.
    """

    def __init__(self, path: str):
        import tokenizers

        self.tok = tokenizers.Tokenizer.from_file(path)
        added = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        if any(any(c.isspace() for c in t) for t in added):
            raise ValueError("added tokens with white space can't be told piece by piece")
        self.added = [t.encode() for t in added]
        vocabulary = self.tok.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)
        self.plain = _is_byte_level(self.tok) and all(_FOREIGN.search(t) for t in added)
        if self.plain:
            self.model = tokenizers.Tokenizer(self.tok.model)
            self.model.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
        self.known = Known()

    def _alone(self, pieces: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast([w.decode() for w in pieces], add_special_tokens=False)]

    def _together(self, pieces: list[bytes]) -> list[bytes]:
        [whole] = self.tok.encode_batch_fast([b"".join(pieces).decode()], add_special_tokens=False)
        ids = np.array(whole.ids, "<u4")
        ends, wanted = np.cumsum(self.bytes[ids]), np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        cut = np.searchsorted(ends, wanted)
        if not len(ids) or cut[-1] != len(ids) - 1 or (ends[cut] != wanted).any():
            return self._alone(pieces)
        raw, at = ids.tobytes(), [0, *(4 * cut + 4).tolist()]
        return [raw[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)]

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian ids of each piece."""
        held = b"".join(pieces)
        odd = [w[0] not in _WHITE or w[-1] in _WHITE or (w[-1] > 127 and w[-3:].decode(errors="ignore")[-1:].isspace()) for w in pieces]
        if any(t in held for t in self.added):
            odd = [o or any(t in w for t in self.added) for o, w in zip(odd, pieces, strict=True)]
        out = [b""] * len(pieces)
        alone, rest = [i for i, o in enumerate(odd) if o], [i for i, o in enumerate(odd) if not o]
        for some, take in [(alone, self._alone), *((rest[a : a + 20_000], self._together) for a in range(0, len(rest), 20_000))]:
            for i, got in zip(some, take([pieces[i] for i in some]), strict=True):
                out[i] = got
        return out

    def _spelled(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Numbers of ids and the ids of plain pieces; None where the tokens' lengths don't tell them apart."""
        ends, first = offsets[1:] - offsets[0], offsets[:-1] - offsets[0]
        data = data[offsets[0] : offsets[-1]]
        # white space goes after an opening line's end, before the closing marks and after each piece
        mark = _MARK[data]
        apart = np.concatenate((first[data[first] == 10] + 1, np.flatnonzero(mark[1:] > mark[:-1]) + 1, ends))
        text = np.insert(_SPELLED[data], np.sort(apart), 32)
        [whole] = self.model.encode_batch_fast([text.tobytes().decode("utf-32-le")], add_special_tokens=False)
        ids = np.array(whole.ids, "<u4")
        told = np.cumsum(self.bytes[ids])
        cut = np.searchsorted(told, ends)
        if not len(ids) or cut[-1] != len(ids) - 1 or (told[cut] != ends).any():
            return None
        return np.diff(cut, prepend=-1), ids

    def encoded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and the ids of each of many pieces."""
        plain = pc.match_substring_regex(pc.cast(pieces, pa.large_string()), _PLAIN).to_numpy(zero_copy_only=False) if self.plain else np.zeros(len(pieces), bool)
        sizes, parts, rest = np.zeros(len(pieces), np.int64), [], [np.flatnonzero(~plain)]
        where = np.flatnonzero(plain)
        data, offsets = utf8(pieces.take(pa.array(where)))
        for a in range(0, len(where), 20_000):
            some = where[a : a + 20_000]
            got = self._spelled(data, offsets[a : a + 20_001])
            if got is None:
                rest.append(some)
            else:
                sizes[some] = got[0]
                parts.append((some, got[1]))
        some = np.concatenate(rest)
        raw = self.ids(pieces.take(pa.array(some)).to_pylist())
        sizes[some] = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        parts.append((some, np.frombuffer(b"".join(raw), "<u4")))
        order = np.concatenate([some for some, _ in parts])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        many = sizes[order]
        return sizes, _taken(np.concatenate([ids for _, ids in parts]), np.cumsum(many) - many, many, back)

    def told(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and the ids of a block's distinct pieces; the library is asked for those not remembered."""
        keys, short = _keys(*utf8(distinct))
        at = np.full(len(distinct), -1)
        at[short] = self.known.find(keys)
        new = np.flatnonzero(at < 0)
        some, ids = self.encoded(distinct.take(pa.array(new)))
        known = self.known
        at[new] = known.count + np.arange(len(new))
        sizes = np.concatenate((known.sizes[: known.count], some))
        begin = np.concatenate((known.begin[: known.count], len(known.flat) + np.cumsum(some) - some))
        flat = _taken(np.concatenate((known.flat, ids)), begin, sizes, at)
        sizes = sizes[at]
        fresh = np.flatnonzero(at[short] >= known.count)
        if known.count + len(fresh) > MOST_KNOWN:
            known.forget()
            fresh = np.arange(min(len(short), MOST_KNOWN))
        known.add(keys[fresh], sizes[short[fresh]], _taken(flat, np.cumsum(sizes) - sizes, sizes, short[fresh]))
        return sizes, flat


class Known:
    """Short pieces as whole keys in an open table, and their ids."""

    def __init__(self):
        self.keys = np.zeros((MOST_KNOWN, (SHORT + 1) // 8), np.uint64)
        self.begin, self.sizes = np.zeros(MOST_KNOWN, np.int32), np.zeros(MOST_KNOWN, np.int32)
        self.slots = np.zeros(1 << (2 * MOST_KNOWN).bit_length(), np.int32)
        self.forget()

    def forget(self) -> None:
        self.count, self.flat = 0, np.zeros(0, "<u4")
        self.slots.fill(-1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.uint64)
        for column in keys.T:
            out = mixed(out + column)
        return (out & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number; -1 where it isn't known."""
        out, slot, left = np.full(len(keys), -1), self._first(keys), np.arange(len(keys))
        while len(left):
            got = self.slots[slot]
            left, slot, got = left[got >= 0], slot[got >= 0], got[got >= 0]
            same = (self.keys[got] == keys[left]).all(1)
            out[left[same]] = got[same]
            left, slot = left[~same], (slot[~same] + 1) & (len(self.slots) - 1)
        return out

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Adds distinct keys that aren't known; there is room for them."""
        to = self.count + len(keys)
        self.keys[self.count : to], self.sizes[self.count : to] = keys, sizes
        self.begin[self.count : to] = len(self.flat) + np.cumsum(sizes) - sizes
        number, slot = np.arange(self.count, to, dtype=np.int32), self._first(keys)
        self.count, self.flat = to, np.concatenate((self.flat, ids))
        while len(number):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = number[free]
            lost = self.slots[slot] != number
            number, slot = number[lost], (slot[lost] + 1) & (len(self.slots) - 1)


def _keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of up to SHORT bytes as rows of numbers that hold bytes and length; and which ones they are."""
    lengths = np.diff(offsets)
    short = np.flatnonzero(lengths <= SHORT)
    many = lengths[short]
    shift = np.arange(len(short)) * (SHORT + 1) - (np.cumsum(many) - many)
    out = np.zeros(len(short) * (SHORT + 1), np.uint8)
    at = np.arange(int(many.sum()))
    out[at + np.repeat(shift, many)] = data if len(short) == len(lengths) else _taken(data, offsets[:-1], lengths, short)
    out[SHORT :: SHORT + 1] = many
    return out.view(np.uint64).reshape(len(short), (SHORT + 1) // 8), short


def _taken(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The stretches ``at`` of ``flat``, which begin there and are of these sizes."""
    many = sizes[at]
    to = np.concatenate(([0], np.cumsum(many)))
    return flat[np.repeat(begin[at] - to[:-1], many) + np.arange(to[-1])]


def _library(path: str) -> Pieces:
    """The worker's own library of this file, with the pieces it has met."""
    state = os.stat(path)
    name = (path, state.st_mtime_ns, state.st_size)
    if name not in _libraries:
        _libraries.clear()
        _libraries[name] = Pieces(path)
    return _libraries[name]


def _encoded(docs: DataFrame, key: str, text: str, tokenizer: str) -> DataFrame:
    """(keys, n, pieces, sizes, ids): blocks of documents as numbers of distinct pieces, and the pieces' ids."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        library = _library(tokenizer)
        for whole in gathered(batches, BLOCK_BYTES):
            distinct, codes, first = units(*utf8(whole.column(1)))
            # pieces go by their first place, so frequent ones have small numbers, which compress
            sizes, ids = library.told(distinct)
            del distinct
            row = {"keys": pa.array([whole.column(0).to_pylist()], pa.list_(whole.column(0).type)), "n": [_numbers(np.diff(first))], "pieces": [_numbers(codes)], "sizes": [_numbers(sizes)], "ids": [_numbers(ids)]}
            yield pa.RecordBatch.from_pydict(row)

    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(tidy(run), f"keys array<{kind}>, n binary, pieces binary, sizes binary, ids binary")


def _id_counts(blocks: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for n, pieces, sizes, ids in zip(*(batch.column(c).to_pylist() for c in ("n", "pieces", "sizes", "ids")), strict=True):
                sizes, ids = _numbers_back(sizes), _numbers_back(ids)
                per = np.bincount(_numbers_back(pieces), minlength=len(sizes))
                got = np.bincount(ids, weights=np.repeat(per, sizes), minlength=len(total)).astype(np.int64)
                got[: len(total)] += total
                got[END_ID] += len(_numbers_back(n))
                total = got
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_pydict({"id": some, "count": total[some]})

    rows = blocks.select("n", "pieces", "sizes", "ids").mapInArrow(tidy(run), "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["count"].to_numpy(np.int64)
    return counts


def _documents(blocks: DataFrame, kind: str, lengths: np.ndarray, bounds: list) -> DataFrame:
    """(file, key, n, payload, marks) of each document."""
    codes = canonical(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n, pieces, sizes, ids in zip(*(batch.column(c).to_pylist() for c in ("keys", "n", "pieces", "sizes", "ids")), strict=True):
                n, pieces, sizes, flat = _numbers_back(n), _numbers_back(pieces), _numbers_back(sizes), _numbers_back(ids)
                begin, ends = np.concatenate(([0], np.cumsum(sizes))), np.concatenate(([0], np.cumsum(n)))
                lo = 0
                while lo < len(keys):
                    hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + 200_000, "right")) - 1)
                    part = pieces[ends[lo] : ends[hi]]
                    many = sizes[part]
                    to = np.concatenate(([0], np.cumsum(many)))
                    got = flat[np.repeat(begin[part] - to[:-1], many) + np.arange(to[-1])] if len(part) else flat[:0]
                    last = to[ends[lo : hi + 1] - ends[lo]]
                    # the end id closes each document
                    whole = np.insert(got, last[1:], END_ID)
                    stops = last + np.arange(len(last))
                    bits, at = pack_bits(whole, stops, codes, lengths)
                    size = np.diff(stops)
                    start = at[stops[:-1]] >> 3
                    stop = np.append(start[1:], len(bits))
                    raw = bits.tobytes()
                    rows = (
                        [0 if k is None else int(np.searchsorted(bounds, k, "left")) for k in keys[lo:hi]],
                        keys[lo:hi],
                        size,
                        [raw[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)],
                        [(at[a:b:STRIDE] - 8 * s).astype("<u4").tobytes() for a, b, s in zip(stops[:-1].tolist(), stops[1:].tolist(), start.tolist(), strict=True)],
                    )
                    types = [pa.int32(), batch.schema.field("keys").type.value_type, pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], ["file", "key", "n", "payload", "marks"])
                    lo = hi

    return blocks.mapInArrow(tidy(run), f"file int, key {kind}, n long, payload binary, marks binary")


def _blocks(ordered: DataFrame, kind: str) -> DataFrame:
    """Rows of the ``blocks`` table out of documents that come by file and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "start", "keys", "n", "payload", "marks"]
        now, block, start, kept, total, key_type = None, 0, 0, [], 0, None

        def flush() -> pa.RecordBatch:
            nonlocal block, start, kept, total
            keys, n, payload, marks = zip(*kept, strict=True)
            begin = 8 * np.concatenate(([0], np.cumsum([len(p) for p in payload])))[:-1]
            spots = np.concatenate([np.frombuffer(m, "<u4").astype(np.int64) + b for m, b in zip(marks, begin.tolist(), strict=True)])
            row = [[now], [block], [start], [list(keys)], [_numbers(np.array(n))], [b"".join(payload)], [_numbers(np.diff(spots, prepend=0))]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(key_type), pa.binary(), pa.binary(), pa.binary()]
            block, start, kept, total = block + 1, start + total, [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], names)

        for batch in batches:
            key_type = batch.column(1).type
            for file, key, n, payload, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kept and (file != now or total >= BLOCK_IDS):
                    yield flush()
                if file != now:
                    now, block, start = file, 0, 0
                kept.append((key, n, payload, marks))
                total += n
        if kept:
            yield flush()

    return ordered.mapInArrow(tidy(run), f"file int, block long, start long, keys array<{kind}>, n binary, payload binary, marks binary")


def write_files(docs: DataFrame, path: str, scratch: Scratch, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> None:
    """Encodes every text and writes the folder ``path``."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = scratch.save(_encoded(docs, key, text, tokenizer or default_tokenizer()))
    lengths = code_lengths(_id_counts(blocks))
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id long, length int").coalesce(1).write.parquet(f"{path}/codes")
    cuts = docs.select(F.percentile_approx(key, [i / files for i in range(1, files)], F.lit(100 * files)).alias("b")).first()["b"] if files > 1 else None
    ready = _documents(blocks, kind, lengths, sorted(set(cuts or [])))
    ordered = ready.repartitionById(files, "file").sortWithinPartitions("file", F.col("key").asc_nulls_first(), "payload")
    _blocks(ordered, kind).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(file, key, start_in_file, ids) of each document, decoded block by block."""
    codes = spark.read.schema("id long, length int").parquet(f"{path}/codes").collect()
    lengths = np.zeros(max([r["id"] for r in codes], default=0) + 1, np.int64)
    for r in codes:
        lengths[r["id"]] = r["length"]
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = dict(blocks.dtypes)["keys"].removeprefix("array<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for whole in batches:
            for i in range(len(whole)):
                batch = whole.slice(i, 1)
                file, start, keys, n, payload, marks = (batch.column(c)[0].as_py() for c in ("file", "start", "keys", "n", "payload", "marks"))
                n, marks = _numbers_back(n), np.cumsum(_numbers_back(marks).astype(np.uint32).view(np.int32).astype(np.int64))
                lanes = (n + STRIDE - 1) // STRIDE
                last = np.cumsum(lanes) - 1
                counts = np.full(len(marks), STRIDE, np.int64)
                counts[last] = n - (lanes - 1) * STRIDE
                ids = decoder.stretches(payload, marks, counts)
                ends = np.concatenate(([0], np.cumsum(n)))
                for a in range(0, len(n), 64):
                    b = min(a + 64, len(n))
                    yield pa.RecordBatch.from_arrays([pa.array([file] * (b - a), pa.int32()), pa.array(keys[a:b], batch.schema.field("keys").type.value_type), pa.array(start + ends[a:b]), pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]).astype(np.int32)), pa.array(ids[ends[a] : ends[b]]))], ["file", key, "start_in_file", "ids"])

    return blocks.select("file", "start", "keys", "n", "payload", "marks").mapInArrow(tidy(run), f"file int, {key} {kind}, start_in_file long, ids array<int>")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(file, before): ids of all files before each; one row a file."""
    blocks = spark.read.parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(_numbers_back(n).sum()) for n in batch.column(1).to_pylist()], pa.int64())], ["file", "n"])

    rows = sorted((r["file"], r["n"]) for r in blocks.select("file", "n").mapInArrow(tidy(run), "file int, n long").groupBy("file").agg(F.sum("n").alias("n")).collect())
    before = np.concatenate(([0], np.cumsum([n for _, n in rows]))).tolist()
    return spark.createDataFrame([(f, int(b)) for (f, _), b in zip(rows, before, strict=False)], "file int, before long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            flat, at = column.flatten().to_numpy().astype("<u4"), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["file", "doc_id", "start_in_file", "n_tokens", "ids_crc32"])

    with Scratch(spark) as scratch:
        path = scratch.path()
        write_files(docs, path, scratch)
        got = read_files(spark, path).mapInArrow(digest, f"file int, doc_id {dict(docs.dtypes)['doc_id']}, start_in_file long, n_tokens long, ids_crc32 long")
        return held(got.join(F.broadcast(starts(spark, path)), "file").select("doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32"))
