"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

Texts are cut into pre-tokens, whose positions stay with their block of documents as numbers into the block's
list of distinct words. The lists are shuffled by word hash, packed: each distinct word of the corpus is
encoded once, in the one bucket it falls in, and its ids travel back to the blocks that have it. There the
numbers are replaced by ids, position by position. The positions themselves are in a table bucketed by block,
so they are joined without being shuffled. Decoding joins the table of token bytes, which is as large as
the vocabulary (a fixed, small size), so it is broadcast.

A word is shipped once for each block, however often the block has it, so a word that makes up a third of the
corpus is no heavier than any other. A block holds whole documents, about BLOCK_BYTES of text.

Defined results: null and empty texts have no ids and decode to no bytes. Repeated rows are encoded one by one,
rows without key too, and very long texts as blocks by themselves. ``decode`` adds one column, which wins over an input
column of its name; other columns of the documents are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleforge.llm.common import Scratch, binary, gathered, held, lean, table, tidy, utf8

BLOCK_BYTES = 5 << 20
#: Words whose ids, decimal spellings and bytes are in memory at once; a longer document is a step by itself.
STEP_WORDS = 200_000
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pieces "white space, then the rest up to white space"; each piece's number; document offsets.

    No pre-token crosses from a character that isn't white space to one that is, so pieces can be cut apart by
    themselves. Only ASCII white space opens a piece; not after a byte that may end other white space.
    """
    opens = _SPACE[data]
    opens[1:] &= ~_SPACE[data[:-1]]
    if len(data) > 3:
        at = np.flatnonzero(opens)
        at = at[at >= 3]
        odd = data[at - 1] >= 0x80
        near, b2, b3 = at[odd], data[at[odd] - 2], data[at[odd] - 3]
        b1 = data[near - 1]
        wide = ((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))) | (((b3 == 0xE1) | (b3 == 0xE2) | (b3 == 0xE3)) & ((b2 == 0x9A) | (b2 == 0x80) | (b2 == 0x81)))
        opens[near[wide]] = False
        opens[1:3] &= data[:2] < 0x80
    elif len(data):
        opens[1:] &= data[:-1] < 0x80
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[starts] = True
    at = np.flatnonzero(opens)
    found = binary(np.append(at, len(data)), data).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(at, offsets)


def _single(distinct: pa.Array) -> np.ndarray:
    """Pieces that are one pre-token for sure: letters, perhaps after a space."""
    return pc.match_substring_regex(pc.cast(distinct, pa.large_string()), r"^ ?\p{L}+$").to_numpy(zero_copy_only=False)


class Words:
    """A block's distinct words, and its documents as numbers into them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, pattern):
        distinct, codes, first = units(data, offsets)
        pieces, number, parts = distinct.to_pylist(), {}, []
        for piece, one in zip(pieces, _single(distinct) if len(pieces) else [], strict=True):
            if one:
                parts.append((number.setdefault(piece, len(number)),))
            else:
                parts.append(tuple(number.setdefault(w.encode(), len(number)) for w in pattern.findall(piece.decode())))
        self.words = list(number)
        many = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter((x for p in parts for x in p), np.int64, int(many.sum()))
        begin = np.concatenate(([0], np.cumsum(many)))
        got = many[codes]
        ends = np.concatenate(([0], np.cumsum(got)))
        self.stream = flat[np.repeat(begin[codes] - ends[:-1], got) + np.arange(ends[-1])]
        self.first = ends[first]


def packed(parts: list[bytes]) -> bytes:
    import zstandard

    lengths = np.fromiter(map(len, parts), "<u4", len(parts))
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<I", len(parts)) + lengths.tobytes() + b"".join(parts))


def unpacked(blob: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<I", raw)[0]
    ends = 4 + 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n, 4).astype(np.int64))
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)] if n else []


def _numbers(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes, which compress better than whole numbers."""
    import zstandard

    wide = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(wide.T).tobytes())


def _numbers_back(blob: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").reshape(-1).astype(np.int64)


def _blocks(docs: DataFrame, key: str, text: str, pattern: str, buckets: int, size: int) -> DataFrame:
    """Rows (block, bucket, keys, n, payload): bucket -1 has the documents' numbers, others packed words.

    A block's words are numbered by (bucket, word), so the buckets' lists in order need no numbers with them.
    The rows are written to a table once, so numbers and words of a block always come from one run of a task.
    """
    kind = dict(docs.dtypes)[key]
    schema = f"block string, bucket int, keys array<{kind}>, n binary, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import xxhash
        from pyspark import TaskContext

        cut, one = regex.compile(pattern), xxhash.xxh3_64_intdigest
        names, count = ["block", "bucket", "keys", "n", "payload"], 0
        types = [pa.string(), pa.int32(), None, pa.binary(), pa.binary()]
        for whole in gathered(batches, size):
            part = Words(*utf8(whole.column(1)), cut)
            types[2] = pa.list_(whole.column(0).type)
            block = f"{TaskContext.get().partitionId()}-{count}"
            count += 1
            # words go by (bucket, word)
            spot = np.fromiter((one(w) % buckets for w in part.words), np.int64, len(part.words))
            order = np.array([i for *_, i in sorted(zip(spot.tolist(), part.words, range(len(spot)), strict=True))], np.int64)
            slot = np.empty(len(order), np.int64)
            slot[order] = np.arange(len(order))
            # frequent words get small numbers in the stream, so it compresses
            by_rank = np.argsort(-np.bincount(part.stream, minlength=len(order)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[by_rank] = np.arange(len(order))
            rows = [(block, -1, whole.column(0).to_pylist(), _numbers(np.diff(part.first)), packed([_numbers(rank[part.stream]), _numbers(slot[by_rank])]))]
            cuts = np.flatnonzero(np.append(True, spot[order][1:] != spot[order][:-1])).tolist() if len(order) else []
            rows += [(block, int(spot[order[a]]), None, None, packed([part.words[i] for i in order[a:b].tolist()])) for a, b in zip(cuts, [*cuts[1:], len(order)][: len(cuts)], strict=True)]
            del part, whole
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(tidy(run), schema)


def _encoded(words: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(block, bucket, payload): words to ids, each distinct word of a bucket once; frames come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
        now, known = None, {}
        for batch in batches:
            out = []
            for bucket, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bucket != now:
                    now, known = bucket, {}
                got = []
                for w in unpacked(blob):
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = np.array(encoding.encode_ordinary(w.decode()), "<u4").tobytes()
                    got.append(ids)
                out.append(packed([_numbers(np.fromiter((len(g) // 4 for g in got), np.int64, len(got))), _numbers(np.frombuffer(b"".join(got), "<u4"))]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], batch.schema.names)

    return words.mapInArrow(tidy(run), words.schema)


def _joined(docs: DataFrame, scratch: Scratch, key: str, text: str, ranks_path: str | None, pattern: str | None, block: int) -> DataFrame:
    """(keys, n, payload, lists): each block's documents as numbers, and the ids of its words. It reads tables of ``scratch``."""
    import public_tokenizers

    ranks_path, pattern = ranks_path or default_ranks(), pattern or public_tokenizers.PATTERN
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = scratch.bucketed(_blocks(docs, key, text, pattern, 2 * parts, block), "block", parts)
    words = blocks.where("bucket >= 0").select("block", "bucket", "payload").repartition(parts, "bucket").sortWithinPartitions("bucket")
    back = _encoded(words, ranks_path, pattern).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "payload"))).alias("lists"))
    both = blocks.where("bucket < 0").select("block", "keys", "n", "payload").join(back.hint("shuffle_merge"), "block", "left")
    return both.select("keys", "n", "payload", "lists")


def _ids(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """(key, ids) of the documents of joined blocks, STEP_WORDS words at a time."""
    for whole in batches:
        for row in range(len(whole)):
            batch = whole.slice(row, 1)
            keys, n, payload, lists = (batch.column(c)[0].as_py() for c in ("keys", "n", "payload", "lists"))
            n, (stream, slot) = _numbers_back(n), map(_numbers_back, unpacked(payload))
            pairs = [tuple(map(_numbers_back, unpacked(x["payload"]))) for x in lists or ()]
            size = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
            flat = np.concatenate([p[1] for p in pairs]).astype(np.int32) if pairs else np.zeros(0, np.int32)
            del pairs, lists, payload
            # from here on words go by their rank in the stream
            begin, many = (np.cumsum(size) - size)[slot], size[slot]
            ends, lo = np.concatenate(([0], np.cumsum(n))), 0
            while lo < len(keys):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + STEP_WORDS, "right")) - 1)
                codes = stream[ends[lo] : ends[hi]]
                got = many[codes]
                to = np.concatenate(([0], np.cumsum(got)))
                ids = flat[np.repeat(begin[codes] - to[:-1], got) + np.arange(to[-1])] if len(codes) else flat[:0]
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo:hi], whole.schema.field("keys").type.value_type), pa.ListArray.from_arrays(pa.array(to[ends[lo : hi + 1] - ends[lo]].astype(np.int32)), pa.array(ids))], [key, "ids"])
                lo = hi


def encode(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", ranks_path: str | None = None, pattern: str | None = None, block: int = BLOCK_BYTES) -> DataFrame:
    """(key, ids array<int>) of each row. The result reads tables of ``scratch``."""
    both = _joined(docs, scratch, key, text, ranks_path, pattern, block)
    return both.mapInArrow(tidy(lambda batches: _ids(batches, key)), f"{key} {dict(docs.dtypes)[key]}, ids array<int>")


def token_bytes(ranks_path: str) -> pa.Array:
    """The bytes of every id."""
    ranks = read_ranks(ranks_path)
    inverse = [b""] * (max(ranks.values()) + 1)
    for word, i in ranks.items():
        inverse[i] = word
    return pa.array(inverse, pa.large_binary())


def _spelled(column: pa.ListArray, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of each row's ids, joined: bytes, and ``n + 1`` offsets of the rows."""
    data, ends = utf8(pieces.take(column.flatten()))
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return data, ends[np.concatenate(([0], np.cumsum(lengths)))]


def decode(encoded: DataFrame, ids: str = "ids", into: str = "decoded", ranks_path: str | None = None) -> DataFrame:
    """Adds the bytes of each row's ids, by the broadcast table of token bytes."""
    ranks_path = ranks_path or default_ranks()
    keep = [c for c in encoded.columns if c != into]
    at = keep.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(ranks_path)
        for batch in batches:
            data, where = _spelled(batch.column(at), tokens)
            yield pa.RecordBatch.from_arrays([*batch.columns, binary(where, data).cast(pa.binary())], [*keep, into])

    return encoded.select(*keep).mapInArrow(tidy(run), encoded.select(*keep).schema.add(into, "binary"))


def digests(docs: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), held in the checkpoint folder.

    Ids and decoded bytes are those of ``encode`` and ``decode``, made and hashed in one worker STEP_WORDS words at a
    time: neither goes back through the executor, whose heap and second worker they would fill.
    """
    ranks_path = default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(ranks_path)
        numbers = pa.array([b"%d " % i for i in range(len(tokens))], pa.large_binary())
        for batch in _ids(batches, "doc_id"):
            column = batch.column(1)
            data, at = _spelled(column, numbers)
            ids = [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in pairwise(at.tolist())]
            data, at = _spelled(column, tokens)
            decoded = [hashlib.sha256(data[a:b]).hexdigest() for a, b in pairwise(at.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.list_value_length(column).cast(pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    with Scratch(docs.sparkSession) as scratch:
        both = _joined(docs, scratch, "doc_id", "text", ranks_path, None, block)
        return held(both.mapInArrow(tidy(run), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean(spark)
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
