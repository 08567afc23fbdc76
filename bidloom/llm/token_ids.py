"""Token ids of a byte-level BPE vocabulary, Simple-8b word-aligned coding of ids, and id tables on shared storage.

``ByteBpe`` gives the ids that the tokenizers library gives for the same vocabulary file, which it reads. It merges with
the tiktoken library, which takes a quarter of the time; the tests hold it against the tokenizers library.
Null texts count as empty. ``write_token_ids`` / ``read_token_ids`` are the binary output: a Parquet table whose rows hold
one document each, with its ids as Simple-8b words. Rows are dealt to ordered buckets by the order column and sorted in
each; rows that repeat an order value are all kept, in the order of a hash of their texts, and nulls come first. Empty
tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, shared_path

# The split pattern and the special token of the 50k byte-level vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = "<|endoftext|>"

SLICE_ROWS = 1024


class ByteBpe:
    """Ids of texts. The special token's string in a text gives its id, as in the tokenizers library."""

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, encoding="utf-8") as file:
            model = json.load(file)
        to_byte = {c: b for b, c in _byte_alphabet().items()}
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("bidloom", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        #: Ids take 16 bits where the vocabulary allows it, else 32.
        self.type = np.dtype("<u2" if max(*ranks.values(), *special.values()) < 1 << 16 else "<u4")

    def encode(self, texts: list[str | None], end_id: int | None = None) -> list[bytes]:
        """Little-endian ids of each text, and the end id after them, as ``type`` has it."""
        plain, special, code = self.encoding.encode_ordinary, self.encoding.encode, {2: "H", 4: "I"}[self.type.itemsize]
        tail = b"" if end_id is None else np.array([end_id], self.type).tobytes()
        return [array(code, special(t, allowed_special="all") if END_OF_TEXT in t else plain(t)).tobytes() + tail if t else tail for t in texts]


def _byte_alphabet() -> dict[int, str]:
    """The usual printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, others from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


@functools.lru_cache(maxsize=2)
def byte_bpe(vocabulary: str) -> ByteBpe:
    """One encoder for each Python worker, kept over its tasks."""
    return ByteBpe(vocabulary)


# --- Simple-8b ---------------------------------------------------------------------------------------------------

#: Values in a word by selector; each has 60 // count bits. Selector ESCAPE: the next word is one value of any size.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
BLOCK = 4096
_SELECTOR = {c: s for s, c in enumerate(COUNTS)}
_FITTING = np.array([0, *[max(c for c in COUNTS if c <= n) for n in range(1, 61)]], np.uint8)
_BY_SELECTOR = np.array([*COUNTS, 0, 1], np.int64)


def _most(values: np.ndarray) -> np.ndarray:
    """The largest count whose bits hold each value."""
    most = np.ones(len(values), np.uint8)
    for c in COUNTS[::-1]:
        most[values < np.uint64(1 << (60 // c))] = c
    return most


@functools.cache
def _short_most() -> np.ndarray:
    """_most() of every 16-bit value."""
    return _most(np.arange(1 << 16, dtype=np.uint64))


def pack(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit words of ``values``, and the words before each of the runs that end at ``ends``; no word spans two runs."""
    n = len(values)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    if values.dtype.itemsize <= 2:
        most = _short_most()[values]
    else:
        most = _most(values.astype(np.uint64))
    values = values.astype(np.uint64)
    best, window, width = np.ones(n, np.uint8), most, 1
    for c in COUNTS[::-1][1:]:  # the least of each c neighbours, from the windows before
        if n < c:
            break
        window = np.minimum(window[: n - c + 1], window[c - width : c - width + n - c + 1])
        width = c
        fits = window >= c
        if not fits.any():
            break
        np.maximum(best[: n - c + 1], fits.view(np.uint8) * np.uint8(c), out=best[: n - c + 1])
    lengths = np.diff(np.concatenate([starts, [n]]))
    rest = np.repeat(starts + lengths, lengths) - np.arange(n)
    best = np.minimum(best, _FITTING[np.minimum(rest, 60)])
    at, stop, firsts = starts[lengths > 0], (starts + lengths)[lengths > 0], []
    while at.size:  # all runs go on by one word at a time
        firsts.append(at)
        at = at + best[at]
        on = at < stop
        at, stop = at[on], stop[on]
    first = np.sort(np.concatenate(firsts))
    count = best[first]
    big = values[first] >= np.uint64(1 << 60)
    place = np.cumsum(1 + big) - 1 - big
    words = np.zeros(int(place[-1]) + 1 + int(big[-1]), np.uint64)
    for c in np.unique(count).tolist():
        rows = np.flatnonzero((count == c) & ~big)
        word, bits = np.full(len(rows), _SELECTOR[c], np.uint64), 60 // c
        for k in range(c):
            word |= values[first[rows] + k] << np.uint64(4 + k * bits)
        words[place[rows]] = word
    words[place[big]] = ESCAPE
    words[place[big] + 1] = values[first[big]]
    return words, np.concatenate([place, [len(words)]])[np.searchsorted(first, starts)]


def unpack(words: np.ndarray) -> np.ndarray:
    """All values of packed words, in order."""
    if not len(words):
        return np.zeros(0, np.uint64)
    selector = (words & np.uint64(15)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (selector == ESCAPE).any():  # a raw word after an escape can look like any selector
        i, flags = 0, selector.tolist()
        while i < len(flags):
            if flags[i] == ESCAPE:
                raw[i + 1] = True
                i += 1
            i += 1
        selector[raw] = 14
    count = _BY_SELECTOR[selector]
    place = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in np.unique(selector).tolist():
        rows = np.flatnonzero(selector == s)
        if s == 14:
            continue
        if s == ESCAPE:
            out[place[rows]] = words[rows + 1]
            continue
        bits = 60 // COUNTS[s]
        mask = np.uint64((1 << bits) - 1)
        for k in range(COUNTS[s]):
            out[place[rows] + k] = (words[rows] >> np.uint64(4 + k * bits)) & mask
    return out


# --- Id tables ---------------------------------------------------------------------------------------------------


def _slices(batches, size: int = SLICE_ROWS):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _packer(vocabulary: str, end_id: int | None):
    def run(batches):
        encoder, start = byte_bpe(vocabulary), 0  # ids of the bucket so far
        for part in _slices(batches):
            coded = encoder.encode(part.column(2).to_pylist(), end_id)
            lengths = np.array([len(x) // encoder.type.itemsize for x in coded], np.int64)
            ids = np.frombuffer(b"".join(coded), encoder.type)
            blocks = -(-lengths // BLOCK)  # a document without ids has no block
            first = np.cumsum(lengths) - lengths
            of = np.repeat(np.arange(len(coded)), blocks)
            k = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            ends = np.minimum(first[of] + (k + 1) * BLOCK, first[of] + lengths[of])
            words, offsets = pack(ids, ends) if len(of) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            offsets = np.concatenate([offsets, [len(words)]])
            by_document = np.concatenate([[0], np.cumsum(blocks)])
            base = offsets[by_document]
            inner = offsets[:-1] - base[:-1][of] if len(of) else offsets[:-1]
            payload = words.astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(start + first),
                    pa.array(lengths),
                    pa.ListArray.from_arrays(pa.array(by_document, pa.int32()), pa.array(inner, pa.int32())),
                    pa.array([payload[a:b] for a, b in zip((base[:-1] * 8).tolist(), (base[1:] * 8).tolist(), strict=True)], pa.binary()),
                ],
                ["bucket", "doc_id", "first", "n_tokens", "block_offsets", "words"],
            )
            start += int(lengths.sum())

    return run


def write_token_ids(docs: DataFrame, vocabulary: str, path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 128 << 20) -> None:
    """Encode every text and write the id table at ``path``: bucket int, doc_id, first, n_tokens, block_offsets, words.

    A bucket is a range of the order column, of about ``bucket_bytes`` of text or less, and one task writes it in order;
    first counts the bucket's ids before the document. block_offsets has the first word of each block of 4096 ids, so that
    a reader can decode any block alone.
    """
    spark = docs.sparkSession
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length(text_col).cast("bigint"))).first()
    parts = max((size or 0) // bucket_bytes, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 100)) + 1
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = rows.select(F.spark_partition_id().alias("bucket"), "doc_id", "text")
    rows.mapInArrow(_packer(vocabulary, end_id), "bucket int, doc_id long, first long, n_tokens long, block_offsets array<int>, words binary").write.parquet(path)


def _decoder(batches):
    for part in _slices(batches):
        words = [np.frombuffer(x, "<u8") for x in part.column("words").to_pylist()]
        lengths = np.asarray(part.column("n_tokens"), np.int64)
        ids = unpack(np.concatenate(words) if words else np.zeros(0, np.uint64)).astype(np.int32)
        at = np.concatenate([[0], np.cumsum(lengths)])
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("bucket", "doc_id", "first")), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], ["bucket", "doc_id", "first", "ids"])


def read_token_ids(spark, path: str) -> DataFrame:
    """bucket int, doc_id long, first long, ids array<int> of an id table."""
    return spark.read.parquet(path).mapInArrow(_decoder, "bucket int, doc_id long, first long, ids array<int>")


def _digester(batches):
    for part in _decoder(batches):
        ids = part.column("ids")
        at, flat = np.asarray(ids.offsets), np.asarray(ids.values).astype("<u4").tobytes()
        crc = [zlib.crc32(flat[a:b]) for a, b in zip((at[:-1] * 4).tolist(), (at[1:] * 4).tolist(), strict=True)]
        columns = [*(part.column(c) for c in ("bucket", "doc_id", "first")), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "doc_id", "first", "n_tokens", "ids_crc32"])


def token_id_digests(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the decoded ids: the id table's rows one after another.

    A start is the bucket's place in its file and the decoded ids of all buckets before it: one sum for each bucket.
    """
    rows = cut(spark.read.parquet(path).mapInArrow(_digester, "bucket int, doc_id long, first long, n_tokens long, ids_crc32 long"), "id-digests")
    before = F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    totals = rows.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))  # one row for each bucket_bytes of text
    bases = totals.select("bucket", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(bases, "bucket").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file; TOKENIZERS_DIR or the installed package."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def token_id_round_trip(docs: DataFrame, vocabulary: str, end_id: int | None = 2) -> DataFrame:
    path = shared_path(docs.sparkSession, "token-ids")
    write_token_ids(docs, vocabulary, path, end_id)
    return token_id_digests(docs.sparkSession, path)
