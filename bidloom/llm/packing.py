"""Best-fit packing of documents into fixed-length sequences, after Martello-Toth dominance reduction.

An item is a document (or the first, shorter piece of a document that is longer than a sequence). Items of the same
length are interchangeable, so the whole instance is a histogram with at most ``capacity`` rows, whatever the corpus.
Only this histogram reaches the driver. There, sets of at most three items that dominate all alternatives are fixed,
then best-fit decreasing packs the rest; each decision is taken for all equal bins at once, so the plan is a bounded
list of (bin pattern, how many bins). Spark then deals the documents to the plan: documents of one length are numbered
(in salted groups, so that no length gathers in one task) and their number gives sequence and offset.

Null texts are empty documents and hold only the end id. Repeated rows are documents of their own. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .token_ids import byte_bpe

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(vocabulary: str, capacity: int, end_id: int):
    def run(batches):
        encoder = byte_bpe(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows: list[tuple] = []
                for doc, coded in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist(), end_id), strict=True):
                    ids = np.frombuffer(coded, encoder.type).astype("<u4")
                    n = len(ids)
                    ends = range((n - 1) % capacity + 1, n + 1, capacity)
                    start = 0
                    for k, end in enumerate(ends):
                        rows.append((doc, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                        start = end
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document; only documents of more than ``capacity`` ids have several, all but the first full."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pieces(vocabulary, capacity, end_id), PIECES)


# --- The plan: from a histogram of lengths to bin patterns --------------------------------------------------------


def _largest(sizes: list[int], limit: int) -> int:
    """The largest of the sorted ``sizes`` that is at most ``limit``; 0 if none."""
    k = bisect_left(sizes, limit + 1)
    return sizes[k - 1] if k else 0


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fix the bins that dominate all others: patterns with how many bins of each, and the counts that remain.

    For the largest item w, with v the largest other item that fits beside it: nothing fits: {w} alone; w + v fills the
    bin, or two others never fit beside w: {w, v}. Where three others never fit: {w, v} if no pair of others is longer
    than v; {w, v, a}, with a the largest that fits beside both, if the shorter item of every fitting pair is at most a
    (then v and a take the places of any pair's items). Else w is left over. Each rule holds for all equal items at once
    as far as the counts go.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...]) -> None:
        need = defaultdict(int)
        for s in pattern:
            need[s] += 1
        times = min(left[s] // n for s, n in need.items())
        fixed.append((pattern, times))
        for s, n in need.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
                sizes.pop(bisect_left(sizes, s))

    at, before = len(sizes) - 1, 0
    while True:
        if at < 0:  # from the largest again while the last pass has fixed any
            if before == len(fixed):
                return fixed, left
            at, before = len(sizes) - 1, len(fixed)
            continue
        w = sizes[at]
        pattern = _dominating(w, left, sizes, capacity)
        if pattern:
            take(pattern)
            at = bisect_left(sizes, w) - (w not in left)
        else:
            at -= 1


def _dominating(w: int, left: dict[int, int], sizes: list[int], capacity: int) -> tuple[int, ...] | None:
    """The set that dominates all others that hold an item of size w, if one of at most three items is known to."""
    room = capacity - w
    k = bisect_left(sizes, w)
    others = sizes if left[w] > 1 else sizes[:k] + sizes[k + 1 :]
    v = _largest(others, room)
    if not v:
        return (w,)
    least = [s for s in others[:3] for _ in range(min(3, left[s] - (s == w)))][:3]
    if v == room or len(least) < 2 or sum(least[:2]) > room:
        return (w, v)
    if len(least) > 2 and sum(least) <= room:
        return None
    if _best_pair(w, left, others, room) <= v:
        return (w, v)
    rest = others if left[v] - (v == w) > 1 else [s for s in others if s != v]
    a = _largest(rest, room - v)
    # The longest item that can be the shorter one of a fitting pair.
    k = bisect_left(others, room // 2 + 1) - 1
    if k >= 0 and 2 * others[k] <= room and left[others[k]] - (others[k] == w) < 2 and (k + 1 == len(others) or others[k] + others[k + 1] > room):
        k -= 1
    return (w, v, a) if a and (k < 0 or others[k] <= a) else None


def _best_pair(w: int, left: dict[int, int], others: list[int], room: int) -> int:
    """The length of the longest pair of others that fits."""
    best = 0
    for a in others:
        if 2 * a > room or best == room:
            break
        b = _largest(others, room - a)
        if b == a and left[a] - (a == w) < 2:
            k = bisect_left(others, a)
            b = others[k - 1] if k else 0
        if b and a + b > best:
            best = a + b
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: patterns with how many bins of each."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by room left
    rooms: list[int] = []
    full: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], times: int, room: int) -> None:
        if room == 0:
            full.append((pattern, times))
            return
        if not open_bins[room]:
            insort(rooms, room)
        open_bins[room].append((pattern, times))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                each = capacity // size
                if n >= each:
                    put((size,) * each, n // each, capacity - each * size)
                if n % each:
                    put((size,) * (n % each), 1, capacity - n % each * size)
                break
            room = rooms[k]
            pattern, times = open_bins[room].pop()
            if not open_bins[room]:
                rooms.pop(k)
            each = min(room // size, n)
            used = min(times, n // each)
            if used < times:
                put(pattern, times - used, room)
            put(pattern + (size,) * each, used, room - each * size)
            n -= used * each
    return full + [x for group in open_bins.values() for x in group]


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    fixed, over = reduce_dominated(counts, capacity)
    return fixed + best_fit(over, capacity)


# --- Dealing the documents to the plan -----------------------------------------------------------------------------


def pack_pieces(pieces: DataFrame, capacity: int = 2048, salts: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to a table with doc_id, piece, length; the table is read twice, so cut it before."""
    spark = pieces.sparkSession
    salts = salts or max(8, min(4096, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    groups = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most ``capacity`` rows
    slots, sequence = [], 0
    taken: dict[int, int] = defaultdict(int)
    for pattern, times in plan_bins(histogram, capacity):
        at, k = 0, 0
        while k < len(pattern):
            size, each = pattern[k], pattern.count(pattern[k])
            # Items taken[size] .. of this length: bin by bin, ``each`` in a bin.
            slots.append((size, taken[size], each, sequence, at))
            taken[size] += each * times
            at += each * size
            k += each
        sequence += times
    by_length: dict[int, list] = defaultdict(list)
    for size, first, each, seq, at in slots:
        by_length[size].append((first, each, seq, at))
    rows = [(size, [dict(zip(("first", "each", "seq", "at"), s, strict=True)) for s in own]) for size, own in by_length.items()]
    # The plan is bounded by the capacity: some slots for each length.
    plan = F.broadcast(spark.createDataFrame(rows, "length long, slots array<struct<first: long, each: int, seq: long, at: long>>"))
    earlier = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    bases = groups.select("length", "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    own = W.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    numbered = salted.withColumn("_k", F.row_number().over(own) - 1).join(bases, ["length", "_salt"]).withColumn("_k", F.col("_k") + F.col("_base"))
    # The last slot that begins at or before the item's number.
    placed = numbered.join(plan, "length").withColumn("_s", F.expr("element_at(filter(slots, s -> s.first <= _k), -1)"))
    inside = F.col("_k") - F.col("_s.first")
    return placed.select(
        *pieces.columns,
        (F.col("_s.seq") + F.floor(inside / F.col("_s.each"))).cast("bigint").alias("sequence_id"),
        (F.col("_s.at") + F.pmod(inside, F.col("_s.each").cast("bigint")) * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return pack_pieces(cut(token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces"), capacity)
