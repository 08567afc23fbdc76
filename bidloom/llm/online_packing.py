"""Bounded-space online packing: each partition keeps a fixed number of open windows and places documents as they come.

A document's full stretches of ``capacity`` ids are windows of their own. What is left of it goes into the open window
that it fills best; if it fits in none, a new window opens, and if all are open, the fullest is filled up with the head of
the rest and emitted, until the remainder fits. So all emitted windows are full. At a partition's end its open windows are
left over, with their ids: at most ``windows`` times ``capacity`` ids, whatever the partition holds. Leftovers of all
partitions are merged at last: partition after partition they are laid into full windows, by one running sum over the
partitions. The end of the last one is cut at powers of two, lengths that need no padding.

No step shuffles more than the leftovers, and none meets a hot key. The packed pieces are written once, so that a lost task
reads the same rows again and nothing depends on how often it ran.

Null texts are empty documents and hold only the end id; without an end id they have no piece. Repeated rows and null ids
are documents of their own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .token_ids import byte_bpe

PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: part, and the place among the partition's leftovers; ids of leftovers, and of all pieces if they are asked for.
PLACED = f"{PACKED}, part int, left_at long, ids binary"
#: A partition numbers its windows from part << PART_BITS; merged leftovers have negative numbers.
PART_BITS = 36
WINDOWS = 64
SLICE_ROWS = 1024


class OpenWindows:
    """At most ``most`` windows with room left. ``place`` yields (window, offset, start, end) of the pieces of a document."""

    def __init__(self, capacity: int, most: int, first: int = 0):
        self.capacity, self.most, self.next = capacity, most, first
        self.rooms: list[tuple[int, int]] = []  # (room, window), tightest first

    def _open(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, n: int):
        at = 0
        while n - at >= self.capacity:
            yield self._open(), 0, at, at + self.capacity
            at += self.capacity
        while at < n:
            rest = n - at
            k = bisect_left(self.rooms, (rest, -1))
            if k < len(self.rooms):  # best fit
                room, window = self.rooms.pop(k)
            elif len(self.rooms) < self.most:
                room, window = self.capacity, self._open()
            else:  # none fits: the fullest goes
                room, window = self.rooms.pop(0)
            end = at + min(rest, room)
            yield window, self.capacity - room, at, end
            if end - at < room:
                insort(self.rooms, (room - (end - at), window))
            at = end

    def left(self) -> list[int]:
        """The windows that are still open, fullest first."""
        return [window for _, window in self.rooms]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PLACED.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in PLACED.split(", ")]
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _packer(vocabulary: str, capacity: int, windows: int, end_id: int | None, with_ids: bool):
    def run(batches):
        encoder, part = byte_bpe(vocabulary), TaskContext.get().partitionId()
        own = OpenWindows(capacity, windows, part << PART_BITS)
        held: dict[int, list[tuple]] = {}  # pieces of the open windows
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                piece = batch.slice(at, SLICE_ROWS)
                rows: list[tuple] = []
                for doc, coded in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1).to_pylist(), end_id), strict=True):
                    ids = np.frombuffer(coded, encoder.type).astype("<u4")
                    for window, offset, start, end in own.place(len(ids)):
                        raw = ids[start:end].tobytes()
                        row = (doc, start, end - start, zlib.crc32(raw), len(ids), window, offset, part, None, raw)
                        if offset + end - start < capacity:
                            held.setdefault(window, []).append(row)
                        else:
                            whole = [*held.pop(window, ()), row]
                            rows += whole if with_ids else [(*r[:-1], None) for r in whole]
                if rows:
                    yield _rows(rows)
        at, rows = 0, []
        for window in own.left():
            for row in held[window]:
                rows.append((*row[:-2], at, row[-1]))
                at += row[2]
        if rows:
            yield _rows(rows)

    return run


def _ends(total: int, capacity: int) -> list[int]:
    """The ends of the windows of the last ``total`` mod ``capacity`` leftovers: the largest power of two that fits, and so on."""
    ends, at = [], total - total % capacity
    while at < total:
        at += 1 << ((total - at).bit_length() - 1)
        ends.append(at)
    return ends


def _merger(capacity: int, with_ids: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                full = r["total"] - r["total"] % capacity
                starts = [full, *_ends(r["total"], capacity)]
                at, stop, done = r["base"] + r["left_at"], r["base"] + r["left_at"] + r["length"], 0
                while at < stop:
                    if at < full:
                        sequence, begin = at // capacity, at - at % capacity
                        end = begin + capacity
                    else:
                        k = max(k for k, s in enumerate(starts) if s <= at)
                        sequence, begin, end = full // capacity + k, starts[k], starts[k + 1]
                    n = min(stop, end) - at
                    raw = r["ids"][4 * done : 4 * (done + n)]
                    rows.append((r["doc_id"], r["start"] + done, n, zlib.crc32(raw), r["doc_tokens"], -1 - sequence, at - begin, r["part"], r["left_at"], raw if with_ids else None))
                    at, done = at + n, done + n
            if rows:
                yield _rows(rows)

    return run


def pack_online(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 2048,
    end_id: int | None = 1,
    windows: int = WINDOWS,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """PACKED of every piece, and with ``with_ids`` its ids as little-endian unsigned 32-bit integers."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    placed = cut(rows.mapInArrow(_packer(vocabulary, capacity, windows, end_id, with_ids), PLACED), "online-packing")
    left = placed.where("left_at is not null")
    totals = left.groupBy("part").agg(F.sum("length").alias("n"))  # one row for each partition of the input
    bases = totals.select(
        "part",
        F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"),
    )
    merged = left.join(bases, "part").select(*left.columns, "base", "total").mapInArrow(_merger(capacity, with_ids), PLACED)
    columns = [c.split()[0] for c in PACKED.split(", ")] + (["ids"] if with_ids else [])
    return placed.where("left_at is null").select(*columns).unionByName(merged.select(*columns))


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length, ids (array of int) of each packed sequence, from pieces with their ids."""
    laid = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(laid, F.lit("").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("raw"))
    return rows.mapInArrow(_numbers, "sequence_id long, length long, ids array<int>")


def _numbers(batches):
    for batch in batches:
        ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in batch.column("raw").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), batch.column("length"), pa.array(ids, pa.list_(pa.int32()))], ["sequence_id", "length", "ids"])
