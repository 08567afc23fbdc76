"""Exact deduplication through an extendible-hash index in shared files.

Each text's 64-bit hash is its key. The directory is a list of hash prefixes: it starts with one bucket and doubles
(one more bit of the prefix) wherever a bucket holds more keys than its capacity, until no bucket is overfull or the
bits end. Equal texts of a slice of rows are combined where they are read, then every entry (key, text, rows, largest id)
is dealt to the task that owns its bucket. An owner reads its key ranges in order, chains the entries of one key and
compares their bytes: each different text of a chain has a slot, which sums up the rows of its entries. The index is the
Parquet table of all slots in the shared folder: key, slot, the text's sha256, rows, largest id. A row finds its group by
its key and, in the key's chain, its sha256; slots of a single row need no look-up.

Null texts count as empty and equal to empty ones. Of equal texts the row with the largest id stays; rows that repeat an
id and a text are one document, all marked kept by ``duplicate_groups``, of which ``drop_exact_duplicates`` keeps one.
Null ids stay only if no row of the group has an id. Empty tables give empty results; other columns are ignored by
``duplicate_groups`` and kept by ``drop_exact_duplicates``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted_join, cut, shared_path

BUCKET_ENTRIES = 2_500
TASK_BUCKETS = 4
MOST_BUCKETS = 1 << 20
MOST_BITS = 40
STEP_BITS = 8
SLICE_ROWS = 2_048

ENTRY = "bucket int, key long, text string, n long, keep_id long"
SLOT = "key long, slot int, text_sha256 string, keep_id long, group_size long"


def text_key(text: Column) -> Column:
    """The 64-bit key: a hash of the bytes and their number."""
    return F.xxhash64(text, F.octet_length(text))


def hash_prefix(key: Column, bits: int) -> Column:
    """The first bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("bigint")


def build_directory(keys: DataFrame, entries: int = BUCKET_ENTRIES) -> list[tuple[int, int]]:
    """(depth, prefix) of every bucket. ``keys`` has one row for each different key.

    A round counts the keys under the overfull buckets, STEP_BITS deeper; the driver sees only these counts and splits on
    from them. Buckets hold ``entries`` keys, or more where there would be over MOST_BUCKETS buckets.
    """
    done: list[tuple[int, int]] = []
    overfull, depth = {0: keys.count()}, 0
    entries = max(entries, 2 * overfull[0] // MOST_BUCKETS)
    if overfull[0] <= entries:
        return [(0, 0)]
    while overfull:
        deeper = min(MOST_BITS, depth + STEP_BITS)
        own = keys
        if depth:
            own = keys.where(hash_prefix(F.col("key"), depth).isin(list(overfull)))
        counts = {r["p"]: r["n"] for r in own.groupBy(hash_prefix(F.col("key"), deeper).alias("p")).agg(F.count("*").alias("n")).collect()}
        level = {p: (depth, p) for p in overfull}
        while level and depth < deeper:  # doubling: the two halves of each overfull bucket
            depth += 1
            halves = [2 * p + half for p in level for half in (0, 1)]
            totals = dict.fromkeys(halves, 0)
            for p, n in counts.items():
                if (q := p >> (deeper - depth)) in totals:
                    totals[q] += n
            done += [(depth, q) for q, n in totals.items() if n <= entries or depth == MOST_BITS]
            level = {q: n for q, n in totals.items() if n > entries and depth < MOST_BITS}
        overfull = level
    return sorted(done, key=lambda b: b[1] << (64 - b[0]))


def bucket_starts(directory: list[tuple[int, int]]) -> np.ndarray:
    """The first key of each bucket's range, ascending."""
    return np.array([prefix << (64 - depth) if depth else 0 for depth, prefix in directory], np.uint64)


def buckets_of(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return (np.searchsorted(starts, keys.view(np.uint64), side="right") - 1).astype(np.int32)


def _combiner(starts: np.ndarray):
    """Entries of the equal texts of each slice of rows, with the buckets that own them."""

    def run(batches):
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            entries = pa.Table.from_batches([batch]).group_by(["key", "text"]).aggregate([("doc_id", "max"), ("doc_id", "count", pc.CountOptions(mode="all"))]).combine_chunks()
            key = entries.column("key").combine_chunks()
            columns = [pa.array(buckets_of(np.asarray(key, np.int64), starts)), key, entries.column("text").combine_chunks(), entries.column("doc_id_count").combine_chunks(), entries.column("doc_id_max").combine_chunks()]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "key", "text", "n", "keep_id"])

    return run


def _slots(key: int | None, chain: list) -> list[tuple]:
    return [(key, k, hashlib.sha256(text).hexdigest(), keep, n) for k, (text, n, keep) in enumerate(chain)]


def _owner(batches):
    """The slots of an owner's entries, which come in the order of their keys; holds one key's chain at a time."""
    key, chain = None, []  # of each slot: bytes, rows, largest id
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
    for batch in batches:
        rows: list[tuple] = []
        texts = batch.column(2)
        for i, (own, n, keep) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 3, 4)), strict=True)):
            if own != key:
                rows += _slots(key, chain)
                key, chain = own, []
            text = texts[i].as_buffer()
            for slot in chain:
                if slot[0].equals(text):
                    slot[1] += n
                    slot[2] = keep if slot[2] is None or keep is not None and keep > slot[2] else slot[2]
                    break
            else:
                chain.append([text, n, keep])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "slot", "text_sha256", "keep_id", "group_size"])
    if chain:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*_slots(key, chain), strict=True), kinds, strict=True)], ["key", "slot", "text_sha256", "keep_id", "group_size"])


def build_index(rows: DataFrame, keys: DataFrame, entries: int = BUCKET_ENTRIES) -> DataFrame:
    """The index over ``rows`` (doc_id, key, text): SLOT, one row for each different text. ``keys`` has the rows' keys."""
    directory = build_directory(keys.select("key").distinct(), entries)
    dealt = rows.select("doc_id", "key", "text").mapInArrow(_combiner(bucket_starts(directory)), ENTRY)
    # A task owns TASK_BUCKETS neighbouring ranges.
    owner = (F.col("bucket") / TASK_BUCKETS).cast("int")
    owned = dealt.repartitionById(math.ceil(len(directory) / TASK_BUCKETS), owner).sortWithinPartitions("bucket", "key")
    path = shared_path(rows.sparkSession, "exact-index")
    owned.mapInArrow(_owner, SLOT).write.parquet(path)
    return rows.sparkSession.read.schema(SLOT).parquet(path)


def look_up(rows: DataFrame, index: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with key and text_sha256, in two parts, with keep_id and group_size; null for texts of a single row."""
    chains = index.where("group_size > 1").drop("slot")
    return counted_join(rows, chains, ["key", "text_sha256"], "group_size", total)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, text) of every row, and a written table of doc_id, key, text_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text")).withColumn("key", text_key(F.col("text")))
    return rows, cut(rows.select("doc_id", "key", F.sha2("text", 256).alias("text_sha256")), "exact-keys")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", entries: int = BUCKET_ENTRIES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    rows, keyed = _keyed(docs, id_col, text_col)
    hot, rest = look_up(keyed, build_index(rows, keyed, entries), keyed.count())
    found, alone = hot.unionByName(rest), F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", entries: int = BUCKET_ENTRIES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows, keyed = _keyed(docs, id_col, text_col)
    index = build_index(rows, keyed, entries)
    names = {"key": "__exact_key", "text_sha256": "__exact_sha", "keep_id": "__exact_keep", "group_size": "__exact_size"}
    chains = index.where("group_size > 1").drop("slot").withColumnsRenamed(names)
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = counted_join(docs.withColumns({"__exact_key": text_key(text), "__exact_sha": F.sha2(text, 256)}), chains, ["__exact_key", "__exact_sha"], "__exact_size", keyed.count())
    stay = F.col("__exact_size").isNull() | F.col(id_col).cast("bigint").eqNullSafe(F.col("__exact_keep"))
    kept = [p.where(stay).dropDuplicates(["__exact_key", "__exact_sha"]).select(*docs.columns) for p in parts]
    return kept[0].unionByName(kept[1])
