"""Streams: incremental card inserts, the keyed job queue with leases, results and alerts.

Each micro-batch runs the batch operators; what they append goes to tables, so a restart from the checkpoint gives
each row at least once and the anti join on the cards' keys keeps repeats out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.jobs import parse_results
from ..operators.store import new_cards, watermarks
from ..sources.committed import CommittedTable
from ..sources.shared import cut


def file_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet table of a folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", f"{name}*.parquet").parquet(folder)


def insert_new_cards(stream: DataFrame, store_path: str, checkpoint: str, order: str = "id", after: Callable[[DataFrame], None] | None = None, resume: tuple[Column, int] | None = None, period: str | None = None) -> StreamingQuery:
    """Appends the cards of each micro-batch that the store at ``store_path`` lacks; ``after`` gets them too.

    The store is read anew for each batch, only its key columns. A batch that is run again finds its rows there. With
    ``resume`` (now, days) a platform goes on from the day of its latest update in the store, or from so many days before
    now where it has none; that day is read again, and the keys keep its repeats out. With a ``period`` ("1 hour") passes
    follow one another until the query is stopped, else one pass takes what there is.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        try:
            stored = spark.read.parquet(store_path)
        except Exception as missing:  # the first batch makes the store
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            stored = rows.limit(0)
        if resume is not None:
            rows = newer_than_store(stored, rows, *resume)
        # Kept apart from the store, as it is read after the store has changed.
        fresh = cut(new_cards(stored, rows, order), "fresh")
        fresh.write.mode("append").parquet(store_path)
        if after is not None:
            after(fresh)

    out = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=period) if period else out.trigger(availableNow=True)).start()


def insert_committed(stream: DataFrame, store: CommittedTable, checkpoint: str, order: str = "id", after: Callable[[DataFrame], None] | None = None, period: str | None = None, compact_files: int = 8) -> StreamingQuery:
    """insert_new_cards() into a committed table: a micro-batch reads the key hashes of the buckets that its keys fall in,
    and appends in one commit that bears its number; run again it adds nothing, and ``after`` gets no row twice in that case.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        _, fresh = store.insert(rows, order, "inserts", batch_id)
        if after is not None:
            after(fresh)
        store.compact(compact_files)

    out = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=period) if period else out.trigger(availableNow=True)).start()


def newer_than_store(stored: DataFrame, rows: DataFrame, now: Column, default_days: int) -> DataFrame:
    """The rows of each platform from the day of its watermark on; rows without an update time stay."""
    marks = watermarks(stored, rows.select("source_platform").distinct(), now, default_days).withColumnRenamed("watermark", "_mark")
    kept = rows.join(F.broadcast(marks), "source_platform", "left")  # one row for each platform
    return kept.where(F.coalesce(F.to_date("update_date") >= F.to_date("_mark"), F.lit(True))).select(*rows.columns)


def enriched(jobs: DataFrame, cards: DataFrame, key: str = "procurement_id") -> DataFrame:
    """Jobs, a stream or a micro-batch, with the fields of their cards; jobs without a card stay, with nulls."""
    return jobs.join(cards.withColumnRenamed("id", key), key, "left")


def score_jobs(stream: DataFrame, cards: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """The worker: each micro-batch's jobs are enriched and scored, and the results published to its own folder under
    ``path``. Jobs whose card is missing give no result. A batch that is run again overwrites what it wrote."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        found = enriched(rows, cards.withColumn("_card", F.lit(True))).where("_card").drop("_card")
        score(found).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_jobs_stream(stream: DataFrame, order: list[str], path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Keeps the last priority of each key as state; each micro-batch writes the keys that it changed to its own folder
    under ``path``. A batch that is run again overwrites what it wrote."""
    latest = stream.groupBy("procurement_id").agg(F.max_by("priority", F.struct(*order)).alias("priority"))
    stream.sparkSession.createDataFrame([], latest.schema).write.mode("ignore").parquet(f"{path}/batch=-1")  # read where no batch came

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    out = latest.writeStream.outputMode("update").foreachBatch(batch).trigger(availableNow=True)
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()


def latest_jobs_table(spark: SparkSession, path: str) -> DataFrame:
    """procurement_id, priority: the last version of each key that ``latest_jobs_stream`` wrote under ``path``."""
    return spark.read.parquet(path).groupBy("procurement_id").agg(F.max_by("priority", "batch").alias("priority"))


LEASE_OUT = "member string, event string, priority double"
LEASE_STATE = "expires long, priority double"


def lease_events(stream: DataFrame, ttl_seconds: int, default_priority: float, delay: str = "0 seconds") -> DataFrame:
    """member, event (claimed, released or requeued), priority of a stream of member, kind, at timestamp, priority.

    A claim sets a timer on the events' own time; a release ends it; a lease whose timer the watermark passes is queued
    again with the priority that it was claimed with. (A timer on the clock would keep a bounded run from ending.)
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator, state: GroupState):
        import pandas as pd

        out, rows = [], []
        for frame in frames:
            rows += zip(frame["at"], frame["kind"], frame["priority"], strict=True)
        expires, lease = state.get if state.exists else (None, None)
        if state.hasTimedOut:
            out.append((key[0], "requeued", lease))
            expires = None
        for at, kind, priority in sorted(rows, key=lambda r: (r[0], r[1] != "release")):
            ms = at.value // 1_000_000
            if expires is not None and expires <= ms:  # timed out between two events of one batch
                out.append((key[0], "requeued", lease))
                expires = None
            if kind == "claim":
                expires, lease = ms + ttl_seconds * 1000, default_priority if pd.isna(priority) else float(priority)
                out.append((key[0], "claimed", lease))
            elif expires is not None:
                out.append((key[0], "released", lease))
                expires = None
        if expires is not None and expires <= state.getCurrentWatermarkMs():
            out.append((key[0], "requeued", lease))
            expires = None
        if expires is not None:
            state.update((expires, lease))
            state.setTimeoutTimestamp(expires)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["member", "event", "priority"])

    rows = stream.select("member", "kind", "at", "priority").withWatermark("at", delay)
    return rows.groupBy("member").applyInPandasWithState(step, LEASE_OUT, LEASE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def result_stream(stream: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str, retries: int = 3) -> StreamingQuery:
    """Hands the valid results of each micro-batch to ``apply``, again up to ``retries`` times if it fails."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        for attempt in range(1, retries + 1):
            try:
                return apply(parse_results(rows))
            except Exception:
                if attempt == retries:
                    raise

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_platforms(runs: dict[str, Callable[[], None]]) -> dict[str, str]:
    """Runs one pass of each platform; one that fails doesn't stop the others. Returns the failures' texts."""
    failed = {}
    for platform, run in runs.items():
        try:
            run()
        except Exception as error:  # reported to the caller
            failed[platform] = str(error)
    return failed
