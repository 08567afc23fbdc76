"""The job queue as a stream: priorities, claims and leases are rows of one committed table, a micro-batch is one step.

A step sets the priorities of the jobs that its events enqueue, ends the leases of those they finish, queues again those
whose lease has run out, with the priority that they were claimed with, and then claims the next jobs: highest priority
first and of equal ones the greatest name. Each of its two commits bears the batch's number, so a step that is run again
finds what it has done; what it claimed is told by the rows themselves and handed out again.

The next jobs are found by the heads of the table's files. The manifest knows the highest priority of each: the first n jobs
stand in the n files with the highest ones, and in those with the same as the last of these. Leases that have run out stand in files
whose earliest claim is old enough. So a step reads and writes no more files than it has events, claims and stale leases.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.jobs import member
from ..sources.committed import CommittedTable
from ..sources.shared import cut

STATE = "procurement_id long, priority double, claimed_at timestamp_ntz, claimed_priority double, claim_batch long"
EVENTS = "kind string, procurement_id long, priority double, at timestamp_ntz, seq long"


def open_queue(spark: SparkSession, path: str, buckets: int = 64) -> CommittedTable:
    """procurement_id, priority of queued jobs, claimed_at and claimed_priority of leases; a job may be both."""
    return CommittedTable.create(spark, path, STATE, ["procurement_id"], buckets, ("priority", "claimed_at"))


def _seconds(at: datetime) -> float:
    from datetime import timezone

    return at.replace(tzinfo=timezone.utc).timestamp()


def apply_events(queue: CommittedTable, events: DataFrame, now: datetime, ttl_seconds: int, default_priority: float, batch: int) -> None:
    """One commit: enqueue and finish events, and leases that have run out at ``now``."""
    asked = events.groupBy("procurement_id").agg(
        F.max_by(F.coalesce("priority", F.lit(float(default_priority))), F.when(F.col("kind") == "enqueue", F.struct("at", "seq"))).alias("_new"),
        F.coalesce(F.bool_or(F.col("kind") == "finish"), F.lit(False)).alias("_finished"),
    )
    asked = asked.where("procurement_id is not null").select("procurement_id", F.when(F.col("_new").isNotNull(), F.col("_new")).alias("_new"), "_finished", F.lit(False).alias("_stale"))
    commit = queue.commit()
    limit = _seconds(now) - ttl_seconds
    old = [f"{queue.path}/{r['file']}" for r in queue.manifest(commit).where(F.get("low", F.lit(1)) <= limit).collect()]
    stale = queue._rows(commit, old).where(F.col("claimed_at") <= F.lit(now) - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    stale = stale.select("procurement_id", F.lit(None).cast("double").alias("_new"), F.lit(False).alias("_finished"), F.lit(True).alias("_stale"))
    both = asked.unionByName(stale).groupBy("procurement_id").agg(F.max("_new").alias("_new"), F.bool_or("_finished").alias("_finished"), F.bool_or("_stale").alias("_stale"))

    def combine(rows: DataFrame, changes: DataFrame) -> DataFrame:
        found = rows.withColumn("_there", F.lit(True)).join(changes, "procurement_id", "full")
        back = F.coalesce(F.col("_stale") & ~F.col("_finished"), F.lit(False))
        ended = F.coalesce(F.col("_stale") | F.col("_finished"), F.lit(False))
        priority = F.coalesce(F.col("_new"), F.when(back, F.coalesce("claimed_priority", F.lit(float(default_priority)))), F.col("priority"))
        none = lambda c: F.when(~ended, F.col(c)).alias(c)
        kept = found.select("procurement_id", priority.alias("priority"), none("claimed_at"), none("claimed_priority"), none("claim_batch"))
        return kept.where("priority is not null or claimed_at is not null")

    queue.merge(both, combine, "events", batch)


def heads(queue: CommittedTable, n: int) -> list[str]:
    """The files among which the n first jobs are: those with the n highest priorities, and equal ones."""
    commit = queue.commit()
    rows = queue.manifest(commit).select("file", F.get("high", F.lit(0)).alias("high")).where("high is not null")
    first = rows.orderBy(F.desc("high")).limit(n).agg(F.min("high").alias("least"), F.count("*").alias("n")).first()
    if first["n"] == n:
        rows = rows.where(F.col("high") >= first["least"])
    return [f"{queue.path}/{r['file']}" for r in rows.collect()]


def _claimed_by(queue: CommittedTable, batch: int) -> list[int]:
    """The buckets that the batch's claims fell in; commits of other kinds may have come after."""
    touched: tuple[int, ...] = ()
    for version in reversed(queue.versions()):
        commit = queue.commit(version)
        if commit.writers.get("claims") != batch:
            break
        touched = commit.touched
    return list(touched)


def claim(queue: CommittedTable, n: int, now: datetime, batch: int) -> DataFrame:
    """procurement_id, priority, in order: the n next jobs, now leased; those of the batch if it has claimed already."""
    commit = queue.commit()
    if n > 0 and not queue._done(commit, "claims", batch):
        first = queue._rows(commit, heads(queue, n)).where("priority is not null").orderBy(F.desc("priority"), F.desc(member())).limit(n)
        taken = first.select("procurement_id", F.col("priority").alias("_taken"))

        def combine(rows: DataFrame, changes: DataFrame) -> DataFrame:
            found = rows.join(changes, "procurement_id", "left")
            hit = F.col("_taken").isNotNull()
            new = {"priority": F.when(~hit, F.col("priority")), "claimed_at": F.when(hit, F.lit(now)).otherwise(F.col("claimed_at")), "claimed_priority": F.coalesce("_taken", "claimed_priority")}
            return found.withColumns(new | {"claim_batch": F.when(hit, F.lit(batch).cast("bigint")).otherwise(F.col("claim_batch"))}).drop("_taken")

        queue.merge(taken, combine, "claims", batch)
    rows = queue.read(buckets=_claimed_by(queue, batch))
    return rows.where(F.col("claim_batch") == batch).select("procurement_id", F.col("claimed_priority").alias("priority")).orderBy(F.desc("priority"), F.desc(member()))


def step(queue: CommittedTable, events: DataFrame, batch: int, n: int, ttl_seconds: int, default_priority: float, now: datetime | None = None) -> DataFrame:
    """One micro-batch of EVENTS; the jobs that it claims. ``now`` is the latest event's time, unless given."""
    own = cut(events.select(*[c.split()[0] for c in EVENTS.split(", ")]), "queue-events")
    now = now or own.agg(F.max("at")).first()[0] or datetime(1970, 1, 1)
    apply_events(queue, own, now, ttl_seconds, default_priority, batch)
    return claim(queue, n, now, batch)


def run_queue(
    stream: DataFrame,
    queue: CommittedTable,
    checkpoint: str,
    handle: Callable[[DataFrame, int], None],
    n: int = 1,
    ttl_seconds: int = 600,
    default_priority: float = 0.0,
    period: str | None = None,
    compact_files: int = 8,
) -> StreamingQuery:
    """Each micro-batch is a step; ``handle`` gets its claims, and gets them again if the batch is run again. With a
    ``period`` steps follow one another until the query is stopped, else there is one for each batch of what there is."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        handle(step(queue, rows, batch_id, n, ttl_seconds, default_priority), batch_id)
        queue.compact(compact_files)

    out = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=period) if period else out.trigger(availableNow=True)).start()
