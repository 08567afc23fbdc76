"""Scoring jobs: keyed priorities, order of work, leases and results, as batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import METHOD_DEFAULT


def latest_jobs(jobs: DataFrame, order: list[str], key: str = "procurement_id") -> DataFrame:
    """One job for each key; a later one replaces the priority."""
    return jobs.groupBy(key).agg(F.max_by("priority", F.struct(*order)).alias("priority"))


def member(key: Column | str = "procurement_id") -> Column:
    return F.concat(F.lit("proc:"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def work_order(jobs: DataFrame, key: str = "procurement_id") -> DataFrame:
    """Jobs with their member name, highest priority first and of equal ones the greatest name."""
    return jobs.withColumn("member", member(key)).orderBy(F.desc("priority"), F.desc("member"))


def pop_jobs(jobs: DataFrame, n: int = 1) -> DataFrame:
    return work_order(jobs).limit(n)


def enqueueable(cards: DataFrame, default_priority: float) -> DataFrame:
    """Newly inserted cards with a default score become jobs; without a score they get the default priority."""
    fresh = cards.where(F.col("inserted") & (F.col("score_method") == METHOD_DEFAULT) & F.col("id").isNotNull())
    return fresh.select(F.col("id").alias("procurement_id"), F.coalesce("score", F.lit(float(default_priority))).alias("priority"))


def with_default_priority(requests: DataFrame, default_priority: float) -> DataFrame:
    return requests.withColumn("priority", F.coalesce("priority", F.lit(float(default_priority))))


def recover_leases(leases: DataFrame, saved: DataFrame, now: Column, ttl_seconds: int, default_priority: float) -> tuple[DataFrame, DataFrame]:
    """(leases that go on, jobs to queue again): leases as old as the time to live return with their saved priority."""
    stale = F.col("claim_time") <= now - F.make_dt_interval(secs=F.lit(ttl_seconds))
    back = leases.where(stale).join(saved, "member", "left").select("member", F.coalesce("priority", F.lit(float(default_priority))).alias("priority"))
    return leases.where(~stale), back


def valid_results(results: DataFrame) -> DataFrame:
    return results.where(F.col("procurement_id").isNotNull() & F.col("score").isNotNull())


RESULT_SCHEMA = "procurement_id long, score double, fit_score double, p_win double, margin double, score_method string"


def parse_results(raw: DataFrame, value: str = "value") -> DataFrame:
    """Result messages from JSON text; malformed ones and those without id or score drop out."""
    return valid_results(raw.select(F.from_json(F.col(value), RESULT_SCHEMA).alias("r")).select("r.*"))


def result_messages(results: DataFrame) -> DataFrame:
    return results.select(F.to_json(F.struct("procurement_id", "score", "fit_score", "p_win", "margin", "score_method")).alias("value"))
