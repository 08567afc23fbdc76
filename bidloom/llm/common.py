"""Helpers that the operators of this subpackage share: reading, the shared folder, joins on hot keys, ordered buckets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one stands in only in a local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        if current is None:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            current = tempfile.mkdtemp(prefix="bidloom-")
            spark.sparkContext.setCheckpointDir(current)
        folder = current
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/bidloom/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that hold more than one in so many rows are hot. There are fewer hot keys than this, so they can be broadcast.
HOT_SHARE = 4096


def counted_join(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, total: int, how: str = "left") -> tuple[DataFrame, DataFrame]:
    """``rows`` joined to ``facts`` in two parts: the rows of hot keys, and all others.

    ``facts`` has one row a key and in ``size`` how many of the ``total`` rows have it, so that no key is hot unseen. Facts
    of hot keys are broadcast and their rows stay where they are; only keys without many rows are dealt out.
    """
    limit = total // HOT_SHARE + 1
    heavy = F.broadcast(facts.where(F.col(size) > limit))
    hot = rows.join(heavy, keys)
    rest = rows.join(F.broadcast(facts.where(F.col(size) > limit).select(*keys)), keys, "left_anti")
    return hot, rest.join(facts.where(F.col(size) <= limit), keys, how)


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression, so that lambdas in ``body`` don't evaluate it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ordered_bounds(df: DataFrame, key: str, rows_per_bucket: int, most: int = 20_000) -> list:
    """Values of an integer ``key`` that cut its rows into buckets of about equal size.

    Only (at most ``most``) boundary values reach the driver. The same boundaries come back for the same table, unlike
    those that repartitionByRange() samples.
    """
    n = df.select(F.count(key)).first()[0]
    parts = max(1, min(most, n // rows_per_bucket))
    if parts == 1:
        return []
    cuts = [i / parts for i in range(1, parts)]
    found = df.select(F.percentile_approx(key, cuts, max(10_000, 20 * parts)).alias("b")).first()["b"]
    return sorted(set(found or []))


def bucket_of(key: Column, bounds: list) -> Column:
    """The number of boundaries below ``key``: bucket b holds bounds[b - 1] < key <= bounds[b]; null is in bucket 0."""
    if not bounds:
        return F.lit(0)
    width = max(1, round(len(bounds) ** 0.5))
    fine = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    coarse = F.array(*[F.lit(b).cast("bigint") for b in bounds[width - 1 :: width]])
    below = lambda array: F.size(F.filter(array, lambda b: b < key))
    found = let(below(coarse), lambda c: c * width + below(F.slice(fine, c * width + 1, F.lit(width))))
    return F.when(key.isNull(), 0).otherwise(found)
