"""Ordinal ranks over whole tables without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import cut

#: A part's rows are numbered by monotonically_increasing_id(): the part's number above so many bits.
PLACE_BITS = 33


def in_parts(rows: DataFrame, order: list[Column | str]) -> tuple[DataFrame, DataFrame]:
    """(rows with _part and _place, written in order; one row for each part: _part, _before, the rows of the parts before).

    Spark deals the rows by ranges of the whole order, ties included, so equal values spread over parts like others. There
    are as many parts as the session's shuffle has, or fewer where they would be small.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = cut(placed, "in-order")
    parts = placed.withColumns({"_part": F.shiftright("_at", PLACE_BITS), "_place": F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1)}).drop("_at")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a part
    return parts, sizes.select("_part", before.alias("_before"))


def ordinal_rank(rows: DataFrame, value: str, tie: str, out: str) -> DataFrame:
    """Adds ``out``: 1, 2, ... by ``value`` then ``tie``, nulls first: the rows in the parts before and the place in the own one."""
    parts, before = in_parts(rows, [F.asc_nulls_first(value), F.asc_nulls_first(tie)])
    ranked = parts.join(before, "_part").withColumn(out, F.col("_before") + F.col("_place") + 1)
    return ranked.select(*rows.columns, out)


def top_ranks(rows: DataFrame, order: list, out: str = "rank") -> DataFrame:
    """Adds the place in ``order`` to a result that a limit has made small already."""
    return rows.withColumn(out, F.row_number().over(W.orderBy(*order)))


def reverse_ties(ranked: DataFrame, value: str, rank: str, out: str) -> DataFrame:
    """Turns the order of rows with equal values around: the last of them comes first."""
    ends = ranked.groupBy(value).agg(F.min(rank).alias("_low"), F.max(rank).alias("_high"))
    return ranked.join(ends, value).withColumn(out, F.col("_low") + F.col("_high") - F.col(rank)).drop("_low", "_high")
