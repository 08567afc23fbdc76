"""JSON output: tables, and reports of an evaluation; times in ISO form at any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISO = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss", "ignoreNullFields": "false"}


def iso_json(c: Column) -> Column:
    """A nested value as JSON text whose times are in ISO form; nulls stay."""
    return F.to_json(c, ISO)


def write_dataset(rows: DataFrame, path: str) -> None:
    """A table as lines of JSON, one file for each partition."""
    rows.write.mode("overwrite").options(**ISO).json(path)


def evaluation_report(metrics: DataFrame, items: DataFrame) -> DataFrame:
    """value: lines of a report, the metrics first, then each item; written as text it stays readable at any size."""
    head = metrics.select(F.lit(0).alias("_o"), iso_json(F.struct(F.struct(*metrics.columns).alias("metrics"))).alias("value"))
    lines = items.select(F.lit(1).alias("_o"), iso_json(F.struct(F.struct(*items.columns).alias("item"))).alias("value"))
    return head.unionByName(lines).select("value")
