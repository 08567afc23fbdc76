"""Pages of a large ordered table by offset: files in order, with the number of rows before each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST = 100
ZONES = "file string, first long, rows long"


def write_in_order(rows: DataFrame, order: list[Column | str], path: str, file_rows: int = 1_000_000) -> None:
    """Writes ``rows`` dealt by ranges of ``order``, which should tell all rows apart, and their zones: each file's first
    place and number of rows. Places are 0, 1, ... in order; a file has at most ``file_rows``."""
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed.write.option("maxRecordsPerFile", file_rows).parquet(f"{path}/rows")
    name = F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file")
    files = spark.read.parquet(f"{path}/rows").select(name, "_at").groupBy("file").agg(F.min("_at").alias("_at"), F.count("*").alias("rows"))
    first = F.coalesce(F.sum("rows").over(W.orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a file
    files.select("file", first.alias("first"), "rows", "_at").write.parquet(f"{path}/zones")


def total(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/zones").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def page(spark: SparkSession, path: str, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of a table that write_in_order() has written, with ``rank`` from 1. Only the files that hold it are read, and
    of these the rows between its places, wherever it stands."""
    if not 1 <= limit <= MOST or offset < 0:
        raise ValueError(f"limit must be 1..{MOST} and offset 0 or more")
    zones = spark.read.parquet(f"{path}/zones").where((F.col("first") < offset + limit) & (F.col("first") + F.col("rows") > offset)).collect()  # at most ``limit`` files
    table = spark.read.parquet(f"{path}/rows")
    names, out = [c for c in table.columns if c != "_at"], None
    for z in zones:
        start, stop = max(0, offset - z["first"]), min(z["rows"], offset + limit - z["first"])
        rows = spark.read.schema(table.schema).parquet(f"{path}/rows/{z['file']}").where(F.col("_at").between(z["_at"] + start, z["_at"] + stop - 1))
        rows = rows.select(*names, (F.col("_at") - z["_at"] + z["first"] + 1).alias("rank"))
        out = rows if out is None else out.unionByName(rows)
    return table.select(*names, F.lit(0).cast("bigint").alias("rank")).limit(0) if out is None else out
