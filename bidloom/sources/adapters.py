"""Procurement views over star-schema tables: cards, customers, raw card texts, jobs, labelled rows, score pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.handlers import date_range_text
from ..functions.numbers import money_text
from ..functions.text import normalize_name

NOW = "1998-07-01 12:00:00"

# The codes that card number k takes by k modulo 8.
CODES = ("62.01.29.000", "62.02.20.120, 63.11.1", "62.09", "63.11.13", "26.20", "", None, "62")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.to_timestamp_ntz(F.lit(NOW))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    codes = F.lit(None).cast("string")
    for i, code in enumerate(CODES):
        codes = F.when(k % 8 == i, F.lit(code)).otherwise(codes)
    rank = F.left("o_orderpriority", F.lit(1))
    days = lambda n: F.make_dt_interval(days=(k % n).cast("int"))
    return table(spark, sf_dir, "orders").select(
        k.alias("id"),
        k.cast("string").alias("number"),
        F.when(k % 2 == 0, "portal_a").otherwise("portal_b").alias("source_platform"),
        F.concat(F.lit("https://portal.example/card/"), k.cast("string"), F.lit("/common.html?id="), k.cast("string")).alias("url"),
        F.col("o_custkey").alias("customer_id"),
        F.when(rank.isin("1", "2"), "44-ФЗ").when(rank.isin("3", "4"), "223-ФЗ").alias("law"),
        F.concat(F.lit("Закупка "), F.col("o_orderpriority")).alias("subject"),
        F.col("o_totalprice").alias("nmck"),
        F.col("o_orderdate").alias("publication_date"),
        (F.col("o_orderdate") + days(3)).alias("update_date"),
        (F.col("o_orderdate") + days(40) + F.make_dt_interval(hours=F.lit(15))).alias("deadline"),
        codes.alias("okpd2_codes"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_name").alias("name"), normalize_name("c_name").alias("normalized_name"), F.when(k % 2 == 0, F.lpad(k.cast("string"), 10, "7")).alias("inn"), F.col("c_acctbal").alias("rating"))


def raw_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cards(spark, sf_dir)
    return c.select(
        "id",
        date_range_text("publication_date", "deadline").alias("dates"),
        money_text("nmck").alias("price"),
        F.concat(F.lit("Закон: "), F.coalesce("law", F.lit("ЕЭТП B2B")), F.lit(" (контракт)")).alias("law_block"),
        F.when(F.col("id") % 3 == 0, F.concat((F.col("id") % 30).cast("string"), F.lit(" %"))).when(F.col("id") % 3 == 1, F.concat(F.translate(F.format_number("nmck", 2), ",.", " ,"), F.lit(" Российский рубль (12,5 %)"))).alias("security"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("procurement_id"), F.col("value").alias("priority"), "ts", "event_id", "event_type")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..config import CATEGORIES

    k = F.col("p_partkey")
    category = F.get(F.array(*map(F.lit, CATEGORIES)), (k % 5).cast("int"))
    return table(spark, sf_dir, "part").select(k.cast("string").alias("number"), category.alias("category"), F.col("p_retailprice").alias("nmck"))


def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").cast("string").alias("number"), F.col("p_retailprice").alias("score"))


def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("item_id"), F.least(F.lit(10.0), F.col("o_totalprice") / 50000).alias("expected"), ((k % 101) / 10.0).cast("double").alias("predicted"))
