"""Idempotent inserts and keyed updates of card tables: functions from old table and requests to new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_half
from .filters import has_keys
from .identity import first_by

KEYS = ["number", "source_platform"]


def new_cards(existing: DataFrame, incoming: DataFrame, order: str = "id") -> DataFrame:
    """Incoming rows with both keys that the store lacks; of rows with equal keys the first by ``order``."""
    keyed = has_keys(incoming, KEYS).join(existing.select(*KEYS), KEYS, "left_anti")
    one = keyed.withColumn("_key", F.struct(*KEYS))
    return first_by(one, "_key", order).select(*incoming.columns)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, order: str = "id") -> DataFrame:
    """The store after the insert, with ``inserted`` telling the new rows; stored rows never change."""
    return existing.withColumn("inserted", F.lit(False)).unionByName(new_cards(existing, incoming, order).withColumn("inserted", F.lit(True)))


def with_code_fallback(cards: DataFrame) -> DataFrame:
    """okpd2_codes and kpgz_codes from their singular twins where they are missing or blank."""
    for many, one in (("okpd2_codes", "okpd2_code"), ("kpgz_codes", "kpgz_code")):
        if many in cards.columns and one in cards.columns:
            cards = cards.withColumn(many, F.coalesce(F.nullif(F.col(many), F.lit("")), F.col(one))).drop(one)
    return cards


def update_scores(cards: DataFrame, results: DataFrame, key: str = "procurement_id", order: str = "seq") -> DataFrame:
    """Score and method of the last result of each id, rounded; ids without a card change nothing."""
    last = results.groupBy(F.col(key).alias("id")).agg(F.max_by(F.struct(F.col("score").alias("s"), F.col("score_method").alias("m")), order).alias("_u"))
    hit = F.col("_u").isNotNull()
    rows = cards.join(last, "id", "left")
    return rows.withColumns({"score": F.when(hit, round_half("_u.s")).otherwise(F.col("score")), "score_method": F.when(hit, F.col("_u.m")).otherwise(F.col("score_method"))}).drop("_u").select(*cards.columns)


def update_given(rows: DataFrame, changes: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Overwrites ``columns`` with the changes that aren't null."""
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = rows.join(new, key, "left").withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns})
    return out.select(*rows.columns)


def set_values(rows: DataFrame, changes: DataFrame, column: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows with ``column`` set, nulls too; key and ``found`` for every change)."""
    new = changes.select(key, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    out = rows.join(new, key, "left").withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).select(*rows.columns)
    found = changes.select(key).join(rows.select(key, F.lit(True).alias("_f")), key, "left").select(key, F.col("_f").isNotNull().alias("found"))
    return out, found


def watermarks(cards: DataFrame, platforms: DataFrame, now, default_days: int) -> DataFrame:
    """source_platform, watermark for every platform: the latest update, or now less the default."""
    latest = cards.groupBy("source_platform").agg(F.max("update_date").alias("latest"))
    return platforms.join(latest, "source_platform", "left").select("source_platform", F.coalesce("latest", now - F.make_dt_interval(F.lit(default_days))).alias("watermark"))


def clear(**tables: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(empty tables of the same schemas, how many rows each had)."""
    counts = None
    for name, df in tables.items():
        n = df.agg(F.count("*").alias("deleted")).select(F.lit(name).alias("table_name"), "deleted")
        counts = n if counts is None else counts.unionByName(n)
    return {n: df.limit(0) for n, df in tables.items()}, counts


def merge_details(list_rows: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Details override list values, with nulls too, wherever a detail row exists."""
    both = [c for c in details.columns if c in list_rows.columns and c != key]
    d = details.withColumnsRenamed({c: f"_{c}" for c in both}).withColumn("_has", F.lit(True))
    out = list_rows.join(d, key, "left").withColumns({c: F.when(F.col("_has"), F.col(f"_{c}")).otherwise(F.col(c)) for c in both})
    return out.drop("_has", *[f"_{c}" for c in both])


def merge_extra(rows: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Extra values override only where they aren't null; columns that only ``extra`` has are added."""
    both = [c for c in extra.columns if c in rows.columns and c != key]
    e = extra.withColumnsRenamed({c: f"_{c}" for c in both})
    return rows.join(e, key, "left").withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in both}).drop(*[f"_{c}" for c in both])


def look_up_once(rows: DataFrame, key: str, enrich) -> DataFrame:
    """Enriches the different keys once each (``enrich``: a frame of keys to one row a key) and joins the result back."""
    return rows.join(enrich(rows.select(key).where(F.col(key).isNotNull()).distinct()), key, "left")
