"""Stop conditions, cutoffs, searches and paging."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SearchCriteria, StopConditions
from ..functions.text import digits

DAY_MICROS = 86_400_000_000.0


def has_link(rows: DataFrame, link: str = "href") -> DataFrame:
    return rows.where(F.col(link).isNotNull() & (F.col(link) != ""))


def has_keys(rows: DataFrame, keys: Iterable[str] = ("number", "source_platform")) -> DataFrame:
    return reduce(lambda df, k: df.where(F.coalesce(F.col(k), F.lit("")) != ""), keys, rows)


def days_left(deadline: Column, now: Column) -> Column:
    return (F.unix_micros(deadline.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / DAY_MICROS


def stop_conditions(rows: DataFrame, now: Column, stop: StopConditions, deadline: str = "deadline") -> DataFrame:
    """Drops rows past their deadline or too near to it; rows without a deadline stay."""
    if not stop.enabled:
        return rows
    until = F.col(deadline)
    if stop.deadline_not_expired:
        rows = rows.where(~F.coalesce(until < now, F.lit(False)))
    if stop.min_deadline_days is not None:
        rows = rows.where(~F.coalesce(days_left(until, now) < stop.min_deadline_days, F.lit(False)))
    return rows


def older_than_cutoff(published: Column, cutoff: Column) -> Column:
    """By day; null where either is null."""
    return F.to_date(published) < F.to_date(cutoff)


def take_while_newer(rows: DataFrame, older: Column, order: list[str]) -> DataFrame:
    """The rows before the first older one in ``order``: its place is one aggregate, so nothing is sorted."""
    place = F.struct(*order)
    first = rows.where(F.coalesce(older, F.lit(False))).agg(F.min(place).alias("_first"))
    return rows.join(F.broadcast(first), F.lit(True)).where(F.col("_first").isNull() | (place < F.col("_first"))).drop("_first")  # one row


def search_cards(cards: DataFrame, customers: DataFrame, number: str | None = None, source_platform: str | None = None, okpd2: str | None = None, customer: str | None = None) -> DataFrame:
    """Conditions that are given, all together; customers are joined only for a condition on their name."""
    if number:
        cards = cards.where(F.col("number").ilike(f"%{number}%"))
    if source_platform:
        cards = cards.where(F.col("source_platform") == source_platform)
    if okpd2:
        cards = cards.where(F.col("okpd2_codes").ilike(f"%{okpd2}%"))
    if customer:
        named = customers.where(F.col("name").ilike(f"%{customer}%")).select(F.col("id").alias("customer_id"))
        cards = cards.join(named, "customer_id", "left_semi")
    return cards


def search_customers(customers: DataFrame, name: str | None = None, inn: str | None = None) -> DataFrame:
    if name:
        customers = customers.where(F.col("name").ilike(f"%{name}%"))
    if inn:
        customers = customers.where(F.col("inn") == inn)
    return customers


def with_customer_name(cards: DataFrame, customers: DataFrame, name: str = "customer") -> DataFrame:
    return cards.join(customers.select(F.col("id").alias("customer_id"), F.col("name").alias(name)), "customer_id", "left")


def page(rows: DataFrame, limit: int = 20, offset: int = 0, order: str = "id", descending: bool = True) -> DataFrame:
    """A page with ``rank`` from 1; limits as the interface sets them: 1..100 and 0 or more."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1..100 and offset 0 or more")
    key = F.desc(order) if descending else F.asc(order)
    cut = rows.orderBy(key).offset(offset).limit(limit)
    return cut.withColumn("rank", F.row_number().over(W.orderBy(key)) + offset)  # at most 100 rows


def page_count(total: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / size)).cast("bigint")


def by_criteria(cards: DataFrame, criteria: SearchCriteria, cutoff: Column | None = None, now: Column | None = None) -> DataFrame:
    """The business criteria as filters; those that aren't given add none. Catalyst pushes them to the scan."""
    if cutoff is not None:
        cards = cards.where(F.to_date("publication_date") >= F.to_date(cutoff))
    if now is not None:
        cards = cards.where(F.to_date("deadline") >= F.to_date(now))
    if criteria.okpd_codes:
        wanted = ["".join(ch for ch in c if ch.isdigit()) for c in criteria.okpd_codes]
        own = F.transform(F.split("okpd2_codes", ","), lambda c: digits(c))
        cards = cards.where(F.exists(own, lambda c: reduce(lambda a, b: a | b, [F.startswith(c, F.lit(w)) for w in wanted])))
    laws = [law for flag, law in ((criteria.fz44, "44-ФЗ"), (criteria.fz223, "223-ФЗ")) if flag]
    if laws:
        cards = cards.where(F.col("law").isin(laws))
    if criteria.nmck_min is not None:
        cards = cards.where(F.col("nmck") >= criteria.nmck_min)
    if criteria.nmck_max is not None:
        cards = cards.where(F.col("nmck") <= criteria.nmck_max)
    return cards


def valid_rows(rows: DataFrame, categories: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): amounts of 0 or more and known categories."""
    good = F.coalesce((F.col("nmck") >= 0) & F.col("category").isin(list(categories)), F.lit(False))
    return rows.where(good), rows.where(~good)


def split_files(rows: DataFrame, files: str = "files", keyword: str = "техническое задание") -> DataFrame:
    """Adds technical_spec_name and _url (of the first file named so) and files_json (the files not named so)."""
    named = lambda f: F.coalesce(F.contains(F.lower(f["name"]), F.lit(keyword)), F.lit(False))
    spec = F.get(F.filter(F.col(files), named), F.lit(0))
    others = F.filter(F.col(files), lambda f: ~named(f))
    return rows.withColumns({"technical_spec_name": spec["name"], "technical_spec_url": spec["url"], "files_json": F.when(F.size(others) > 0, others)})
