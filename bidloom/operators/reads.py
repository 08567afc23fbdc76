"""Reads of the interface: single cards, public views, specification downloads, page signatures, order by dates in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.handlers import pub_date
from ..functions.text import percent_encode
from .filters import with_customer_name

# The fields of a card's public view and of an alert, in order, and media types by file name extension.
CARD_FIELDS = (
    "id number source_platform url customer_id customer law subject nmck publication_date update_date deadline execution_term okpd2_codes kpgz_codes "
    "security_amount security_amount_unit technical_spec_url technical_spec_name files_json score score_method created_at updated_at"
).split()
ALERT_FIELDS = "number source_platform url customer law subject nmck publication_date deadline score score_method".split()
MEDIA_TYPES = {
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pdf": "application/pdf",
    "rtf": "application/rtf",
    "txt": "text/plain",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "zip": "application/zip",
}
SOURCE_ORDER = "publication_date_desc"


def by_id(rows: DataFrame, key: int, column: str = "id") -> DataFrame:
    """The row of an id, or none; the condition reaches the scan."""
    return rows.where(F.col(column) == key).limit(1)


def known(cards: DataFrame, asked: DataFrame) -> DataFrame:
    """number, source_platform, found for every pair that is asked for."""
    keys = ["number", "source_platform"]
    return asked.join(cards.select(*keys).distinct().withColumn("found", F.lit(True)), keys, "left").select(*keys, F.coalesce("found", F.lit(False)).alias("found"))


def _view(cards: DataFrame, customers: DataFrame, fields: list[str]) -> DataFrame:
    named = with_customer_name(cards.drop("customer"), customers)
    return named.select(*[F.col(f) if f in named.columns else F.lit(None).alias(f) for f in fields])


def card_view(cards: DataFrame, customers: DataFrame) -> DataFrame:
    """A card's public fields with its customer's name; null where the store lacks a field."""
    return _view(cards, customers, CARD_FIELDS)


def detail_view(cards: DataFrame, customers: DataFrame) -> DataFrame:
    return _view(cards, customers, [*CARD_FIELDS, "detail_json"])


def alert_view(cards: DataFrame, customers: DataFrame) -> DataFrame:
    return _view(cards, customers, ALERT_FIELDS)


def spec_downloads(cards: DataFrame, url: str = "technical_spec_url") -> DataFrame:
    """Adds status (404 without a specification, 302 to another site, else 200), location, file_name, media_type and
    disposition of a card's specification file."""
    own = F.nullif(F.col(url), F.lit(""))
    away = F.startswith(own, F.lit("http"))
    here = own.isNotNull() & ~away
    name = F.when(here, F.element_at(F.split(own, "/"), -1))
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    types = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    quoted = percent_encode(name)
    return cards.withColumns(
        {
            "status": F.when(own.isNull(), 404).when(away, 302).otherwise(200),
            "location": F.when(away, own),
            "file_name": name,
            "media_type": F.when(here, F.coalesce(F.try_element_at(types, kind), F.lit("application/octet-stream"))),
            "disposition": F.concat(F.lit('attachment; filename="'), quoted, F.lit("\"; filename*=UTF-8''"), quoted),
        }
    )


def page_signature(cards: DataFrame, limit: int = 100, updated: str = "update_date") -> DataFrame:
    """signature: total:id@update,... of the page of the latest cards. One that differs from the last tells of a change."""
    page = cards.select("id", updated).orderBy(F.desc("id")).limit(limit)
    item = F.concat(F.col("id").cast("string"), F.lit("@"), F.coalesce(F.date_format(updated, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")))
    joined = page.agg(F.collect_list(F.struct((-F.col("id")).alias("o"), item.alias("item"))).alias("items"))  # ``limit`` rows
    items = F.array_join(F.transform(F.array_sort("items"), lambda x: x["item"]), ",")
    return joined.join(cards.agg(F.count("*").alias("total")), F.lit(True)).select(F.concat(F.col("total").cast("string"), F.lit(":"), items).alias("signature"))  # one row each


def newest_first(rows: DataFrame, dates: str, position: str) -> DataFrame:
    """By the first date in a text, latest first; equal dates keep their order, rows without one come last."""
    return rows.orderBy(pub_date(dates).desc_nulls_last(), F.asc(position))


def require_order(order: str) -> str:
    """The only order that the stop at the last known date can rely on."""
    if order != SOURCE_ORDER:
        raise ValueError(f"a source must be in the order {SOURCE_ORDER}, not {order}")
    return order


def out_of_order(rows: DataFrame, published: str, page: str, position: str) -> DataFrame:
    """The rows of a list page that are newer than the row before them: none if the source keeps its order."""
    before = F.lag(published).over(W.partitionBy(page).orderBy(position))
    return rows.withColumn("_before", before).where(F.col(published) > F.col("_before")).drop("_before")


def migrated(rows: DataFrame, schema: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """A table copied into the columns of a new version: in its order, cast to its types; new columns take a default."""
    defaults = defaults or {}
    own = [(F.col(f.name) if f.name in rows.columns else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema).fields]
    return rows.select(*own)


def last_identity(rows: DataFrame, key: str = "id") -> DataFrame:
    """last_id: where an identity goes on after a copy; 1 for an empty table."""
    return rows.agg(F.coalesce(F.max(key), F.lit(1)).alias("last_id"))
