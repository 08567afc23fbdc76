"""Captured pages as a source: a table by platform, in the order of lists, pages and urls, read in batch or as a stream.

Filters on platform prune folders; those on list, page number and url are pushed to the scan, whose row groups they prune as
the files are sorted by them. Batch and stream give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "page_id long, list string, page_no int, url string, html string, platform string"
GROUP_BYTES = 8 << 20


def write_pages(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Adds pages (the columns of PAGES) to the source; those of one list stand together."""
    rows = pages.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in PAGES.split(", ")])
    order = ["platform", "list", "page_no", "url"]
    # Ranges of the whole order, so that a long list spreads over files.
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.mode(mode).option("parquet.block.size", GROUP_BYTES).partitionBy("platform").parquet(path)


def _wanted(pages: DataFrame, platforms: list[str] | None, lists: list[str] | None, page_from: int | None, page_to: int | None, urls: list[str] | None) -> DataFrame:
    conditions: list[Column] = []
    for name, values in (("platform", platforms), ("list", lists), ("url", urls)):
        if values is not None:
            conditions.append(F.col(name).isin(values))
    if page_from is not None:
        conditions.append(F.col("page_no") >= page_from)
    if page_to is not None:
        conditions.append(F.col("page_no") <= page_to)
    for c in conditions:
        pages = pages.where(c)
    return pages.select(*[c.split()[0] for c in PAGES.split(", ")])


def read_pages(spark: SparkSession, path: str, platforms: list[str] | None = None, lists: list[str] | None = None, page_from: int | None = None, page_to: int | None = None, urls: list[str] | None = None) -> DataFrame:
    """The pages of some platforms, lists, page numbers and urls; what isn't given isn't asked."""
    return _wanted(spark.read.schema(PAGES).parquet(path), platforms, lists, page_from, page_to, urls)


def stream_pages(spark: SparkSession, path: str, files_per_trigger: int = 16, **asked) -> DataFrame:
    """read_pages() as a stream: each file comes once, those that are added later too."""
    return _wanted(spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path), **{k: asked.get(k) for k in ("platforms", "lists", "page_from", "page_to", "urls")})
