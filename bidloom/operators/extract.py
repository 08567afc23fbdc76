"""Records from captured HTML pages: containers, variables, links and files, driven by a list of variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Variable
from ..functions.handlers import apply_handler
from ..functions.text import absolute_url
from .selectors import Page, compile_selector, select

CONTAINERS = "page_id long, url string, pos int, matches array<array<string>>"


def _scan(container: str | None, variables: list[Variable]):
    """Per container and variable the raw values of all matches. Selectors are compiled here, on the driver."""
    outer = compile_selector(container) if container else None
    inner = [(compile_selector(v.selector), v.attribute) for v in variables]

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for key, url, html in zip(frame["page_id"], frame["url"], frame["html"], strict=True):
                page = Page(html)
                for pos, scope in enumerate(select(page, outer) if outer else [0]):
                    values = [[page.attrs[n].get(a) if a else page.inner_text(n) for n in select(page, selector, scope)] for selector, a in inner]
                    rows.append((key, url, pos, values))
            yield pd.DataFrame(rows, columns=["page_id", "url", "pos", "matches"])

    return run


def extract(pages: DataFrame, variables: list[Variable], container: str | None = None) -> DataFrame:
    """page_id, url, pos and a column for each variable; one row for each container (or for each page without one).

    A variable takes its match number ``index``, the first where there are fewer. Its default stands only where
    nothing matches; a handler's null stays null.
    """
    raw = pages.select("page_id", "url", "html").mapInPandas(_scan(container, variables), CONTAINERS)
    columns: list[Column] = []
    for k, v in enumerate(variables):
        own = F.get("matches", F.lit(k))
        at = F.lit(v.index or 0)
        value = F.get(own, F.when(at < F.size(own), at).otherwise(0))
        handled = apply_handler(v.handler, value, v.handler_arg)
        columns.append(F.when(F.coalesce(F.size(own), F.lit(0)) == 0, F.lit(v.default)).otherwise(handled).alias(v.name))
    return raw.select("page_id", "url", "pos", *columns)


def links(pages: DataFrame, selector: str = "a[href]") -> DataFrame:
    """page_id, pos, href, name of every link in page order."""
    found = pages.select("page_id", "url", "html").mapInPandas(_scan(None, [Variable("href", selector, "href"), Variable("name", selector)]), CONTAINERS)
    pairs = F.arrays_zip(F.get("matches", F.lit(0)).alias("href"), F.get("matches", F.lit(1)).alias("name"))
    return found.select("page_id", F.posexplode(pairs).alias("pos", "l")).select("page_id", "pos", "l.href", "l.name")


def first_link(pages: DataFrame, selector: str, base: Column | None = None) -> DataFrame:
    """page_id, href: where a page's first link of a selector leads, absolute with a ``base``; null without one."""
    found = pages.select("page_id", "url", "html").mapInPandas(_scan(None, [Variable("href", selector, "href")]), CONTAINERS)
    href = F.get(F.get("matches", F.lit(0)), F.lit(0))
    return found.select("page_id", (href if base is None else absolute_url(href, base)).alias("href"))


def list_pages(pages: DataFrame, next_selector: str) -> DataFrame:
    """page_id, has_next: whether a list goes on after a captured page."""
    found = pages.select("page_id", "url", "html").mapInPandas(_scan(None, [Variable("next", next_selector)]), CONTAINERS)
    return found.select("page_id", (F.size(F.get("matches", F.lit(0))) > 0).alias("has_next"))


def until_last(pages: DataFrame, list_key: str, page_no: str, next_selector: str) -> DataFrame:
    """The pages of each list up to the first one without a next page; pages beyond it were never reached."""
    marked = pages.select("page_id", list_key, page_no).join(list_pages(pages, next_selector).where("not has_next"), "page_id", "left_semi")
    last = marked.groupBy(list_key).agg(F.min(page_no).alias("_last"))
    kept = pages.join(last, list_key, "left").where(F.col("_last").isNull() | (F.col(page_no) <= F.col("_last")))
    return kept.select(*pages.columns)


def files(pages: DataFrame, selector: str = "a[href]") -> DataFrame:
    """page_id, files array<struct<name,url>>."""
    return links(pages, selector).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("name"), F.col("href").alias("url")))).alias("f")).select("page_id", F.transform("f", lambda x: F.struct(x["name"].alias("name"), x["url"].alias("url"))).alias("files"))


def between_markers(c: Column, start: str, end: str) -> Column:
    """The part of a page from a marker up to and with another; the whole page where either is missing."""
    at = F.instr(c, start)
    tail = F.substring(c, at, F.length(c))
    stop = F.instr(tail, end)
    return F.when((at > 0) & (stop > 0), F.left(tail, stop + F.lit(len(end) - 1))).otherwise(c)


def follow(rows: DataFrame, pages: DataFrame, link: Column, how: str = "left") -> DataFrame:
    """Joins rows to the captured page of their link: detail, additional, files and organisation pages alike."""
    target = pages.select(F.col("url").alias("_url"), F.col("page_id").alias("target_page_id"), F.col("html").alias("target_html"))
    return rows.join(target, link == F.col("_url"), how).drop("_url")
