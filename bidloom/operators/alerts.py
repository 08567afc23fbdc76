"""Threshold alerts and their messages; delivery is an outbox table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_texts, html_escape
from ..sources.writers import iso_json

# Labels of a message's lines and the fields that they show.
LINES = (
    ("№", "number"),
    ("Площадка", "source_platform"),
    ("Предмет", "subject"),
    ("Заказчик", "customer"),
    ("Закон", "law"),
    ("НМЦК", "nmck"),
    ("Опубликовано", "publication_date"),
    ("Срок подачи", "deadline"),
    ("Оценка", "score"),
)


def over_threshold(cards: DataFrame, least: float) -> DataFrame:
    return cards.where(F.col("score").isNotNull() & (F.col("score") >= least))


def message(columns: list[str]) -> Column:
    """Labelled lines of the fields that aren't blank, then the link; values are escaped."""
    shown = [(f"{label}: ", field) for label, field in LINES if field in columns]
    labels = F.array(*[F.lit(label) for label, _ in shown]).cast("array<string>")
    fields = as_texts(*[field for _, field in shown]) if shown else labels
    lines = F.transform(fields, lambda value, i: F.concat(F.element_at(labels, i + 1), html_escape(value)))
    if "url" in columns:
        link = F.transform(as_texts("url"), lambda url: F.concat(F.lit('<a href="'), html_escape(url), F.lit('">'), html_escape(url), F.lit("</a>")))
        lines = F.concat(lines, link)
    return F.array_join(F.array_compact(lines), "\n")


def alert_messages(cards: DataFrame) -> DataFrame:
    return cards.select("id", message(cards.columns).alias("message"))


#: What each kind of receiver gets of a card; register_backend() adds more.
BACKENDS: dict[str, Callable[[list[str]], Column]] = {
    "telegram": lambda columns: message(columns),
    "max": lambda columns: message(columns),
    "webhook": lambda columns: iso_json(F.struct(*columns)),
}


def register_backend(name: str, payload: Callable[[list[str]], Column]) -> None:
    """A receiver of alerts: ``payload`` makes its text of a card's columns."""
    if not name or name == "none":
        raise ValueError("a backend needs a name of its own")
    BACKENDS[name] = payload


def active_backends(chosen: str | list[str], settings: dict[str, dict]) -> list[str]:
    """Those of the chosen backends that are known and whose own settings enable them."""
    names = [chosen] if isinstance(chosen, str) else chosen
    return [n for n in dict.fromkeys(names) if n in BACKENDS and settings.get(n, {}).get("enabled", False)]


def outbox(cards: DataFrame, backends: list[str]) -> DataFrame:
    """backend, id, payload: one row for each alert and backend; unknown backends and "none" get no rows."""
    known = [b for b in dict.fromkeys(backends) if b in BACKENDS]
    payload = F.lit(None).cast("string")
    for name in known:
        payload = F.when(F.col("backend") == name, BACKENDS[name](cards.columns)).otherwise(payload)
    return cards.withColumn("backend", F.explode(F.array(*map(F.lit, known)).cast("array<string>"))).select("backend", "id", payload.alias("payload"))
