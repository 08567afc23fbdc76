"""Accuracy of scores: confusion, errors, correlations, balance."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CATEGORIES, POSITIVE_CATEGORIES
from ..functions.numbers import ratio, round_half
from .ranking import ordinal_rank


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def confusion(dataset: DataFrame, scores: DataFrame, threshold: float, positive: Iterable[str] = POSITIVE_CATEGORIES) -> DataFrame:
    """total, matched, tp, fp, tn, fn, accuracy, precision, recall, f1 over rows that have a score; always one row."""
    actual, predicted = F.col("category").isin(list(positive)), F.col("score") >= threshold
    found = dataset.join(scores, "number").where(F.col("score").isNotNull())
    n = found.agg(F.count("*").alias("total"), _count(actual == predicted).alias("matched"), _count(actual & predicted).alias("tp"), _count(~actual & predicted).alias("fp"), _count(~actual & ~predicted).alias("tn"), _count(actual & ~predicted).alias("fn"))
    c = F.col
    precision, recall = ratio(c("tp"), c("tp") + c("fp")), ratio(c("tp"), c("tp") + c("fn"))
    shares = {"accuracy": ratio(c("matched"), c("total")), "precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall)}
    return n.select("*", *[round_half(v, 4).alias(k) for k, v in shares.items()])


def _categories(df: DataFrame, categories: Iterable[str]) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame([(c,) for c in categories], "category string"))


def category_counts(dataset: DataFrame, categories: Iterable[str] = CATEGORIES) -> DataFrame:
    """category, n for every known category, 0 where none."""
    counts = dataset.groupBy("category").agg(F.count("*").alias("n"))
    return _categories(dataset, categories).join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def category_predictions(dataset: DataFrame, scores: DataFrame, threshold: float, categories: Iterable[str] = CATEGORIES) -> DataFrame:
    """category, total, predicted_positive, 0 where none."""
    found = dataset.join(scores, "number").where(F.col("score").isNotNull())
    counts = found.groupBy("category").agg(F.count("*").alias("total"), _count(F.col("score") >= threshold).alias("predicted_positive"))
    return _categories(dataset, categories).join(counts, "category", "left").select("category", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "predicted_positive")])


def category_balance(dataset: DataFrame, tolerance: float = 10.0, categories: Iterable[str] = CATEGORIES) -> DataFrame:
    """category, n, percent, violation; empty for an empty dataset. The unrounded share decides a violation."""
    categories = list(categories)
    total = dataset.agg(F.count("*").alias("_total")).where("_total > 0")
    rows = category_counts(dataset, categories).join(F.broadcast(total), F.lit(True))  # one row
    share = F.col("n") / F.col("_total") * 100.0
    return rows.select("category", "n", round_half(share, 1).alias("percent"), (F.abs(share - 100.0 / len(categories)) > tolerance).alias("violation"))


def fit_errors(pairs: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """n, mae, rmse, accuracy of expected and predicted; an empty table is an error."""
    e = F.col("predicted") - F.col("expected")
    out = pairs.agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("a"), F.sqrt(F.avg(e * e)).alias("r"), F.avg((F.abs(e) <= tolerance).cast("double")).alias("t"))
    n = F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("no pairs")).cast("bigint"))
    return out.select(n.alias("n"), round_half("a", 4).alias("mae"), round_half("r", 4).alias("rmse"), round_half("t", 4).alias("accuracy"))


def pearson(pairs: DataFrame, x: str = "expected", y: str = "predicted", out: str = "pearson") -> DataFrame:
    """The correlation, rounded to 4 digits; null for fewer than two pairs or without variance."""
    means = pairs.agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    sums = pairs.join(F.broadcast(means), F.lit(True)).agg(F.count("*").alias("n"), F.sum(dx * dy).alias("xy"), F.sum(dx * dx).alias("xx"), F.sum(dy * dy).alias("yy"))  # one row
    value = F.col("xy") / F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0))
    return sums.select(round_half(F.when(F.col("n") >= 2, value), 4).alias(out))


def spearman_ordinal(pairs: DataFrame, x: str = "expected", y: str = "predicted", item: str = "item_id", out: str = "spearman") -> DataFrame:
    """pearson() of ordinal ranks; of equal values the one with the smaller item comes first."""
    ranked = ordinal_rank(ordinal_rank(pairs, x, item, "_rx"), y, item, "_ry")
    return pearson(ranked.select(F.col("_rx").cast("double").alias("x"), F.col("_ry").cast("double").alias("y")), "x", "y", out)


def aligned(expected: DataFrame, predicted: DataFrame, item: str = "item_id") -> DataFrame:
    """expected and predicted values joined by position; unequal positions are an error."""
    both = expected.withColumn("_e", F.lit(1)).join(predicted.withColumn("_p", F.lit(1)), item, "full")
    same = F.col("_e").isNotNull() & F.col("_p").isNotNull()
    return both.where(F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("lengths differ")).cast("boolean"))).drop("_e", "_p")
