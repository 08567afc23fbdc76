"""Joins over hierarchical codes. A code's digits are its path; prefixes are its ancestors.

Prefix joins are equi joins: a code is expanded to its prefixes, which meet the tree's digits. The tree is a small
dimension of two columns; it is broadcast while it has at most TREE_ROWS rows, else Spark chooses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digits

TREE_ROWS = 200_000


def small(df: DataFrame, rows: int = TREE_ROWS) -> DataFrame:
    """Broadcasts a table of at most ``rows`` rows; larger ones are joined as Spark sees fit."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def prefixes(code_digits: Column) -> Column:
    """All prefixes of a digit string, the shortest first; empty for ''."""
    n = F.length(code_digits)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.left(code_digits, i))).otherwise(F.array().cast("array<string>"))


def longest_prefix(rows: DataFrame, code: Column, table: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: the value of the longest key that is a prefix of the code, by digits; null without one."""
    keyed = table.select(digits(F.col(key)).alias("_d"), F.col(value).alias("_v")).where("_d <> ''")
    codes = rows.select(digits(code).alias("_code")).distinct()
    best = codes.select("_code", F.explode(prefixes(F.col("_code"))).alias("_d")).join(small(keyed), "_d")
    best = best.groupBy("_code").agg(F.max_by("_v", F.length("_d")).alias(out))
    return rows.withColumn("_code", digits(code)).join(best, "_code", "left").drop("_code")


def fit_for_codes(rows: DataFrame, code: Column, fit_table: dict[str, float], default: float, out: str = "fit") -> DataFrame:
    """longest_prefix() against a small literal table: its keys' number bounds the expression, so no join is needed."""
    found: dict[str, float] = {}
    for key, value in fit_table.items():
        if d := "".join(ch for ch in key if ch.isdigit()):
            found[d] = value
    code_digits, fit = digits(code), F.lit(float(default))
    for d in sorted(found, key=len):
        fit = F.when(F.startswith(code_digits, F.lit(d)), F.lit(float(found[d]))).otherwise(fit)
    return rows.withColumn(out, fit)


def resolve_codes(requests: DataFrame, tree: DataFrame, id_col: str = "request_id", codes_col: str = "codes", code: str = "code", path: str = "path") -> DataFrame:
    """id, paths: per request the paths of its codes in order, without repeats.

    A code takes its own path; else those of all its descendants in code order; else that of its nearest ancestor.
    """
    # Of keys with equal digits the last in code order stands.
    nodes = tree.select(digits(F.col(code)).alias("d"), F.col(code).alias("key"), F.col(path).alias("path")).groupBy("d").agg(F.max(F.struct("key", "path")).alias("n")).select("d", "n.key", "n.path")
    asked = requests.select(id_col, F.posexplode(codes_col).alias("_at", "_code")).withColumn("_q", digits(F.col("_code"))).where("_q <> ''")
    wanted = asked.select("_q").distinct()
    near = small(nodes)
    exact = wanted.join(near, F.col("_q") == F.col("d")).select("_q", F.array("path").alias("paths"), F.lit(1).alias("tier"))
    below = nodes.where(F.length("d") > 1).select("key", "path", F.explode(prefixes(F.left(F.col("d"), F.length("d") - 1))).alias("_q"))
    down = wanted.join(below, "_q").groupBy("_q").agg(F.array_sort(F.collect_list(F.struct("key", "path"))).alias("n"))
    down = down.select("_q", F.col("n.path").alias("paths"), F.lit(2).alias("tier"))
    up = wanted.select("_q", F.explode(prefixes(F.col("_q"))).alias("d")).join(near, "d").groupBy("_q").agg(F.max_by("path", F.length("d")).alias("p"))
    up = up.select("_q", F.array("p").alias("paths"), F.lit(3).alias("tier"))
    resolved = exact.unionByName(down).unionByName(up).groupBy("_q").agg(F.min_by("paths", "tier").alias("paths"))
    found = asked.join(resolved, "_q").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_at", "paths"))).alias("n"))
    found = found.select(id_col, F.array_distinct(F.flatten(F.col("n.paths"))).alias("paths"))
    return requests.select(id_col).join(found, id_col, "left").select(id_col, F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))


def resolve_code_ids(requests: DataFrame, tree: DataFrame, id_col: str = "request_id", codes_col: str = "codes", code: str = "code", node_id: str = "node_id") -> DataFrame:
    """id, ids: exact text match, else the nearest ancestor; joined by commas without repeats; null if none."""
    nodes = small(tree.select(F.col(code).alias("key"), digits(F.col(code)).alias("d"), F.col(node_id).alias("node")))
    asked = requests.select(id_col, F.posexplode(codes_col).alias("_at", "_code"))
    wanted = asked.select("_code").distinct()
    exact = wanted.join(nodes, F.col("_code") == F.col("key")).groupBy("_code").agg(F.max("node").alias("exact"))
    up = wanted.select("_code", F.explode(prefixes(digits(F.col("_code")))).alias("d")).join(nodes, "d").groupBy("_code").agg(F.max_by("node", F.struct(F.length("d"), F.col("node"))).alias("up"))
    known = wanted.join(exact, "_code", "left").join(up, "_code", "left").select("_code", F.coalesce("exact", "up").alias("node")).where("node <> ''")
    found = asked.join(known, "_code").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_at", "node"))).alias("n"))
    found = found.select(id_col, F.array_join(F.array_distinct(F.col("n.node")), ",").alias("ids"))
    return requests.select(id_col).join(found, id_col, "left").select(id_col, "ids")


def code_names(codes: DataFrame, code_to_path: DataFrame, path_to_name: DataFrame, code: str = "code") -> DataFrame:
    """Adds ``name``: code -> path -> name, and the code itself where either is missing or blank."""
    paths = code_to_path.select(F.col("code").alias(code), "path")
    named = codes.join(small(paths), code, "left").join(small(path_to_name.select("path", F.col("name").alias("_name"))), "path", "left")
    return named.withColumn("name", F.coalesce(F.nullif(F.col("_name"), F.lit("")), F.col(code))).drop("_name", "path")


def tree_from_html(pages: DataFrame, html: str = "html") -> DataFrame:
    """code, path, name of every labelled node in tree snapshots; of repeats the last one stands."""
    pattern = r'value="(\.[0-9]+(?:\.[0-9]+)*\.)"[^>]*>([^<]+?)\((\d+(?:\.\d+)*)\)<'
    groups = [F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(k)) for k in (1, 2, 3)]
    nodes = pages.select(F.posexplode(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("path", "name", "code"), strict=True)])).alias("pos", "n"))
    last = nodes.groupBy(F.col("n.code").alias("code")).agg(F.max_by(F.struct(F.col("n.path").alias("path"), F.trim("n.name").alias("name")), "pos").alias("n"))
    return last.select("code", "n.path", "n.name")
