"""Substring search through the index, and pages by offset, against scans and sorts; what is read of the tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from bidloom.operators import paging, trigrams


def like(pattern):
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
            out += re.escape(pattern[k])
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c))
        k += 1
    return re.compile(out, re.S)


def test_search_equals_the_scan(spark, tmp_path):
    rng = random.Random(6)
    words = ["ООО", "Ромашка", "ГБУ", "школа", "№", "12", "Zürich", "50%", "a_b", "日本語", "back\\slash", "x"]
    texts = [None, "", "a", "50%", "a_b", "ab"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "id long, text string, gram string").repartition(3)
    path = f"file://{tmp_path}/index"
    trigrams.build_index(rows, "id", "text", path)
    patterns = ["", "%", "_", "____", "ро", "РОМА", "12 12", "a_b", "a\\_b", "50\\%", "5_%", "школа%гбу", "нет такого", "日本", "x", "\\\\s", "zü", None]
    for _ in range(300):
        text = rng.choice(texts[5:]).replace("\\", "\\\\")
        a = rng.randint(0, len(text))
        part = list(text[a : a + rng.randint(0, 7)])
        for k in range(len(part)):
            if rng.random() < 0.15 and (k == 0 or part[k - 1] != "\\") and part[k] != "\\":
                part[k] = rng.choice("%_")
        part = "".join(part)
        if (len(part) - len(part.rstrip("\\"))) % 2 or re.search(r"(?<!\\)(\\\\)*\\[^\\%_]", part):
            continue
        patterns.append(part.upper() if rng.random() < 0.3 else part)
    asked = spark.createDataFrame(list(enumerate(patterns)), "pattern_id int, part string").select("pattern_id", trigrams.containing(F.col("part")).alias("pattern"))
    got = {(r["pattern_id"], r["id"]) for r in trigrams.search(rows, asked, path).collect()}
    want = {(k, i) for k, p in enumerate(patterns) if p is not None for i, t in enumerate(texts) if t is not None and like(f"%{p}%".lower()).fullmatch(t.lower())}
    assert got == want and len(want) > 1000
    # Of what is compared, most hits: for patterns with three characters the index leaves few others.
    long = asked.where(F.length("pattern") > 6)
    met, hits = trigrams.candidates(spark, path, long).count(), trigrams.search(rows, long, path).count()
    assert hits <= met <= 2 * hits + 50 and met < 0.2 * long.count() * len(texts)
    assert trigrams.search(rows, asked.limit(0), path).count() == 0


def test_equal_patterns_are_compared_once(spark, tmp_path):
    rows = spark.range(1_000).select("id", F.format_string("Name#%06d", "id").alias("text"))
    path = f"file://{tmp_path}/index"
    trigrams.build_index(rows, "id", "text", path)
    asked = spark.range(3_000).select(F.col("id").alias("pattern_id"), F.when(F.col("id") % 3 < 2, "%00%").otherwise("%NAME%123").alias("pattern"))
    # A thousand texts for the one pattern, one for the other: not one for each pattern's id.
    assert trigrams.class_candidates(spark, path, trigrams.pattern_classes(asked)).count() == 1_001
    got = trigrams.search(rows, asked, path).agg(F.count("*"), F.sum("pattern_id"), F.sum("id")).first()
    often = [k for k in range(3_000) if k % 3 < 2]
    seldom = [k for k in range(3_000) if k % 3 == 2]
    assert tuple(got) == (len(often) * 1_000 + len(seldom), sum(often) * 1_000 + sum(seldom), len(often) * sum(range(1_000)) + len(seldom) * 123)


def test_a_pattern_id_may_have_several_patterns(spark, tmp_path):
    rows = spark.createDataFrame([(1, "abcd"), (2, "vwxyz"), (2, "abab"), (3, "bc"), (None, "abc"), (4, None)], "id long, text string")
    path = f"file://{tmp_path}/index"
    trigrams.build_index(rows, "id", "text", path)
    asked = spark.createDataFrame([(7, "%abc%"), (7, "%XYZ%"), (8, "%abc%"), (8, "%abc%"), (9, "%bc%_"), (None, "%bc%"), (10, None)], "pattern_id int, pattern string")
    got = sorted((r["pattern_id"], r["id"], r["text"]) for r in trigrams.search(rows, asked, path).collect())
    assert got == [(7, 1, "abcd"), (7, 2, "vwxyz"), (8, 1, "abcd"), (8, 1, "abcd"), (9, 1, "abcd")]


def test_pages_equal_the_sort(spark, tmp_path):
    path = f"file://{tmp_path}/pages"
    rows = spark.range(5_000).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 7).alias("v"), F.lit(1).alias("rank2"))
    paging.write_in_order(rows.repartition(5), [F.desc_nulls_last("v"), F.asc("id")], path, 300)
    want = sorted(((i, i % 7 if i % 3 == 0 else None) for i in range(5_000)), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert paging.total(spark, path) == 5_000
    for offset, limit in ((0, 20), (295, 10), (1_666, 3), (4_990, 20), (4_999, 1), (2_000, 100)):
        page = paging.page(spark, path, offset, limit)
        assert sorted((r["rank"], r["id"]) for r in page.collect()) == [(offset + k + 1, want[offset + k][0]) for k in range(min(limit, 5_000 - offset))]
        assert page.columns == ["id", "v", "rank2", "rank"] and len(page.inputFiles()) <= 2
    assert paging.page(spark, path, 5_000).count() == 0 and paging.page(spark, path, 10**12).count() == 0
    for bad in ((-1, 5), (0, 0), (0, 101)):
        with pytest.raises(ValueError):
            paging.page(spark, path, *bad)
    paging.write_in_order(rows.limit(0), ["id"], f"{path}-none")
    assert paging.page(spark, f"{path}-none").count() == 0 and paging.total(spark, f"{path}-none") == 0
