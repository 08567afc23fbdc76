"""Fill-in-middle: exact against slices of Python strings; every form gives the text back."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("bidloom.llm")

from bidloom.llm import fim, queries  # noqa: E402

SCHEMA = "doc_id long, text string, n long, form string, prefix string, _units int"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    hard = ["", None, "a", "😀", "a😀b😀😀c", "é" * 5, "éx", "x\ny\n\nz", "a<P>b", "<S", "<M>", "\U0001f600" * 50, " ", "\x00ab", "ab  cd, ef\n", "x" * 100_000, "same", "same"]
    return hard + ["".join(rng.choice("ab \n😀é<>PSM") for _ in range(rng.randint(1, 40))) for _ in range(300)]


def wanted(doc_id, text):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_query(spark, texts, tmp_path):
    ids = [None if i % 50 == 49 else i % 290 for i in range(len(texts))]
    spark.createDataFrame([(k, t, 1, "f", "p", 2) for k, t in zip(ids, texts, strict=True)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_fim(spark, str(tmp_path)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [(k, n, form, a, b, sha(o), sha(t or "")) for k, t in zip(ids, texts, strict=True) for n, form, a, b, o in [wanted(k, t)]]
    assert Counter(map(tuple, out)) == Counter(rows) and {r["form"] for r in out} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("grammar", [fim.CODE_POINTS, fim.WORDS, fim.LINES])
def test_units_lose_nothing(spark, texts, grammar):
    rows = spark.createDataFrame([(i, t, 1, "f", "p", 2) for i, t in enumerate(texts)], SCHEMA)
    out = fim.fill_in_middle(rows, grammar, percent=100, spm_percent=50, sentinels=("<|p|>", "<|s|>", "<|m|>"), seed=7)
    for r in out.withColumn("back", fim.restore(F.col("output"), F.col("form"), ("<|p|>", "<|s|>", "<|m|>"))).withColumn("u", fim.units(F.col("text"), grammar)).collect():
        text = texts[r["doc_id"]] or ""
        assert r["back"] == r["text"] == "".join(r["u"]) == text and len(r["u"]) == r["n"] and "" not in r["u"]
        assert (r["form"] == "plain") == (text == "")
        if text:
            assert r["prefix"] + r["middle"] + r["suffix"] == text
            ends = [sum(map(len, r["u"][:k])) for k in range(r["n"] + 1)]
            assert len(r["prefix"]) in ends and len(r["prefix"] + r["middle"]) in ends


def test_grammars(spark):
    units = lambda text, g: spark.range(1).select(fim.units(F.lit(text), g)).first()[0]
    assert units("Zürich,  don't go\n", fim.WORDS) == ["Zürich", ",  ", "don", "'", "t ", "go\n"]
    assert units("a\n\nb\r\n", fim.LINES) == ["a\n", "\n", "b\r\n"]
    assert units("é😀", fim.CODE_POINTS) == ["e", "́", "😀"]
    assert units("ab12c", fim.UnitGrammar((("a-z", "a-z"), ("0-9", "0-9")))) == ["ab", "12", "c"]


def test_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0
