"""Phrase mining against counting every phrase of every piece."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("bidloom.llm")

from bidloom.llm import phrases  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, w1 string, n long, phrase string, key long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "w", 1, "p", 2) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, min_count, max_words, top, cover, scale):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, max_words + 1):
                    if i + k <= len(words):
                        f[lang, tuple(words[i : i + k])] += 1
    found = {k: c for k, c in f.items() if c >= min_count and len(k[1]) > 1}
    best = Counter()
    for (lang, p), a in found.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p):
                    best[lang, p[i:j]] = max(best[lang, p[i:j]], a)
    out = []
    for (lang, p), a in found.items():
        if 100 * best[lang, p] >= cover * a and best[lang, p]:
            continue
        cuts = [(scale * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranked, seen = [], Counter()
    for r in out:
        seen[r[0]] += 1
        if seen[r[0]] <= top:
            ranked.append((r[0], seen[r[0]], *r[1:]))
    return ranked


def corpus(seed, count=150):
    rng = random.Random(seed)
    vocab = ["the", "of", "and", "Zürich", "ÄB", "a\x01b", "x y", "don't", "日本", *(f"w{k}" for k in range(12))]
    fixed = ["the end of the", "of and of and of and of", "a\x01b the w1 w2 w3 w4 w5"]
    rows = []
    for _ in range(count):
        words = [rng.choice(fixed) if rng.random() < 0.3 else vocab[min(int(rng.expovariate(0.3)), len(vocab) - 1)] for _ in range(rng.randint(0, 30))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "!"]) for w in words)
        rows.append((text, rng.choice(["en", "en", "en", "de", None, ""])))
    hot = "The same passage, of many documents: stands here again and again"
    return rows + [(hot, "en")] * 60 + [(None, "en"), ("", "de"), (" \t\n..", None), ("the " * 5000, "en"), ("x" * 20_000, "en")]


@pytest.mark.parametrize(("min_count", "max_words", "top", "cover"), [(5, 5, 2000, 100), (20, 5, 7, 100), (3, 3, 50, 60), (5, 2, 2000, 100), (1_000_000, 5, 10, 100)])
def test_collocations(spark, min_count, max_words, top, cover):
    rows = corpus(min_count)
    out = phrases.collocations(frame(spark, rows), min_count, max_words, top, cover)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = sorted(map(tuple, out.collect()), key=lambda r: (r[0], r[1]))
    want = brute(rows, min_count, max_words, top, cover, 1000)
    assert got == want and (len(want) > 5) == (min_count < 1000)


def test_bounded_space(spark, monkeypatch):
    """With bitmaps full of false marks, small slices and small sums the counts are the same."""
    rows = corpus(8, 80)
    monkeypatch.setattr(phrases, "MOST_BITS", 15)
    monkeypatch.setattr(phrases, "BITS_PER_KEY", 0)
    monkeypatch.setattr(phrases, "SLICE_BYTES", 100)
    monkeypatch.setattr(phrases, "HELD_HASHES", 20)
    monkeypatch.setattr(phrases, "pair_hashes", lambda left, right: (left ^ right) & np.uint64(0x3FF << 54))
    got = sorted(map(tuple, phrases.collocations(frame(spark, rows), 4, 5, 50).collect()), key=lambda r: (r[0], r[1]))
    assert got == brute(rows, 4, 5, 50, 100, 1000)


def test_growth_over_tasks_edges():
    """Sorted occurrences cut anywhere into tasks and batches: the parts of each phrase sum up."""
    rng = random.Random(1)
    rows = Counter(tuple(["en", *(rng.choice("abc") for _ in range(rng.randint(2, 5)))]) for _ in range(400))
    ordered = sorted(((*k, *[None] * (6 - len(k)), n) for k, n in rows.items()), key=lambda r: [x or "" for x in r[:6]])
    names = ["lang", "w1", "w2", "w3", "w4", "w5", "n"]
    want = Counter()
    for r in ordered:
        for size in range(2, 6):
            if r[size] is not None:
                want[" ".join(r[1 : size + 1])] += r[6]
    for _ in range(20):
        cuts = sorted(rng.sample(range(1, len(ordered)), 4))
        got = Counter()
        for a, b in zip([0, *cuts], [*cuts, len(ordered)], strict=True):
            task = ordered[a:b]
            step = rng.choice([1, 3, 50])
            batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in task[i : i + step]], pa.schema([(c, pa.int64() if c == "n" else pa.string()) for c in names])) for i in range(0, len(task), step)]
            for out in phrases._grow(5, 5)(iter(batches)):
                for p, n in zip(out.column("phrase").to_pylist(), out.column("n").to_pylist(), strict=True):
                    got[p] += n
        assert {p: n for p, n in got.items() if n >= 5} == {p: n for p, n in want.items() if n >= 5}


def test_empty_tables(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.collocations(frame(spark, [(None, None), ("", None)])).count() == 0
