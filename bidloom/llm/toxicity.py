"""Toxicity scores by a counterfactually regularised linear classifier.

Features are the presence of words and of words' first letters (so that inflected forms of one stem share features).
Those are kept whose presence tells most about the label. Their counts and the logistic model over them come from a
bounded sample of the labelled training rows (SAMPLE_ROWS).

Identity terms come from a table of groups and from the corpus itself. ``found_groups`` takes the most frequent words
that don't tell the label and groups those that stand in the same texts: words that are used alike, each group's by
another group of writers. For each sample text that holds identity terms, counterfactuals swap all of them for the terms
of like rank of another group, and the loss adds ``fairness`` times the mean squared change of the score. So what tells
the group carries no weight of its own, and neutral mentions don't become false positives. ``swapped`` gives the
counterfactual of a text.

Texts are lower-cased; a word is a run of letters. Null texts count as empty; texts without known words get the
model's base score. Rows with a null id are scored and never held out. Where labels of a row repeat, each counts; rows
that repeat an id are rows of their own. Without usable labels (none, or only of one kind) every score is the base rate
of label 1, or 0 without labels. Empty tables give empty results. ``score`` reads no other columns, ``drop_toxic`` keeps
them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WORD = re.compile(r"[^\W\d_]+")

# Identity terms by group; a counterfactual swaps a term for another of its group.
IDENTITY_TERMS = {
    "gender": "women men woman man girls boys female male transgender nonbinary frauen männer femmes hommes mujeres hombres",
    "orientation": "gay lesbian straight bisexual homosexual heterosexual queer schwul lesbisch homosexuel homosexuelle",
    "religion": "christian muslim jewish hindu buddhist atheist catholic christians muslims jews christen muslime juden chrétiens musulmans juifs cristianos musulmanes judíos",
    "origin": "black white asian african american european latino mexican chinese indian arab immigrants refugees deutsche franzosen français allemands españoles franceses",
    "ability": "disabled blind deaf autistic elderly behinderte blinde aveugles sourds ciegos sordos",
}


PREFIXES = (4, 5, 6, 7)
SAMPLE_ROWS = 20_000
SLICE_ROWS = 200
COUNTED = 50_000
#: Found groups: most words that are looked at, terms of a group, least likeness of a word's texts to those of the group's
#: first word, and how many times the base rate of label 1 its rate may be.
GROUP_WORDS = 256
GROUP_TERMS = 24
GROUP_LIKENESS = 0.5
GROUP_RATE = 3.0


def features_of(word: str) -> list[str]:
    """A word's first letters, and the whole word with an end mark."""
    return [*(word[:k] for k in PREFIXES if len(word) >= k), word + "$"]


def term_swaps(groups: list[list[str]], within: bool) -> dict[str, list[str]]:
    """Each term's counterfactual terms: two others of its group, or those of like rank in two other groups."""
    if within:
        return {t: [g[(k + 1) % len(g)], g[(k + len(g) // 2) % len(g)]] for g in groups if len(g) > 1 for k, t in enumerate(g)}
    n, by_group = len(groups), [[groups[(i + d) % len(groups)] for d in (1, max(1, len(groups) // 2))] for i in range(len(groups))]
    return {t: [other[k % len(other)] for other in by_group[i]] for i in range(n if n > 1 else 0) for k, t in enumerate(groups[i])}


def swapped(text: str, swaps: dict[str, list[str]], which: int = 0) -> str:
    """The counterfactual of a text: all its terms swapped."""
    return WORD.sub(lambda m: swaps[w][which] if (w := m[0]) in swaps else w, text.lower())


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    bias: float
    swaps: dict[str, list[str]] = field(default_factory=dict)  # what the counterfactuals swapped
    pairs: int = 0  # how many counterfactuals took part

    def __post_init__(self):
        # Most words have no feature: the first letters of those that have.
        object.__setattr__(self, "starts", {f.rstrip("$")[: PREFIXES[0]] for f in self.weights})

    def scores(self, texts: list[str | None]) -> np.ndarray:
        known, get, starts, k = self.weights.keys(), self.weights.__getitem__, self.starts, PREFIXES[0]
        z = []
        for text in texts:
            words = {w for w in WORD.findall(text.lower()) if w[:k] in starts} if text else ()
            z.append(self.bias + sum(map(get, known & {f for w in words for f in features_of(w)})))
        return 1 / (1 + np.exp(-np.clip(np.array(z, float), -500, 500)))


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 5; rows of fold 0 are held out. Null ids have fold 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(1)).cast("int")


def _slices(batch):
    return (batch.slice(at, SLICE_ROWS) for at in range(0, batch.num_rows, SLICE_ROWS))


def _words(batches):
    """y and a text's different words."""
    for batch in batches:
        for part in _slices(batch):
            words = [list(set(WORD.findall(t.lower()))) if t else [] for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.list_(pa.string()))], ["y", "words"])


def _counter(batches):
    """In how many texts of label 1 (p) and 0 (q) a feature stands, summed up over about COUNTED features at a time."""
    counts: tuple[Counter, Counter] = Counter(), Counter()

    def summed_up():
        names = list(counts[0].keys() | counts[1].keys())
        p, q = (pa.array([counts[y][f] for f in names], pa.int64()) for y in (1, 0))
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), p, q], ["feature", "p", "q"])

    for part in (p for batch in batches for p in _slices(batch)):
        for y, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            counts[y].update({f for w in words for f in features_of(w)})
        if len(counts[0]) + len(counts[1]) > COUNTED:
            yield summed_up()
    yield summed_up()


def _together(words: list[str]):
    """i, j, n: in how many texts of a batch the words number i and j stand."""
    number = {w: i for i, w in enumerate(words)}

    def run(batches):
        for batch in batches:
            n = np.zeros((len(words), len(words)), np.float32)
            for part in _slices(batch):
                holds = np.zeros((part.num_rows, len(words)), np.float32)
                for row, own in enumerate(part.column(0).to_pylist()):
                    holds[row, [number[w] for w in own if w in number]] = 1
                n += holds.T @ holds
            i, j = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(n[i, j].astype(np.int64))], ["i", "j", "n"])

    return run


def found_groups(rows: DataFrame, counted: DataFrame, n0: int, n1: int) -> list[list[str]]:
    """Groups of frequent words that stand in the same texts and don't tell the label; only counts of GROUP_WORDS words
    reach the driver. ``rows`` has words, ``counted`` each feature's texts of label 1 and 0 in p and q."""
    n, rate = F.col("p") + F.col("q"), GROUP_RATE * n1 / (n0 + n1)
    likely = counted.where(F.endswith("feature", F.lit("$")) & (n >= 8) & (F.col("p") <= rate * n))
    top = [r["feature"][:-1] for r in likely.orderBy(n.desc(), "feature").limit(GROUP_WORDS).collect()]
    if not top:
        return []
    met = np.zeros((len(top), len(top)))
    for r in rows.select("words").mapInArrow(_together(top), "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        met[r["i"], r["j"]] = r["n"]
    alike = met / np.sqrt(np.outer(met.diagonal(), met.diagonal()))
    groups: list[list[int]] = []
    for i in range(len(top)):
        for own in groups:
            if alike[i, own[0]] >= GROUP_LIKENESS:
                own.append(i)
                break
        else:
            groups.append([i])
    return [[top[i] for i in own[:GROUP_TERMS]] for own in groups if len(own) > 3]


def _picker(vocabulary: dict[str, int], tables: list[dict[str, list[str]]]):
    """y, the known features of a text, and of each counterfactual those that go and come, as numbers."""

    def run(batches):
        number, starts = vocabulary.get, {f[: PREFIXES[0]].rstrip("$") for f in vocabulary}
        pick = lambda features: sorted(i for f in features if (i := number(f)) is not None)
        spell = lambda words: {f for w in words for f in features_of(w)}
        kinds = pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))
        for part in (p for batch in batches for p in _slices(batch)):
            kept, gone, come = [], [], []
            for words in part.column(1).to_pylist():
                words = {w for w in words if w[: PREFIXES[0]] in starts}  # the others have no known feature
                own = spell(words)
                kept.append(pick(own))
                goes, comes = [], []
                for swaps in tables:
                    terms = [w for w in words if w in swaps]
                    if not terms:
                        continue
                    rest = spell(words.difference(terms))
                    for which in range(2):
                        new = rest | spell(swaps[t][which] for t in terms)
                        goes.append(pick(own - new))
                        comes.append(pick(new - own))
                gone.append(goes)
                come.append(comes)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, kinds[0]), pa.array(gone, kinds[1]), pa.array(come, kinds[1])], ["y", "x", "gone", "come"])

    return run


def _matrix(rows: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of every entry of lists of numbers."""
    return np.repeat(np.arange(len(rows)), np.asarray(rows.value_lengths())), np.asarray(rows.flatten(), np.int64)


def _times(m: tuple[np.ndarray, np.ndarray], w: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(m[0], w[m[1]], n)


def fit_logistic(x: pa.ListArray, y: np.ndarray, gone: pa.ListArray, come: pa.ListArray, size: int, fairness: float, ridge: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights of binary features by Nesterov's accelerated gradient with a diagonal step bound. ``gone`` and ``come`` have
    the features by which a text and its counterfactual differ."""
    n, m, pairs = len(x), _matrix(x), len(gone)
    only_a, only_b = _matrix(gone), _matrix(come)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))  # both labels count alike
    w, bias, pw, pb = np.zeros(size), 0.0, np.zeros(size), 0.0
    lengths = np.bincount(m[0], minlength=n) + 1.0
    bound = 0.25 * np.bincount(m[1], (weight * lengths)[m[0]], size) + ridge
    if pairs:
        change = np.bincount(only_a[0], minlength=pairs) + np.bincount(only_b[0], minlength=pairs)
        for side in (only_a, only_b):
            bound += 2 * fairness / pairs * np.bincount(side[1], change[side[0]].astype(float), size)
    bound_b = 0.25 * float((weight * lengths).sum())
    for k in range(1, rounds + 1):
        vw, vb = w + (k - 1) / (k + 2) * (w - pw), bias + (k - 1) / (k + 2) * (bias - pb)
        error = weight * (1 / (1 + np.exp(-np.clip(_times(m, vw, n) + vb, -500, 500))) - y)
        grad = np.bincount(m[1], error[m[0]], size) + ridge * vw
        if pairs:
            gap = 2 * fairness / pairs * (_times(only_a, vw, pairs) - _times(only_b, vw, pairs))
            grad += np.bincount(only_a[1], gap[only_a[0]], size) - np.bincount(only_b[1], gap[only_b[0]], size)
        pw, pb = w, bias
        w, bias = vw - grad / bound, vb - float(error.sum()) / bound_b
    return w, bias


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text and label of the labelled rows outside fold 0: all of them, or about ``sample_rows`` by a hash of the id.

    The sampled labels are bounded, so they are broadcast and the texts aren't dealt out.
    """
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).where((fold(F.col("_id")) != 0) & F.col("label").isin(0, 1))
    share = min(1.0, sample_rows / max(marked.count(), 1))
    kept = marked.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(kept), "_id").select("text", "label")


def train(labelled: DataFrame, features: int = 1024, least_gain: float = 18.0, fairness: float = 1.0, ridge: float = 3e-4, terms: dict[str, str] | None = None, find_groups: bool = True) -> ToxicityModel:
    """Fit on rows with text and label (0 or 1), which training_rows() bounds. A feature is kept if its G statistic is
    at least ``least_gain``, and ``features`` bounds those that are kept. ``terms`` is the table of identity terms by group;
    ``find_groups`` adds those that the texts themselves show.
    """
    marked = labelled.where("label in (0, 1)").select(F.col("label").cast("int").alias("y"), F.col("text"))
    rows = cut(marked.mapInArrow(_words, "y int, words array<string>"), "toxicity-words")
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return ToxicityModel({}, 40.0 if n1 else -40.0)
    counted = rows.mapInArrow(_counter, "feature string, p long, q long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    counted = cut(counted.where("p + q >= 2"), "toxicity-counts")
    tables = [term_swaps([g.split() for g in (IDENTITY_TERMS if terms is None else terms).values()], True)]
    if find_groups:
        tables.append(term_swaps(found_groups(rows, counted, n0, n1), False))
    # The gain in log-likelihood from knowing the word: G of the two-by-two table.
    cell = lambda o, row, column: F.when(o > 0, o * F.log(o * (n0 + n1) / (row * column))).otherwise(0.0)
    p, q = F.col("p").cast("double"), F.col("q").cast("double")
    gain = cell(p, p + q, F.lit(n1)) + cell(q, p + q, F.lit(n0)) + cell(n1 - p, n0 + n1 - p - q, F.lit(n1)) + cell(n0 - q, n0 + n1 - p - q, F.lit(n0))
    telling = counted.select("feature", gain.alias("gain")).where(F.col("gain") >= least_gain / 2)
    best = [r["feature"] for r in telling.orderBy(F.col("gain").desc(), "feature").limit(features).collect()]  # bounded by ``features``
    vocabulary = {f: i for i, f in enumerate(dict.fromkeys([*best, *(f for swaps in tables for t in swaps for f in features_of(t))]))}
    picked = rows.mapInArrow(_picker(vocabulary, tables), "y int, x array<int>, gone array<array<int>>, come array<array<int>>").toArrow()  # numbers only, of bounded rows
    x, gone, come = (picked.column(c).combine_chunks() for c in ("x", "gone", "come"))
    gone, come = gone.flatten(), come.flatten()
    w, bias = fit_logistic(x, np.asarray(picked.column("y"), float), gone, come, len(vocabulary), fairness, ridge)
    return ToxicityModel({t: float(w[i]) for t, i in vocabulary.items() if abs(w[i]) > 1e-9}, bias, tables[0] | tables[-1], len(gone))


def neutral_mentions(model: ToxicityModel, texts: Iterable[str | None]) -> dict[str, float]:
    """Of neutral texts that hold identity terms: how many, the share of false positives among them and among their
    counterfactuals, and the mean change of the score between the two. For samples of texts."""
    own = [t for t in texts if t and any(w in model.swaps for w in WORD.findall(t.lower()))]
    before, after = model.scores(own), [model.scores([swapped(t, model.swaps, k) for t in own]) for k in range(2)]
    false = lambda z: float((z >= 0.5).mean()) if len(own) else 0.0
    change = float(np.mean([np.abs(a - before).mean() for a in after])) if own else 0.0
    return {"texts": len(own), "false_positives": false(before), "false_positives_swapped": false(np.concatenate(after)), "change": change}


def _scorer(model: ToxicityModel):
    def run(batches):
        for batch in batches:
            score = np.concatenate([model.scores(batch.column(1).slice(at, SLICE_ROWS).to_pylist()) for at in range(0, batch.num_rows, SLICE_ROWS)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), (fold(F.col(id_col)) == 0).alias("held_out"))
    return rows.mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that the model doesn't reject, with all their columns. Null texts count as empty, null ids don't matter, and
    rows that repeat are judged alike."""

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        return pd.Series(model.scores(texts.tolist()))

    return docs.where(scored(F.coalesce(docs[text_col], F.lit(""))) < 0.5)
