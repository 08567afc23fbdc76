"""Phrase collocation mining by contiguous pattern growth (PrefixSpan over neighbouring words).

Frequent words are counted first, then hashes of pairs of such words, then of triples of such pairs: where the hash is seldom
there is no frequent prefix. An occurrence of a pair that may be frequent points to what stands to its right, as far as each
further word ends a triple that may be frequent: nothing beyond can belong to a frequent phrase.
These projected occurrences (at most ``max_words`` words; equal ones become one row with their number, in each task before
they are dealt out) are dealt by ranges of their prefixes and sorted, so a task owns neighbouring prefixes whole and grows each to the
right, depth first: along sorted occurrences, the phrases open at any place are one for each length, so a task holds no
group. A prefix with more occurrences than a task's share lies in several neighbouring tasks; each gives what it counted
of the phrases at its edges, and these parts are summed up.

What the tasks know of frequent words, pairs and triples is a bitmap of hashes each, at most 2 ** MOST_BITS bits whatever the
corpus. It has no false negatives; counts are of the words themselves, so false positives cost time only.

A phrase's words stand in one piece of a text. Everything is counted by language, null being ``und``. Null texts count as
empty. Repeated rows count again. Other columns, the id included, are not read; empty tables give empty results. Scores
are exact: decimals of 38 digits, whole division.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

MOST_BITS = 28
BITS_PER_KEY = 16
SLICE_BYTES = 8 << 20
HELD_HASHES = 1 << 21
#: Phrases up to this length are counted by their hashes before occurrences are projected.
SEEDED = 3

# What parts words and pieces.
BLANKS = b" \t"
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)], _KIND[list(PIECE_ENDS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


# --- Texts to words -------------------------------------------------------------------------------------------------


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """All words of the texts in order: their numbers in a list of different words, that list, and the number of the piece."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    size = int(offsets[-1] - offsets[0])
    if not size:
        return np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(0, np.int32)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    kind = _KIND[raw]
    inside, first = kind == 0, np.zeros(size, bool)
    begins = offsets[:-1] - offsets[0]
    first[begins[begins < size]] = True
    apart = ~inside[:-1] | first[1:]  # the next byte doesn't go on with this one's word
    starts = np.flatnonzero(np.concatenate([inside[:1], inside[1:] & apart]))
    stops = np.flatnonzero(np.concatenate([inside[:-1] & (~inside[1:] | first[1:]), inside[-1:]])) + 1
    pieces = np.cumsum(first | (kind == 2), dtype=np.int32)[starts]
    bounds = np.concatenate([[0], np.cumsum(stops - starts)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(_LOWER[raw[inside]])).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), words.dictionary, pieces


def _texts(batches):
    """(language, texts) of slices of the batches' rows, of SLICE_BYTES or a single text."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            part = batch.slice(at, stop - at)
            langs = part.column("lang").dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                texts = part.column("text")
                yield lang, texts if len(langs.dictionary) == 1 else texts.filter(pa.array(langs.indices.to_numpy() == k))
            at = stop


def _batch(lang: str, columns: list, names: list[str]) -> pa.RecordBatch:
    langs = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(columns[0]), np.int32)))
    return pa.RecordBatch.from_arrays([langs, *(c.cast(pa.string()) if pa.types.is_large_string(c.type) else c for c in columns)], names)


def _count_words(batches):
    """The words of each slice with their numbers; under a null word the number of all."""
    for lang, texts in _texts(batches):
        codes, words, _ = words_of(texts)
        counts = np.bincount(codes, minlength=len(words))
        yield _batch(lang, [pa.concat_arrays([words, pa.nulls(1, words.type)]), pa.array(np.append(counts, len(codes)))], ["lang", "w1", "n"])


# --- What is frequent, in bounded space -----------------------------------------------------------------------------


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def word_hashes(lang: str, words: pa.Array) -> np.ndarray:
    from pandas.util import hash_array

    own = hash_array(np.array([lang], object), categorize=False)
    return _mix(hash_array(np.asarray(words.to_pylist(), object), categorize=False) + own) if len(words) else np.zeros(0, np.uint64)


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mix(left * np.uint64(0xC2B2AE3D27D4EB4F) + right)


def _hashed(batches):
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            own = batch.column("w1").filter(pa.array(langs.indices.to_numpy() == k))
            yield pa.RecordBatch.from_arrays([pa.array(word_hashes(lang, own).view(np.int64))], ["key"])


class Bitmap:
    """Two marks for each key, by the first and the next bits of its hash."""

    def __init__(self, keys: DataFrame):
        """``keys``: a column of hashes. At most 2 ** MOST_BITS bits reach the driver and the tasks."""
        self.bits = min(MOST_BITS, max(15, (BITS_PER_KEY * keys.count()).bit_length()))
        first = F.shiftrightunsigned("key", 64 - self.bits)
        second = F.shiftrightunsigned("key", 64 - 2 * self.bits).bitwiseAND((1 << self.bits) - 1)
        places = keys.select(F.explode(F.array(first + 1, second + 1)).alias("place"))  # Spark's bitmap functions number the bits from 1
        blocks = places.groupBy(F.bitmap_bucket_number("place").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("m")).collect()
        marks = np.zeros(1 << self.bits >> 3, np.uint8)
        for r in blocks:
            at = (r["b"] - 1) * 4096
            marks[at : at + 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
        self.marks = keys.sparkSession.sparkContext.broadcast(marks)

    def _marked(self, place: np.ndarray) -> np.ndarray:
        place = place.astype(np.int64)
        return (self.marks.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)

    def test(self, hashes: np.ndarray) -> np.ndarray:
        found = self._marked(hashes >> np.uint64(64 - self.bits))
        at = np.flatnonzero(found)
        found[at] = self._marked(hashes[at] >> np.uint64(64 - 2 * self.bits) & np.uint64((1 << self.bits) - 1))
        return found


# --- Pairs, projected occurrences, growth ---------------------------------------------------------------------------


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, n = k[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[starts], np.add.reduceat(n, starts) if len(k) else n


def _grams(codes: np.ndarray, hashes: np.ndarray, pieces: np.ndarray, shorter: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases of ``size`` words stand whose parts of one word less are marked in ``shorter``, and their hashes."""
    both = shorter[:-1] & shorter[1:]
    if size == 2:
        both &= pieces[:-1] == pieces[1:]
    at = np.flatnonzero(both)
    found = hashes[codes[at]]
    for k in range(1, size):
        found = pair_hashes(found, hashes[codes[at + k]])
    return at, found


def _marked(codes: np.ndarray, hashes: np.ndarray, pieces: np.ndarray, known: list[Bitmap]) -> list[np.ndarray]:
    """For each length that ``known`` has, which words begin a phrase that may be frequent."""
    marks = [known[0].test(hashes)[codes]] if len(codes) else [np.zeros(0, bool)] * len(known)
    for size in range(len(marks) + 1, len(known) + 1):
        at, found = _grams(codes, hashes, pieces, marks[-1], size)
        on = np.zeros(len(codes), bool)
        on[at] = known[size - 1].test(found)
        marks.append(on)
    return marks


def _count_hashes(known: list[Bitmap]):
    """Hashes of phrases one word longer than those known, with their numbers, summed up over a task as far as HELD_HASHES go."""

    def batch(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    def run(batches):
        keys, counts, held = [], [], 0
        for lang, texts in _texts(batches):
            codes, names, pieces = words_of(texts)
            hashes = word_hashes(lang, names)
            _, found = _grams(codes, hashes, pieces, _marked(codes, hashes, pieces, known)[-1], len(known) + 1)
            found, n = np.unique(found, return_counts=True)
            keys.append(found)
            counts.append(n)
            held += len(n)
            if held > HELD_HASHES:
                k, n = _summed(keys, counts)
                keys, counts, held = [k], [n], len(k)
                if held > HELD_HASHES // 2:
                    yield batch(k, n)
                    keys, counts, held = [], [], 0
        if held:
            yield batch(*_summed(keys, counts))

    return run


def _project(known: list[Bitmap], max_words: int):
    """Occurrences of frequent pairs with what goes on to the right: w1 .. of up to max_words words, null beyond their end."""
    depth = len(known)

    def run(batches):
        for lang, texts in _texts(batches):
            codes, names, pieces = words_of(texts)
            marks = [np.concatenate([m, np.zeros(max_words, bool)]) for m in _marked(codes, word_hashes(lang, names), pieces, known)]
            at = np.flatnonzero(marks[1])
            if not len(at):
                continue
            alive, columns = np.ones(len(at), bool), []
            for k in range(max_words):
                if k >= depth:  # the longest known phrase that ends here
                    alive = alive & marks[depth - 1][at + k + 1 - depth]
                elif k:
                    alive = alive & marks[k][at]
                columns.append(names.take(pa.array(codes[np.minimum(at + k, len(codes) - 1)], mask=~alive)))
            yield _batch(lang, columns, ["lang", *(f"w{k + 1}" for k in range(max_words))])

    return run


def _grow(min_count: int, max_words: int):
    """Phrases of two words and more along sorted occurrences; those at the task's edges whatever they count."""

    def emit(phrases: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*phrases, strict=True), kinds, strict=True)], ["lang", "phrase", "size", "n"])

    def run(batches):
        last: list | None = None
        held: dict[int, list] = {}  # by length: [language, phrase, count, whether it began at the task's edge]
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [pc.fill_null(batch.column(c), "") for c in ("lang", *(f"w{k + 1}" for k in range(max_words)))]
            n = batch.column("n").to_numpy()
            changes = []
            for i, c in enumerate(columns):
                begins = last is None or c[0].as_py() != last[i]
                changes.append(np.concatenate([[begins], pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)]).astype(bool))
            found: list[tuple] = []
            changed = changes[0] | changes[1]
            for size in range(2, max_words + 1):
                changed = changed | changes[size]
                starts = np.flatnonzero(changed)
                if size in held:
                    held[size][2] += int(n[: starts[0] if len(starts) else len(n)].sum())
                if not len(starts):
                    continue
                if size in held:
                    lang, phrase, count, edge = held.pop(size)
                    if phrase is not None and (edge or count >= min_count):
                        found.append((lang, phrase, size, count))
                counts = np.add.reduceat(n, starts)
                ended = np.asarray(pc.equal(columns[size].take(pa.array(starts)), "").to_numpy(zero_copy_only=False), bool)
                keep = (counts >= min_count) & ~ended
                keep[-1] = True
                if last is None:
                    keep[0] = True
                for i in np.flatnonzero(keep).tolist():
                    row = int(starts[i])
                    phrase = None if ended[i] else " ".join(columns[k][row].as_py() for k in range(1, size + 1))
                    if i == len(starts) - 1:
                        held[size] = [columns[0][row].as_py(), phrase, int(counts[i]), last is None and i == 0]
                    elif phrase is not None:
                        found.append((columns[0][row].as_py(), phrase, size, int(counts[i])))
            last = [c[len(n) - 1].as_py() for c in columns]
            if found:
                yield emit(found)
        rest = [(lang, phrase, size, count) for size, (lang, phrase, count, _) in held.items() if phrase is not None]
        if rest:
            yield emit(rest)

    return run


def frequent_phrases(docs: DataFrame, min_count: int = 100, max_words: int = 5, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """lang, phrase, size, n of every phrase of 1 to ``max_words`` words that occurs ``min_count`` times; lang, n of all words."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = F.sum("n").alias("n")
    counted = cut(rows.mapInArrow(_count_words, "lang string, w1 string, n long").groupBy("lang", "w1").agg(total).where(F.col("w1").isNull() | (F.col("n") >= min_count)), "phrase-words")
    words = counted.where("w1 is not null")
    single = words.select("lang", F.col("w1").alias("phrase"), F.lit(1).alias("size"), "n")
    totals = counted.where("w1 is null").select("lang", "n")
    if max_words < 2:
        return single, totals
    known = [Bitmap(words.select("lang", "w1").mapInArrow(_hashed, "key long"))]
    for _ in range(2, min(SEEDED, max_words) + 1):
        counts = rows.mapInArrow(_count_hashes(list(known)), "key long, n long").groupBy("key").agg(total)
        known.append(Bitmap(cut(counts.where(F.col("n") >= min_count).select("key"), "phrase-seeds")))
    names = [f"w{k + 1}" for k in range(max_words)]
    shape = ", ".join(["lang string", *(f"{w} string" for w in names)])
    # Written first, since dealing by ranges reads the rows twice.
    projected = cut(rows.mapInArrow(_project(known, max_words), shape).groupBy("lang", *names).agg(F.count("*").alias("n")), "phrase-occurrences")
    order = ["w1", "w2", "lang", *names[2:]]
    grown = projected.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_grow(min_count, max_words), "lang string, phrase string, size int, n long")
    long = grown.groupBy("lang", "phrase", "size").agg(total).where(F.col("n") >= min_count)
    return cut(single.unionByName(long), "phrases"), totals


# --- Scores ---------------------------------------------------------------------------------------------------------


def _exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def _joined(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    docs: DataFrame,
    min_count: int = 100,
    max_words: int = 5,
    top: int = 2000,
    cover_percent: int = 100,
    scale: int = 1000,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two words and more.

    A phrase's score is that of its weakest cut in two: ``scale`` times how many times oftener the parts stand together
    than independent ones would, floored. A phrase goes if a longer one that holds it occurs ``cover_percent`` of a
    hundred times as often; it is enough to look at those longer by one word, as they occur at least as often.
    """
    counts, totals = frequent_phrases(docs, min_count, max_words, lang_col, text_col)
    phrases = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    split = F.split("phrase", " ")
    inner = F.explode(F.array(_joined(split, 1, F.col("size") - 1), _joined(split, 2, F.col("size") - 1)))
    covers = phrases.where("size > 2").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_cover"))
    open_ = phrases.join(covers, ["lang", "phrase"], "left").where(F.col("_cover").isNull() | (F.col("_cover") * 100 < F.col("a") * cover_percent)).drop("_cover")
    cuts = open_.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(split, 1, F.col("k")).alias("_left"), _joined(split, F.col("k") + 1, F.col("size") - F.col("k")).alias("_right"))
    known = counts.select("lang", "phrase", "n")
    left, right = known.toDF("lang", "_left", "l"), known.toDF("lang", "_right", "r")
    scored = cuts.join(left, ["lang", "_left"]).join(right, ["lang", "_right"]).join(totals, "lang")
    whole = (_exact("a") * _exact("n") * F.lit(scale).cast("decimal(10,0)")).alias("whole")
    scored = scored.select("lang", "phrase", "a", "n", "k", "l", "r", whole, (_exact("l") * _exact("r")).alias("parts")).withColumn("score", F.expr("whole div parts"))
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    ranked = weakest.select("lang", "phrase", "a", "n", "c.l", "c.r", "c.score")
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql(min_count: int = 100, max_words: int = 5, top: int = 2000, cover_percent: int = 100, scale: int = 1000) -> str:
    """The same by self-contained SQL over ``documents``."""
    leads = ", ".join(f"lead(word, {k}) OVER w AS w{k + 1}" for k in range(1, max_words))
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS size, {' || chr(32) || '.join(f'w{i + 1}' for i in range(k))} AS phrase FROM grams WHERE w{k} IS NOT NULL" for k in range(1, max_words + 1))
    return rf"""
        WITH texts AS (
            SELECT row_number() OVER () AS t, coalesce(lang, 'und') AS lang,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents
        ), pieces AS (
            SELECT t, lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece, generate_subscripts(string_split_regex(text, '[.,;:!?\x0A-\x0D]'), 1) AS p FROM texts
        ), words AS (
            SELECT * FROM (SELECT t, p, lang, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT t, p, lang, string_split_regex(piece, '[\x20\x09]+') AS ws FROM pieces)) WHERE word <> ''
        ), grams AS (
            SELECT lang, word AS w1, {leads} FROM words WINDOW w AS (PARTITION BY t, p ORDER BY i)
        ), counts AS (
            SELECT lang, size, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {min_count}
        ), totals AS (
            SELECT lang, count(*) AS n FROM words GROUP BY lang
        ), phrases AS (
            SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE size > 1
        ), inner_phrases AS (
            SELECT lang, array_to_string(ws[s:s + m - 1], ' ') AS phrase, max(a) AS cover
            FROM phrases, range(2, {max_words}) AS m(m), range(1, {max_words}) AS s(s)
            WHERE m < size AND s + m - 1 <= size GROUP BY ALL
        ), cuts AS (
            SELECT q.lang, q.phrase, q.a, k, array_to_string(ws[:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp
            FROM phrases q LEFT JOIN inner_phrases i USING (lang, phrase), range(1, {max_words}) AS k(k)
            WHERE k < size AND NOT coalesce(100 * cover >= {cover_percent} * q.a, false)
        ), scored AS (
            SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n, CAST({scale}::HUGEINT * a * n // (x.f::HUGEINT * y.f) AS BIGINT) AS score
            FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = lp JOIN counts y ON y.lang = c.lang AND y.phrase = rp JOIN totals t ON t.lang = c.lang
        ), weakest AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        )
        SELECT lang, rank, phrase, a, l, r, n, score
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest) WHERE rank <= {top}"""
