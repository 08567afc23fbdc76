"""Fill-in-middle transformation by lookaround splitting.

A unit grammar says by their classes which neighbouring characters stay together. ``boundary`` translates it to a regex of
zero width: a place is a boundary if the classes of its two neighbours say so. Spark's split at that regex keeps
every character, so the pieces of a text joined together are the text. Prefix, middle and suffix are whole pieces.

Java's regexes go over code points, so no piece ends within a surrogate pair. An empty text has no unit (split would give
one empty piece) and stays plain, as does a text that holds one of the three sentinels. Null texts count as empty; a null
id is drawn like an empty one. Repeated rows get the same cuts. Other columns are ignored; empty tables give empty ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class UnitGrammar:
    """Which neighbours stay together: pairs of insides of character classes of Java's regexes, for the left and the right one."""

    together: tuple[tuple[str, str], ...] = ()


CODE_POINTS = UnitGrammar()
WORD_CHARACTERS = r"\p{L}\p{M}\p{N}_"
#: A word keeps the white space after it; every other character is a unit of its own.
WORDS = UnitGrammar(((WORD_CHARACTERS, WORD_CHARACTERS), (r"\s\S", r"\s")))
#: A line keeps its line feed.
LINES = UnitGrammar(((r"^\n", r"\s\S"),))


def boundary(grammar: UnitGrammar) -> str:
    """The zero-width regex of all places between two characters that don't stay together."""
    kept = "".join(f"(?!(?<=[{left}])[{right}])" for left, right in grammar.together)
    return rf"(?<=[\s\S])(?=[\s\S]){kept}"


def units(text: Column, grammar: UnitGrammar = CODE_POINTS) -> Column:
    """The pieces of a text in order; none of an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def draw(id_text: Column, seed: int, k: int) -> Column:
    """The k-th 8-digit group of the sha256 of seed and id, as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), id_text), 256), 8 * k + 1, 8), 16, 10).cast("bigint")


def fill_in_middle(
    docs: DataFrame,
    grammar: UnitGrammar = CODE_POINTS,
    percent: int = 90,
    spm_percent: int = 20,
    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>"),
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, text, n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain) and output of every row.

    Of texts with units and without sentinels, ``percent`` of a hundred are cut at two drawn places, and of these
    ``spm_percent`` put the suffix first.
    """
    p, s, m = sentinels
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    plain = (F.col("text") == "") | F.contains("text", F.lit(p)) | F.contains("text", F.lit(s)) | F.contains("text", F.lit(m)) | (draw(own, seed, 2) % 100 >= percent)
    rows = rows.select("doc_id", "text", units(F.col("text"), grammar).alias("_units"), F.when(plain, "plain").when(draw(own, seed, 3) % 100 < spm_percent, "spm").otherwise("psm").alias("form"))
    rows = rows.withColumn("n", F.size("_units").cast("bigint"))
    a, b = (draw(own, seed, k) % (F.col("n") + 1) for k in (0, 1))
    rows = rows.withColumns({"_first": F.least(a, b).cast("int"), "_last": F.greatest(a, b).cast("int")})
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("_units", start + 1, length), ""))
    rows = rows.select(
        "doc_id",
        "text",
        "n",
        "form",
        part(F.lit(0), F.col("_first")).alias("prefix"),
        part(F.col("_first"), F.col("_last") - F.col("_first")).alias("middle"),
        part(F.col("_last"), F.size("_units") - F.col("_last")).alias("suffix"),
    )
    psm, spm = F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle"), F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")
    return rows.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that an output was made of: its parts lie between the sentinels, which a cut text doesn't hold."""
    p, s, m = sentinels
    middle = F.substring_index(output, m, -1)
    between = lambda start, end: F.substring_index(F.substring_index(output, end, 1), start, -1)
    psm, spm = F.concat(between(p, s), middle, between(s, m)), F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
