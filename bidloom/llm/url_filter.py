"""URL filters with a cascade of Bloom filters, from DataFrame functions only.

The universe is every different host of the corpus. Level 0 encodes the listed hosts; level 1 the hosts of the
universe that pass level 0 without being listed; level 2 the listed hosts that pass level 1, and so on until a level
lets nothing wrong through. A host of the universe is listed if the first level that it fails, or else the number of
levels, is even or odd accordingly: exact membership without joins. The filters are bounded by the number of listed hosts
and their first false positives; over ``most_bytes`` of bits, which every task would have to hold, ``listed_flag`` gives
the same answer by a join with the list. The list is a table from outside; hosts of it that no page has take no room.

Rules stand above the list: a rule fits its host and all subdomains if the path starts with the rule's; the longest
one wins. Null urls and urls without "://" have empty host and path; the empty host is a key like any other. Rows may
repeat. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host up to /, ?, # or the end with A-Z lower-cased, then the path up to ?, # or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits; null where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, own, start in reversed(ordered):
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, own + start).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


class BloomCascade:
    """Levels of (words, how many bits, hashes); bits are 64-bit words in one array for each level."""

    def __init__(self, levels: list[tuple[list[int], int, int]]):
        self.levels = levels

    @staticmethod
    def _places(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(1000 * level + k)), F.lit(bits)) for k in range(hashes)]

    @classmethod
    def passes(cls, key: Column, level: int, words: Column, bits: int, hashes: int) -> Column:
        """Whether all the key's bits of a level are set."""
        out = F.lit(True)
        for place in cls._places(key, level, bits, hashes):
            word = F.get(words, F.floor(place / 64).cast("int"))
            out = out & (F.call_function("shiftright", word, (place % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out

    @classmethod
    def build(cls, universe: DataFrame, listed: DataFrame, rate: float = 0.02, later_rate: float = 0.5, most_bytes: int = 16 << 20) -> BloomCascade | None:
        """``universe`` and ``listed`` have a column key; keys may repeat. None if the bits would go over ``most_bytes``."""
        marks = universe.select("key", F.lit(True).alias("own"), F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(False).alias("own"), F.lit(True).alias("listed")))
        flagged = marks.groupBy("key").agg(F.max("own").alias("own"), F.max("listed").alias("listed")).where("own")
        flagged = cut(flagged.select("key", "listed"), "url-keys")
        levels: list[tuple[list[int], int, int]] = []
        coded, other = flagged.where("listed").select("key"), flagged.where("not listed").select("key")
        used = 0
        while n := coded.count():
            level, p = len(levels), rate if not levels else later_rate
            bits = 64 * max(1, math.ceil(-n * math.log(p) / math.log(2) ** 2 / 64))
            hashes = max(1, round(bits / n * math.log(2)))
            hashes = min(hashes, 16)
            used += bits // 8
            if used > most_bytes:
                return None
            place = F.explode(F.array(*cls._places(F.col("key"), level, bits, hashes)))
            found = coded.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))).alias("bits"))
            words = [0] * (bits // 64)
            for r in found.collect():  # a level's bits, bounded by most_bytes
                words[r["w"]] = r["bits"]
            levels.append((words, bits, hashes))
            wrong = other.where(cls.passes(F.col("key"), level, cls._array(words), bits, hashes))
            coded, other = cut(wrong, "url-level"), coded
        return cls(levels)

    @staticmethod
    def _array(words: list[int]) -> Column:
        """The words as a constant, folded once when the plan is made."""
        return F.from_json(F.lit("[" + ",".join(map(str, words)) + "]"), "array<bigint>")

    def contains(self, key: Column) -> Column:
        """Exact for keys of the universe: a key's kind is told by the first level that it fails."""
        out = F.lit(len(self.levels) % 2 == 1)  # passed them all: the last level's kind
        for level in range(len(self.levels) - 1, -1, -1):
            words, bits, hashes = self.levels[level]
            out = F.when(~self.passes(key, level, self._array(words), bits, hashes), F.lit(level % 2 == 1)).otherwise(out)
        return out


def listed_flag(rows: DataFrame, key: str, listed: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """Adds a boolean column ``listed``: whether the row's key is among ``listed.key``; null keys are not."""
    universe = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"))
    cascade = BloomCascade.build(universe, listed.where("key is not null").select("key"), most_bytes=most_bytes)
    if cascade is None:
        marks = listed.select(F.col("key").alias("__listed")).distinct()
        return rows.join(marks, F.col(key) == F.col("__listed"), "left").withColumn("listed", F.col("__listed").isNotNull()).drop("__listed")
    return rows.withColumn("listed", F.col(key).isNotNull() & cascade.contains(F.coalesce(key, F.lit(""))))


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for every row; ``listed`` has the listed hosts in key."""
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = listed_flag(rows, "host", listed)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
