"""SpotSigs fingerprints, from DataFrame functions only.

A signature is a chain: a common-word anchor and the ``chain`` content words (words that are no anchors) that follow
it, others skipped; near the end there are fewer. A text's fingerprint is the set of its signatures' hashes, and its
string holds them all, so that the likeness of two texts can be told from their strings. A text without any anchor takes
all its words as anchors, with empty names: else all such texts would be alike. Words are runs of letters and digits of
the lower-cased text.

``similar_pairs`` finds all pairs of different sets with a Jaccard of at least ``threshold``. Sets are partitioned by
their length so that similar ones lie in the same or in neighbouring partitions; in these, only sets that share one of
their rarest signatures are compared (a set of n has n - ceil(threshold n) + 1 that matter), and of those only with
lengths that the threshold allows. Equal sets are one class, and pairs are between classes.

Null texts count as empty; the empty set is like only itself. Rows may repeat. Null ids sort after all others. Empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bucket_of, cut, let, ordered_bounds

# Common words of four languages that serve as anchors.
ANCHORS = (
    "the of and to in is it that for was with as be by on are this from at or an not have has had but they which you we he she his her their there been if when will would who what can all were "
    "der die das und ist von zu den mit im ein eine nicht auf für als auch dem des sich es bei aus nach wird an um am sind noch wie einer "
    "le la les de du et un une en est que qui dans pour pas par sur au avec ce il se sont plus ou aux "
    "el los las y del que se por con no una para su al lo como más o pero sus"
).split()


def chains(text: Column, chain: int = 2, anchors: list[str] | None = None) -> Column:
    """The sorted set of signature hashes of a text, array<bigint>."""
    common = sorted(set(ANCHORS if anchors is None else anchors))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def signature(name: Column, content: Column, at: Column) -> Column:
        return F.xxhash64(name, *[F.get(content, at + k) for k in range(chain)])

    def of_words(w: Column) -> Column:
        places = F.array_compact(F.transform(w, lambda x, i: F.when(x.isin(common), i)))
        content = F.filter(w, lambda x: ~x.isin(common))
        # The k-th anchor, at place p, has p - k content words before it.
        spotted = let(places, lambda p: let(content, lambda c: F.transform(p, lambda place, k: signature(F.get(w, place), c, place - k))))
        return F.when(F.size(places) == 0, F.transform(w, lambda x, i: signature(F.lit(""), w, i))).otherwise(spotted)

    return F.sort_array(F.array_distinct(let(words, of_words)))


def fingerprint_string(signatures: Column) -> Column:
    """A set as text: how many signatures, and the last 32 bits of each in eight hex digits, in the set's order."""
    digits = F.array_join(F.transform(signatures, lambda s: F.right(F.lpad(F.hex(s), 16, "0"), F.lit(8))), "")
    return F.concat(F.size(signatures).cast("string"), F.lit("-"), F.lower(digits))


def class_name(signatures: Column) -> Column:
    """A short name of a set: how many signatures, and a hash of them."""
    return F.concat(F.size(signatures).cast("string"), F.lit("-"), F.lower(F.lpad(F.hex(F.xxhash64(signatures)), 16, "0")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two sets; pruned where the lengths already tell that nothing is shared."""
    shared = let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    both_empty = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(both_empty, 1.0).when(F.least(F.size(a), F.size(b)) == 0, 0.0).when(a == b, 1.0).otherwise(shared)


# --- A document, its edited text and the next document ------------------------------------------------------------


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 400, own: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, text, next_text: the next row by descending id; after the last comes the first. With ``own`` also own and
    next_own: a value of the row's text, which is computed once, and the next row's.

    Ids are cut into ordered buckets, and each bucket's least upper neighbour goes to it as well, so that every next
    row is in the same bucket and no task sorts the whole table.
    """
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), key.alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = ordered_bounds(rows, "_key", rows_per_bucket)
    top = rows.agg(F.max(F.struct("_key", F.xxhash64("text").alias("_tie"))).alias("t")).first()["t"]
    value = F.lit(None) if own is None else own(F.col("text"))
    names = ["doc_id", "text", "next_text", *([] if own is None else ["own", "next_own"])]
    if top is None:
        return rows.select("*", F.col("text").alias("next_text"), value.alias("own"), value.alias("next_own")).select(names)
    # Ghost rows: a bucket's last row (its boundary) precedes the next bucket's first; the first row of all follows the last.
    bucket = bucket_of(F.col("_key"), bounds)
    edge = F.col("_key").isin(bounds) if bounds else F.lit(False)
    tie = F.xxhash64("text")
    is_top = (F.col("_key") == top["_key"]) & (tie == top["_tie"])
    copies = F.array(F.struct(bucket.alias("b"), F.lit(0).alias("ghost")), F.when(edge, F.struct((bucket + 1).alias("b"), F.lit(1).alias("ghost"))), F.when(is_top, F.struct(F.lit(0).alias("b"), F.lit(2).alias("ghost"))))
    dealt = rows.withColumn("_tie", tie).withColumn("_c", F.explode(F.array_compact(copies))).select("doc_id", "_key", "_tie", "text", F.col("_c.b").alias("_bucket"), F.col("_c.ghost").alias("_ghost"))
    # Ghosts sort below the bucket's own rows; the top row's ghost below all.
    lowest = F.when(F.col("_ghost") == 2, 0).otherwise(1)
    order = W.partitionBy("_bucket").orderBy(lowest, "_key", "_tie", "_ghost")
    rows = dealt.withColumn("own", value).withColumns({"next_text": F.lag("text").over(order), "next_own": F.lag("own").over(order)})
    return rows.where("_ghost = 0").select(names)


def edited(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by the first as many of the next text."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def fingerprint_documents(docs: DataFrame, chain: int = 2, id_col: str = "doc_id", text_col: str = "text", anchors: list[str] | None = None) -> DataFrame:
    """doc_id, text, edited_text, next_text with the signature sets of each: signatures, edited_signatures, next_signatures."""
    signatures = lambda text: chains(text, chain, anchors)
    rows = with_next(docs, id_col, text_col, own=signatures).withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    return rows.select("doc_id", "text", "edited_text", "next_text", F.col("own").alias("signatures"), signatures(F.col("edited_text")).alias("edited_signatures"), F.col("next_own").alias("next_signatures"))


# --- All similar pairs ----------------------------------------------------------------------------------------------


def fingerprint_classes(docs: DataFrame, chain: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, class_id) for every row, and (class_id, signatures) for every different set; class_id names the set."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), chains(F.coalesce(F.col(text_col), F.lit("")), chain).alias("signatures"))
    rows = cut(rows.withColumn("class_id", class_name(F.col("signatures"))), "spotsigs")
    return rows.select("doc_id", "class_id"), rows.groupBy("class_id").agg(F.first("signatures").alias("signatures"))


def similar_pairs(classes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """a < b, jaccard: all pairs of classes at or over ``threshold``."""
    n = F.size("signatures")
    sized = classes.where(n > 0).select("class_id", "signatures", n.alias("n")).withColumn("part", F.floor(F.log(F.col("n")) / -F.log(F.lit(threshold))).cast("int"))
    sized = cut(sized, "spotsigs-sized")
    frequency = sized.select(F.explode("signatures").alias("s")).groupBy("s").agg(F.count("*").alias("df"))
    spread = sized.select("class_id", "n", "part", F.explode("signatures").alias("s")).join(frequency, "s")
    rank = F.row_number().over(W.partitionBy("class_id").orderBy("df", "s"))
    kept = spread.withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    kept = cut(kept.where("df > 1").select("class_id", "n", "part", "s"), "spotsigs-prefixes")
    a = kept.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "part", "s")
    # Each set also stands in the partition below its own, where shorter similar sets are.
    b = kept.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), F.explode(F.array("part", F.col("part") - 1)).alias("part"), "s")
    fits = (F.col("na") >= F.col("nb") * threshold) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
    found = a.join(b, ["part", "s"]).where(fits).select("a", "b").distinct()
    sets = sized.select("class_id", "signatures")
    full = found.join(sets.withColumnsRenamed({"class_id": "a", "signatures": "sa"}), "a").join(sets.withColumnsRenamed({"class_id": "b", "signatures": "sb"}), "b")
    scored = full.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("sa"), F.col("sb")).alias("jaccard"))
    return scored.where(F.col("jaccard") >= threshold)
