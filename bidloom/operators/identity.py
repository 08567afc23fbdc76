"""Customer identity: normalised names, tax numbers, first rows and surrogate ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_name, normalize_name_sql
from ..sources.shared import cut


def first_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the one with the least ``order``: an aggregate, no sort."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_r")).select(key, "_r.*").select(*rows.columns)


def backfill_customers(legacy: DataFrame, customer: str = "customer", row_id: str = "id") -> tuple[DataFrame, DataFrame]:
    """(customers, links): one customer for each normalised name, named as in the first row, and row -> name key."""
    named = legacy.withColumn("normalized_name", normalize_name_sql(customer)).where(F.coalesce("normalized_name", F.lit("")) != "")
    customers = named.groupBy("normalized_name").agg(F.min_by(F.col(customer), row_id).alias("name"), F.min(row_id).alias("first_id"))
    return customers, named.select(row_id, "normalized_name").join(customers, "normalized_name")


def surrogate_ids(rows: DataFrame, key: str, order: str, start: int = 1) -> DataFrame:
    """key, surrogate_id: new keys in order of first arrival. The keys' first places are ranked in order buckets."""
    from .ranking import ordinal_rank

    first = rows.groupBy(key).agg(F.min(order).alias("_first"))
    return ordinal_rank(first, "_first", key, "_n").select(key, (F.col("_n") + (start - 1)).alias("surrogate_id"))


def append_customers(customers: DataFrame, names: DataFrame, start: int, name: str = "name", order: str = "id") -> tuple[DataFrame, DataFrame]:
    """(customers with one row more for each normalised name that they lack, name key -> customer id of all names asked).

    New ids go on from ``start`` in the order of first arrival; names that are there already change nothing.
    """
    asked = names.withColumn("normalized_name", normalize_name(name)).where("normalized_name <> ''")
    lacking = asked.join(customers.select("normalized_name"), "normalized_name", "left_anti")
    first = lacking.groupBy("normalized_name").agg(F.min_by(F.col(name), order).alias("name"), F.min(order).alias(order))
    ids = surrogate_ids(first, "normalized_name", order, start).withColumnRenamed("surrogate_id", "id")
    added = cut(first.drop(order).join(ids, "normalized_name").select("id", "name", "normalized_name"), "customers")
    after = customers.unionByName(added, allowMissingColumns=True)
    return after, asked.select("normalized_name").distinct().join(after.select("normalized_name", F.col("id").alias("customer_id")), "normalized_name")


FOLDED = "record_id long, customer_id long, new_name string, new_inn string, backfilled_inn string, created string, held string, since long"
ANSWER = ["record_id", "customer_id", "new_name", "new_inn", "backfilled_inn"]
ALWAYS = -(1 << 63)


def _fold(frame):
    """The deciding records of one connected group of names and tax numbers, in order of arrival; known customers come first.

    Besides the records' answers it tells which name a customer was created for, and which customer a number means since
    when (held, since).
    """
    import pandas as pd

    text = lambda v: v if isinstance(v, str) and v else None
    by_name, by_inn, inn_of, out = {}, {}, {}, []  # inn_of has the customers in order of age
    age: dict[int, int] = {}

    def hold(inn, customer, since) -> None:
        holder = by_inn.get(inn)
        if holder is None or age[customer] < age[holder]:  # two customers with one number: it means the older one
            by_inn[inn] = customer
            out.append((None, customer, None, None, None, None, inn, since))

    for r in frame.sort_values(["is_record", "arrival"]).itertuples():
        inn = text(r.inn)
        if not r.is_record:
            by_name.setdefault(r.norm, r.arrival)
            inn_of[r.arrival], age[r.arrival] = inn, len(age)
            if inn:
                hold(inn, r.arrival, ALWAYS)
            continue
        known, new_name, new_inn, filled = by_name.get(r.norm), None, None, None
        if known is not None:
            if inn and not inn_of[known]:
                inn_of[known], filled = inn, inn
                hold(inn, known, r.arrival)
        elif inn in by_inn:
            known = by_inn[inn]
        else:
            known = -1 - r.arrival  # a new customer, called by the record that made it
            by_name[r.norm], inn_of[known], age[known], new_name, new_inn = known, inn, len(age), r.name_text, inn
            if inn:
                hold(inn, known, r.arrival)
        out.append((r.arrival, known, new_name, new_inn, filled, r.norm if new_name is not None else None, None, None))
    rows = pd.DataFrame(out, columns=[c.split()[0] for c in FOLDED.split(", ")])
    return rows.astype({c: "Int64" for c in ("record_id", "customer_id", "since")})


def _deciding(records: DataFrame, known: DataFrame) -> DataFrame:
    """arrival of the records that can make a customer or fill in a number; what the others mean follows from them.

    Of names with one number alone, which are new, only the first record of each number counts. Of other names the first
    with each number does, and the first with a number after the first without one.
    """
    number = F.nullif(F.col("inn"), F.lit(""))
    pairs = cut(records.groupBy("norm", number.alias("number")).agg(F.min("arrival").alias("first")), "pairs")
    plain = pairs.groupBy("norm").agg(F.count("*").alias("k"), F.count("number").alias("numbers"), F.min(F.when(F.col("number").isNull(), F.col("first"))).alias("bare"))
    leaf = plain.where("k = 1 and numbers = 1").select("norm").join(known.select("norm").distinct(), "norm", "left_anti").withColumn("leaf", F.lit(True))
    marked = pairs.join(leaf, "norm", "left")
    firsts = marked.where("leaf").groupBy("number").agg(F.min("first").alias("arrival")).select("arrival")
    others = marked.where("leaf is null").select(F.col("first").alias("arrival"))
    bare = plain.where("bare is not null and numbers > 0").select("norm", "bare")
    later = records.where(number.isNotNull()).join(bare, "norm").where("arrival > bare").groupBy("norm").agg(F.min("arrival").alias("arrival")).select("arrival")
    return firsts.unionByName(others).unionByName(later).distinct()


def resolve_customers(records: DataFrame, customers: DataFrame, record_id: str = "id", customer: str = "customer", inn: str = "inn") -> DataFrame:
    """record_id, customer_id, new_name, new_inn, backfilled_inn in the order of record ids.

    A record takes the customer of its normalised name (and gives it a missing tax number), else the one of its tax
    number, else it makes a new customer; new ones have the id -1 - record id. A number that several customers have means
    the oldest: known ones by id, then new ones in order of arrival. What one record does later ones see; so the deciding
    records that names and tax numbers connect are folded in order, each connected group by itself, and the others look
    up what their name and number meant when they came.
    """
    from .graph import components

    new = records.select(F.lit(True).alias("is_record"), F.col(record_id).cast("long").alias("arrival"), F.col(customer).alias("name_text"), F.col(inn).alias("inn"), normalize_name(customer).alias("norm")).where("norm <> ''")
    old = customers.select(F.lit(False).alias("is_record"), F.col("id").cast("long").alias("arrival"), F.col("name").alias("name_text"), F.col("inn").alias("inn"), F.col("normalized_name").alias("norm"))
    # Only customers that a record can meet take part.
    met = old.join(new.select("norm").distinct(), "norm", "left_semi").unionByName(old.where("inn <> ''").join(new.where("inn <> ''").select("inn").distinct(), "inn", "left_semi")).distinct()
    every = new.unionByName(met)
    # Names that one tax number connects hang together; names are linked to the least name of each number.
    least = every.where("inn <> ''").groupBy("inn").agg(F.min("norm").alias("m"), F.count_distinct("norm").alias("k")).where("k > 1")
    links = every.where("inn <> ''").join(least, "inn").select(F.col("m").alias("a"), F.col("norm").alias("b")).where("a <> b").distinct()
    linked = components(links).withColumnRenamed("node", "norm")
    alone = _resolve_alone(new.join(linked.select("norm"), "norm", "left_anti"), met)
    if not linked.limit(1).count():
        return alone
    group = cut(every.join(linked, "norm"), "connected")
    members, known = group.where("is_record"), group.where("not is_record")
    deciding = cut(_deciding(members, known), "deciding")
    folded = known.unionByName(members.join(deciding, "arrival", "left_semi").select(*known.columns)).groupBy("root").applyInPandas(_fold, FOLDED)
    folded = cut(folded, "folded")
    names = folded.where("created is not null").select(F.col("created").alias("norm"), F.col("record_id").alias("since"), F.col("customer_id").alias("own"))
    names = names.unionByName(known.groupBy("norm").agg(F.lit(ALWAYS).alias("since"), F.min("arrival").alias("own")))
    # A number changes to older customers only, so that its list stays short.
    numbers = folded.where("held is not null").groupBy(F.col("held").alias("inn")).agg(F.array_sort(F.collect_list(F.struct("since", "customer_id"))).alias("holders"))
    others = members.join(deciding, "arrival", "left_anti").join(names, "norm", "left").join(numbers, "inn", "left")
    holder = F.element_at(F.filter("holders", lambda h: h["since"] < F.col("arrival")), -1)["customer_id"]
    nothing = [F.lit(None).cast("string").alias(c) for c in ANSWER[2:]]
    looked_up = others.select(F.col("arrival").alias("record_id"), F.when(F.col("since") < F.col("arrival"), F.col("own")).otherwise(holder).alias("customer_id"), *nothing)
    return alone.unionByName(folded.where("record_id is not null").select(*ANSWER)).unionByName(looked_up)


def _resolve_alone(new: DataFrame, known: DataFrame) -> DataFrame:
    """The same for names that share no tax number with another name: their first rows tell everything."""
    with_inn = F.coalesce(F.col("inn"), F.lit("")) != ""
    own = known.groupBy("norm").agg(F.min("arrival").alias("known_id"), F.min_by("inn", "arrival").alias("known_inn"))
    first = new.groupBy("norm").agg(F.min("arrival").alias("first"), F.min_by("inn", "arrival").alias("first_inn"), F.min(F.when(with_inn, F.col("arrival"))).alias("inn_at"))
    named = first.join(own, "norm", "left").withColumn("has", F.coalesce(F.nullif(F.coalesce("known_inn", F.when(F.col("known_id").isNull(), F.col("first_inn"))), F.lit("")), F.lit("")) != "")
    rows = new.join(named, "norm")
    makes = F.col("known_id").isNull() & (F.col("arrival") == F.col("first"))
    return rows.select(
        F.col("arrival").alias("record_id"),
        F.coalesce(F.col("known_id"), -1 - F.col("first")).alias("customer_id"),
        F.when(makes, F.col("name_text")).alias("new_name"),
        F.when(makes, F.nullif(F.col("inn"), F.lit(""))).alias("new_inn"),
        F.when(~F.col("has") & (F.col("arrival") == F.col("inn_at")), F.col("inn")).alias("backfilled_inn"),
    )
