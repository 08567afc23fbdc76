"""License scans by diagonal voting.

Every rolling k-gram of a document's words is hashed and joined to the places of the license templates' k-grams. A
match votes for its diagonal: document place less template place. Votes are summed by document, template and diagonal,
and those of neighbouring diagonals (inserted or dropped words) are merged. Where they are enough, every window that
begins on a diagonal and ends on it or a neighbouring one is verified by the edit distance between its words and the
template's; the best window of a neighbourhood is a span, however many diagonals follow one another, and at one place
the likest template counts.

Besides, the exact places of fixed phrases are found: those labels always stay, and the templates' labels join them.

Words are runs of letters of any script and digits in the text with A-Z lower-cased, as the pattern below says. Null
texts count as empty. Rows that repeat an id and a text get equal results each. Null ids are kept. Empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, let

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Template sentences of well-known licenses and the labels they give.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), lambda w: w != "")


def k_grams(words: Column, k: int) -> Column:
    """Hashes of the rolling k-grams, array<bigint>; empty for fewer words."""
    last = F.size(words) - k
    gram = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), gram)).otherwise(F.array().cast("array<bigint>"))


def phrase_places(words: Column, phrases: list[str]) -> Column:
    """Per phrase the places where its words stand one after another; array of arrays."""
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))

    def of(j: Column) -> Column:
        found = []
        for phrase in phrases:
            parts = phrase.split()
            here = F.filter(F.transform(words, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())  # noqa: B023
            full = F.filter(here, lambda i: F.slice(words, i + 1, len(parts)) == F.array(*map(F.lit, parts)))  # noqa: B023
            found.append(F.when(F.contains(j, F.lit(f" {phrase} ")), full).otherwise(F.array().cast("array<int>")))
        return F.array(*found)

    return let(joined, of)


def _templates(spark, templates, k: int) -> DataFrame:
    rows = spark.createDataFrame([(t, label, text) for t, (label, text) in enumerate(templates)], "template int, label string, template_text string")
    return rows.withColumn("template_words", words_of(F.col("template_text"))).withColumn("grams", k_grams(F.col("template_words"), k))


def template_spans(candidates: DataFrame, templates: DataFrame, k: int, gap: int = 3, least_votes: float = 0.4, least_likeness: float = 0.75) -> DataFrame:
    """key, label, start, length, likeness of verified spans. ``candidates``: key (once each) and words.

    Where templates are alike, the likest one at a place counts: of spans that begin within fewer words than the shortest
    template has, only the best stay.
    """
    reach = templates.agg(F.min(F.size("template_words"))).first()[0] or 1
    places = F.broadcast(templates.select("template", F.posexplode("grams").alias("at", "gram")))  # as many as template words
    rolled = candidates.select("key", F.posexplode(k_grams(F.col("words"), k)).alias("pos", "gram"))
    votes = rolled.join(places, "gram").groupBy("key", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"))
    around = W.partitionBy("key", "template").orderBy("diagonal").rangeBetween(-gap, gap)
    merged = votes.select("key", "template", "diagonal", F.sum("votes").over(around).alias("votes"), F.collect_list("diagonal").over(around).alias("ends"))
    known = F.broadcast(templates.select("template", "label", "template_words", F.size("grams").alias("n_grams")))
    enough = merged.join(known, "template").where(F.col("votes") >= F.greatest(F.lit(1), F.ceil(F.col("n_grams") * least_votes)))
    # A window ends where the template would end on the same or a neighbouring diagonal.
    windows = enough.withColumn("end", F.explode("ends")).join(candidates, "key")
    windows = windows.withColumn("start", F.greatest("diagonal", F.lit(0))).withColumn("length", F.least(F.col("end") + F.size("template_words"), F.size("words")) - F.col("start"))
    text, wanted = F.array_join(F.slice("words", F.col("start") + 1, F.col("length")), " "), F.array_join("template_words", " ")
    scored = windows.where("length > 0").select("key", "template", "label", "diagonal", "start", "length", (1 - F.levenshtein(text, wanted) / F.greatest(F.length(text), F.length(wanted))).alias("likeness"))
    scored = scored.where(F.col("likeness") >= least_likeness)
    best = scored.groupBy("key", "template", "label", "diagonal").agg(F.max(F.struct("likeness", (-F.col("length")).alias("l"), (-F.col("start")).alias("s"))).alias("w"))
    top = F.max("w").over(W.partitionBy("key", "template").orderBy("diagonal").rangeBetween(-gap, gap))
    spans = best.withColumn("top", top).where("w = top").withColumn("start", -F.col("w.s"))
    likest = F.max("w.likeness").over(W.partitionBy("key").orderBy("start").rangeBetween(1 - reach, reach - 1))
    spans = spans.withColumn("likest", likest).where("w.likeness = likest")
    return spans.select("key", "label", (-F.col("w.s")).alias("start"), (-F.col("w.l")).alias("length"), F.col("w.likeness").alias("likeness")).distinct()


def scan_licenses(docs: DataFrame, k: int = 3, templates=TEMPLATES, phrases: dict[str, str] = BASE_PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    spark = docs.sparkSession
    known = _templates(spark, templates, k)
    grams = sorted({r["g"] for r in known.select(F.explode("grams").alias("g")).collect()})  # the templates' own
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.hex(F.xxhash64(text)))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), key.alias("key"), words_of(text).alias("words"))

    def facts(w: Column) -> Column:
        hit = F.arrays_overlap(k_grams(w, k), F.array(*[F.lit(g).cast("bigint") for g in grams]))
        found = phrase_places(w, list(phrases))
        return F.struct(F.size(w).cast("bigint").alias("n_words"), hit.alias("hit"), found.alias("found"), F.when(hit, w).alias("words"))

    # One pass over the texts: what the phrases need, and the words of rows that share a k-gram with a template.
    scanned = cut(rows.select("doc_id", "key", let(F.col("words"), facts).alias("_f")).select("doc_id", "key", "_f.*"), "license-scan")
    candidates = scanned.where("hit").select("key", "words").dropDuplicates(["key"])
    spans = template_spans(candidates, known, k)
    by_key = spans.groupBy("key").agg(F.collect_set("label").alias("own"), F.max("likeness").alias("likeness"))  # labels are few
    base = F.array_compact(F.array(*[F.when(F.size(F.get("found", i)) > 0, F.lit(label)) for i, label in enumerate(phrases.values())]))
    places = F.flatten("found")
    out = scanned.drop("words", "hit").join(by_key, "key", "left").withColumn("base", base).withColumn("places", places)
    union = F.array_union("base", F.coalesce("own", F.array().cast("array<string>")))
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").cast("bigint").alias("first_word"),
        F.array_max("places").cast("bigint").alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.sort_array(union), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("likeness", F.lit(0.0))).alias("score"),
    )


def oracle_sql(k: int = 3, gap: int = 3, least_votes: float = 0.4, least_likeness: float = 0.75) -> str:
    """The same scan of ``documents`` in DuckDB SQL, by single words instead of arrays."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    words = lambda c: f"list_filter(regexp_split_to_array(translate({c}, '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda x: x <> '')"
    templates = ", ".join(f"({t}, {quoted(label)}, {quoted(text)})" for t, (label, text) in enumerate(TEMPLATES))
    then = lambda order: [f"lead(word, {j}) OVER ({order})" for j in range(1, k)]
    rolled = lambda order: " || ' ' || ".join(["word", *then(order)])
    bases = " ".join("WHEN " + " AND ".join([f"{w} = {quoted(x)}" for w, x in zip(("word", *(f"w{j}" for j in range(1, 9))), phrase.split(), strict=False)]) + f" THEN {quoted(label)}" for phrase, label in BASE_PHRASES.items())
    reach = "(SELECT min(len(tw)) - 1 FROM tpl)"
    return f"""
        WITH docs AS (SELECT doc_id, row_number() OVER () AS rid, {words("coalesce(text, '')")} AS words FROM documents),
        tok AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM docs),
        rolled AS (SELECT rid, pos, word, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2, {rolled("PARTITION BY rid ORDER BY pos")} AS g FROM tok WINDOW o AS (PARTITION BY rid ORDER BY pos)),
        base AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS own
            FROM (SELECT rid, pos, CASE {bases} END AS label FROM rolled) WHERE label IS NOT NULL GROUP BY rid),
        tpl AS (SELECT t, label, {words("body")} AS tw FROM (VALUES {templates}) v(t, label, body)),
        tgram AS (SELECT t, place, g FROM (SELECT t, place, {rolled("PARTITION BY t ORDER BY place")} AS g FROM (SELECT t, unnest(tw) AS word, generate_subscripts(tw, 1) - 1 AS place FROM tpl)) WHERE g IS NOT NULL),
        size AS (SELECT t, count(*) AS n FROM tgram GROUP BY t),
        votes AS (SELECT rid, t, pos - place AS d, count(*) AS v FROM rolled JOIN tgram USING (g) GROUP BY ALL),
        near AS (SELECT rid, t, d, sum(v) OVER f AS v, list(d) OVER f AS ends FROM votes WINDOW f AS (PARTITION BY rid, t ORDER BY d RANGE BETWEEN {gap} PRECEDING AND {gap} FOLLOWING)),
        win AS (SELECT rid, t, label, tw, d, greatest(d, 0) AS s, unnest(ends) AS e FROM near JOIN tpl USING (t) JOIN size USING (t) WHERE v >= greatest(1, ceil(n * {least_votes}))),
        cut AS (SELECT rid, t, label, d, s, least(e + len(tw), len(words)) - s AS n, array_to_string(words[s + 1 : least(e + len(tw), len(words))], ' ') AS a, array_to_string(tw, ' ') AS b FROM win JOIN docs USING (rid)),
        scored AS (SELECT rid, t, label, d, s, n, 1 - levenshtein(a, b) / greatest(length(a), length(b))::double AS likeness FROM cut WHERE n > 0),
        best AS (SELECT * FROM scored WHERE likeness >= {least_likeness} QUALIFY row_number() OVER (PARTITION BY rid, t, label, d ORDER BY likeness DESC, n, s) = 1),
        top AS (SELECT *, max(row(likeness, -n, -s)) OVER (PARTITION BY rid, t ORDER BY d RANGE BETWEEN {gap} PRECEDING AND {gap} FOLLOWING) AS top FROM best),
        spans AS (SELECT rid, label, s, likeness FROM top WHERE top = row(likeness, -n, -s)),
        likest AS (SELECT *, max(likeness) OVER (PARTITION BY rid ORDER BY s RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS m FROM spans),
        found AS (SELECT rid, list(DISTINCT label) AS more, max(likeness) AS likeness FROM likest WHERE likeness = m GROUP BY rid)
        SELECT doc_id, cast(len(words) AS bigint) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(own, [])), ',') AS base_labels,
            array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::double ELSE coalesce(likeness, 0.0::double) END AS score
        FROM docs LEFT JOIN base USING (rid) LEFT JOIN found USING (rid)"""
