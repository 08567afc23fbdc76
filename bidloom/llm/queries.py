"""The queries of this subpackage: one for each operator, by the operator's own functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fim, html_text, licenses, online_packing, packing, phrases, simhash, spotsigs, token_ids, toxicity, url_filter
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), token_ids.vocabulary_path("word_bpe_49k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model)


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spotsigs.fingerprint_documents(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        spotsigs.fingerprint_string(F.col("signatures")).alias("fingerprint"),
        spotsigs.fingerprint_string(F.col("edited_signatures")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        spotsigs.likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )


# The rules, and the block list: sites, and the hosts and domains under which each is listed.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "malware-host", "phish-mail", "spam-farm")
LISTED_HOSTS = tuple(f"{sub}{site}.example.{top}" for site in LISTED_SITES for sub in ("", "www.", "m.", "blog.") for top in ("com", "net", "org"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(host,) for host in LISTED_HOSTS], "key string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, listed)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), token_ids.vocabulary_path("byte_bpe_50k.json"), 2048, 0)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.token_id_round_trip(table(spark, sf_dir, "documents"), token_ids.vocabulary_path("byte_bpe_50k.json"), 2)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("bigint").alias("prefix_chars"),
        F.length("middle").cast("bigint").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return online_packing.pack_online(table(spark, sf_dir, "documents"), token_ids.vocabulary_path("byte_bpe_50k.json"), 2048, 1)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_spotsigs": op3_spotsigs,
    "op4_url_filter": op4_url_filter,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_simhash": op6_simhash,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_licenses": op8_licenses,
    "op9_token_ids": op9_token_ids,
    "op10_html_text": op10_html_text,
    "op11_phrases": op11_phrases,
    "op12_fim": op12_fim,
    "op13_online_packing": op13_online_packing,
}

ORACLE_SQL = {
    "op4_url_filter": f"""
        WITH cut AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut
        ), ruled AS (
            SELECT *, CASE
                WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
            FROM parts
        )
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN host IN ({", ".join(map(repr, LISTED_HOSTS))}) THEN 'block'
            ELSE 'allow' END AS verdict
        FROM ruled""",
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op8_licenses": licenses.oracle_sql(),
    "op11_phrases": phrases.oracle_sql(),
    "op12_fim": """
        WITH drawn AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
        ), numbers AS (
            SELECT doc_id, text, length(text) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
            FROM drawn
        ), formed AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM numbers
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || text[1:p] || '<S>' || text[q + 1:] || '<M>' || text[p + 1:q]
                      ELSE '<S>' || text[q + 1:] || '<P>' || text[1:p] || '<M>' || text[p + 1:q] END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM formed""",
}
