"""The procurement queries: every operator over the star-schema adapters, each with its SQL where SQL has it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CATEGORIES, ScoreConfig, SearchCriteria, StopConditions, Variable
from ..functions import handlers as H
from ..functions import numbers as N
from ..functions import text as T
from ..operators import alerts, codes, extract, filters, identity, jobs, metrics, paging, ranking, reads, scoring, store, trigrams
from ..sources import adapters as A
from ..sources import list_urls, pages, writers
from ..sources.committed import ChangeSet, CommittedTable
from ..sources.shared import shared_folder
from ..streaming import jobs as streams
from ..streaming import queue as queues

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# --- SQL pieces ------------------------------------------------------------------------------------------------------

NOW = f"TIMESTAMP '{A.NOW}'"
_CODES = " ".join(f"WHEN {i} THEN {'NULL' if c is None else repr(c)}" for i, c in enumerate(A.CODES))
PROC = f"""proc AS (
    SELECT o_orderkey AS id, cast(o_orderkey AS varchar) AS number,
           CASE WHEN o_orderkey % 2 = 0 THEN 'portal_a' ELSE 'portal_b' END AS source_platform,
           'https://portal.example/card/' || o_orderkey || '/common.html?id=' || o_orderkey AS url, o_custkey AS customer_id,
           CASE left(o_orderpriority, 1) WHEN '1' THEN '44-ФЗ' WHEN '2' THEN '44-ФЗ' WHEN '3' THEN '223-ФЗ' WHEN '4' THEN '223-ФЗ' END AS law,
           'Закупка ' || o_orderpriority AS subject, o_totalprice AS nmck, o_orderdate AS publication_date,
           o_orderdate + to_days(cast(o_orderkey % 3 AS int)) AS update_date,
           o_orderdate + to_days(cast(o_orderkey % 40 AS int)) + INTERVAL 15 HOUR AS deadline,
           CASE o_orderkey % 8 {_CODES} END AS okpd2_codes
    FROM orders)"""
CUST = """cust AS (
    SELECT c_custkey AS id, c_name AS name, lower(trim(regexp_replace(c_name, '\\s+', ' ', 'g'))) AS normalized_name,
           CASE WHEN c_custkey % 2 = 0 THEN lpad(cast(c_custkey AS varchar), 10, '7') END AS inn, c_acctbal AS rating
    FROM customer)"""
FIT = """CASE WHEN starts_with(d, '6201') THEN 0.9 WHEN starts_with(d, '6202') THEN 0.8 WHEN starts_with(d, '6209') THEN 0.7
         WHEN starts_with(d, '6311') THEN 0.6 ELSE 0.5 END::double"""
SCORED = f"""{PROC}, digit AS (
    SELECT *, regexp_replace(trim(split_part(coalesce(okpd2_codes, ''), ',', 1)), '[^0-9]', '', 'g') AS d FROM proc
), fitted AS (SELECT *, {FIT} AS fit FROM digit), scored AS (
    SELECT *, CASE WHEN deadline < {NOW} THEN 0.0::double ELSE cast(printf('%.2f', fit * 1.0::double * coalesce(nmck, 0)) AS double) END AS score,
           CASE WHEN deadline < {NOW} THEN 'deadline_expired' ELSE 'default' END AS score_method FROM fitted)"""
LABELLED = f"""sim AS (
    SELECT cast(p_partkey AS varchar) AS number, [{", ".join(map(repr, CATEGORIES))}][cast(p_partkey % 5 AS int) + 1] AS category, p_retailprice AS nmck FROM part
), given AS (SELECT cast(p_partkey AS varchar) AS number, p_retailprice AS score FROM part WHERE p_partkey % 7 <> 0)"""
PAIRS = "pairs AS (SELECT o_orderkey AS item_id, least(10.0::double, o_totalprice / 50000) AS expected, cast((o_orderkey % 101) / 10.0 AS double) AS predicted FROM orders)"


def r2(x: str, digits: int = 2) -> str:
    return f"cast(printf('%.{digits}f', {x}) AS double)"


def stamp(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def sql_stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- Scores ----------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {SCORED}, {CUST}, top AS (
        SELECT * FROM scored WHERE NOT coalesce(deadline < {NOW}, false)
          AND NOT coalesce((epoch_us(deadline) - epoch_us({NOW})) / 86400000000.0 < 2, false) ORDER BY score DESC, id LIMIT 20)
    SELECT row_number() OVER (ORDER BY score DESC, top.id) AS rank, top.id, number, cust.name AS customer, fit, score, score_method
    FROM top LEFT JOIN cust ON customer_id = cust.id"""
)
def default_score(spark: SparkSession, d: str) -> DataFrame:
    cards = filters.stop_conditions(A.cards(spark, d), A.now(), StopConditions(min_deadline_days=2))
    scored = scoring.default_scores(cards, A.now(), ScoreConfig())
    top = scored.orderBy(F.desc("score"), "id").limit(20)
    named = filters.with_customer_name(top, A.customers(spark, d))
    return ranking.top_ranks(named, [F.desc("score"), F.asc("id")]).select("rank", "id", "number", "customer", "fit", "score", "score_method")


@query(f"WITH {SCORED} SELECT id, fit, score, score_method FROM scored")
def score_all(spark: SparkSession, d: str) -> DataFrame:
    return scoring.default_scores(A.cards(spark, d), A.now(), ScoreConfig()).select("id", "fit", "score", "score_method")


@query(f"WITH {SCORED} SELECT id, CASE WHEN d = '' OR NOT (starts_with(d, '6201') OR starts_with(d, '6202') OR starts_with(d, '6209') OR starts_with(d, '6311')) THEN NULL ELSE fit END AS fit FROM scored")
def longest_prefix_fit(spark: SparkSession, d: str) -> DataFrame:
    table = spark.createDataFrame(list(ScoreConfig().fit_table.items()), "code string, fit_value double")
    return codes.longest_prefix(A.cards(spark, d), T.first_code("okpd2_codes"), table, "code", "fit_value", "fit").select("id", "fit")


@query(f"""WITH {PAIRS} SELECT id, {r2(r2("greatest(0.0::double, least(10.0::double, predicted))") + " / 10.0::double * 1.0::double * " + r2("coalesce(nmck, 0.0) * 1.0::double"))} AS score
    FROM (SELECT item_id AS id, predicted, o_totalprice AS nmck FROM pairs JOIN orders ON item_id = o_orderkey)""")
def external_score(spark: SparkSession, d: str) -> DataFrame:
    rows = A.cards(spark, d).select("id", "nmck").join(A.score_pairs(spark, d).select(F.col("item_id").alias("id"), "predicted"), "id")
    return rows.select("id", scoring.external_score("predicted", "nmck", ScoreConfig()).alias("score"))


@query(f"""WITH {SCORED} SELECT id, {r2("score")} AS score, {r2("greatest(0.0::double, least(10.0::double, score))")} AS final_fit_score, 1.0::double AS p_win, {r2("coalesce(nmck, 0.0)")} AS margin FROM scored""")
def stub_score(spark: SparkSession, d: str) -> DataFrame:
    scored = scoring.default_scores(A.cards(spark, d), A.now(), ScoreConfig())
    return scoring.stub_scores(scored, ScoreConfig()).select("id", "score", "final_fit_score", "p_win", "margin")


@query(f"WITH {PAIRS} SELECT item_id, {r2('greatest(0.0::double, least(10.0::double, predicted * 1.3 - 1))')} AS fit FROM pairs")
def clamp_fit(spark: SparkSession, d: str) -> DataFrame:
    return A.score_pairs(spark, d).select("item_id", scoring.clamp_fit(F.col("predicted") * 1.3 - 1).alias("fit"))


@query(
    f"""WITH {PROC} SELECT id, subject || CASE WHEN id % 2 = 0 THEN chr(10) || 'customer: Заказчик ' || customer_id || chr(10) || 'nmck: ' || (nmck * 100)::double::varchar ELSE '' END
        || CASE WHEN id % 2 = 1 THEN chr(10) || 'nmck: ' || nmck::double::varchar ELSE '' END || CASE WHEN law IS NOT NULL THEN chr(10) || 'law: ' || law ELSE '' END AS description FROM proc"""
)
def description(spark: SparkSession, d: str) -> DataFrame:
    who = F.concat(F.lit("  Заказчик \t"), F.col("customer_id").cast("string"))
    cards = A.cards(spark, d).withColumn("detail_json", F.when(F.col("id") % 2 == 0, F.to_json(F.struct(who.alias("customer"), F.col("subject"), (F.col("nmck") * 100).alias("nmck")))))
    return cards.select("id", scoring.description("detail_json", "law", "nmck").alias("description"))


@query(f"""WITH {PROC}, t AS (SELECT id, length(subject || CASE WHEN law IS NOT NULL THEN chr(10) || 'law: ' || law ELSE '' END || chr(10) || 'nmck: ' || nmck) % 11 AS n FROM proc)
    SELECT id AS procurement_id, cast(n + CASE WHEN n < 5 THEN 1 ELSE 0 END AS double) AS fit_score, CASE WHEN n >= 4 THEN 'accept' ELSE 'reject' END AS verdict, 'too low' AS critics,
    cast(n + CASE WHEN n < 5 THEN 1 ELSE 0 END AS double) AS final_fit_score, CASE WHEN n >= 5 THEN 0 WHEN n = 4 THEN 1 ELSE 2 END AS rounds FROM t""")
def model_score(spark: SparkSession, d: str) -> DataFrame:
    """The pluggable scorer with a deterministic stand-in: short subjects are rejected once and fitted again."""
    cards = A.cards(spark, d).select(F.col("id").alias("procurement_id"), scoring.description(None, "law", "nmck").alias("description"))
    fit = lambda texts, hints: [len(t) % 11 + (1.0 if h else 0.0) for t, h in zip(texts, hints, strict=True)]
    return scoring.model_scores(cards, fit, lambda texts, fits: [("accept" if f >= 5 else "reject", "too low", f) for f in fits], 2)


# --- Handlers --------------------------------------------------------------------------------------------------------

_MONEY = "translate(format('{:,.2f}', nmck), ',.', chr(160) || ',')"


@query(f"WITH {PROC} SELECT id, {_MONEY} || ' ₽' AS price, cast(printf('%.2f', nmck) AS double) AS amount, cast(NULL AS bigint) AS whole FROM proc")
def handlers_money(spark: SparkSession, d: str) -> DataFrame:
    return A.raw_cards(spark, d).select("id", "price", H.money("price").alias("amount"), H.integer("price").alias("whole"))


@query(f"""WITH {PROC} SELECT id, 'с ' || strftime(publication_date, '%d.%m.%Y') || ' до ' || strftime(deadline, '%d.%m.%Y %H:%M') || ' (МСК)' AS dates,
    {sql_stamp("date_trunc('day', publication_date) - INTERVAL 3 HOUR")} AS published, {sql_stamp("date_trunc('minute', deadline) - INTERVAL 3 HOUR")} AS until,
    strftime(publication_date, '%Y-%m-%dT00:00:00') AS iso FROM proc""")
def handlers_dates(spark: SparkSession, d: str) -> DataFrame:
    day = F.regexp_extract("dates", r"(\d\d\.\d\d\.\d{4})", 1)
    return A.raw_cards(spark, d).select("id", "dates", stamp(H.pub_date("dates")).alias("published"), stamp(H.deadline("dates")).alias("until"), H.date_iso(day).alias("iso"))


@query(f"WITH {PROC} SELECT id, law, law AS law_by_regex FROM proc")
def handlers_law(spark: SparkSession, d: str) -> DataFrame:
    return A.raw_cards(spark, d).select("id", H.apply_handler("law", "law_block").alias("law"), H.apply_handler("regex", "law_block", r"(\d+-ФЗ)").alias("law_by_regex"))


@query(f"""WITH {PROC} SELECT id, CASE id % 3 WHEN 0 THEN cast(id % 30 AS double) WHEN 1 THEN cast(printf('%.2f', nmck) AS double) END AS security,
    CASE id % 3 WHEN 0 THEN '%' WHEN 1 THEN 'руб.' END AS unit FROM proc""")
def handlers_security(spark: SparkSession, d: str) -> DataFrame:
    return A.raw_cards(spark, d).select("id", H.security("security").alias("security"), H.security_unit("security").alias("unit"))


@query("""SELECT o_orderkey AS id, trim(o_orderpriority) AS stripped, lower(trim(o_orderpriority)) AS lowered, cast(left(o_orderpriority, 1) AS double) AS parsed,
    regexp_replace(o_orderpriority, '[^0-9]', '', 'g') AS digits FROM orders""")
def handlers_text(spark: SparkSession, d: str) -> DataFrame:
    padded = F.concat(F.lit("  " + N.NBSP), "o_orderpriority", F.lit("\t "))
    return A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.strip(padded).alias("stripped"), H.apply_handler("lower", padded).alias("lowered"), H.number(F.left("o_orderpriority", F.lit(1))).alias("parsed"), T.digits("o_orderpriority").alias("digits"))


# --- Customers -------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, lower(c_name) || ' ооо' AS normalized_name FROM customer")
def normalize_customers(spark: SparkSession, d: str) -> DataFrame:
    spelled = F.concat(F.lit(" \t"), F.upper("c_name"), F.lit(N.NBSP + " \n ООО  "))
    return A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.normalize_name(spelled).alias("normalized_name"))


@query("""WITH named AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN upper(c_name) ELSE '  ' || c_name END AS customer, lower(c_name) AS n FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT n AS normalized_name, arg_min(customer, id) AS name, min(id) AS first_id, count(*) AS links FROM named GROUP BY n""")
def dedupe_customers(spark: SparkSession, d: str) -> DataFrame:
    orders = A.table(spark, d, "orders").join(A.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    legacy = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.upper("c_name")).otherwise(F.concat(F.lit("  "), "c_name")).alias("customer"))
    customers, links = identity.backfill_customers(legacy)
    return customers.join(links.groupBy("normalized_name").agg(F.count("*").alias("links")), "normalized_name")


@query("SELECT c_name AS name, row_number() OVER (ORDER BY min(o_orderkey)) + 900000 AS surrogate_id FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name")
def new_customer_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "orders").join(A.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("name"), "o_orderkey")
    return identity.surrogate_ids(rows, "name", "o_orderkey", 900_001)


@query(f"""WITH {CUST}, known AS (SELECT * FROM cust WHERE id % 3 <> 0), rec AS (SELECT o_orderkey AS id, c_custkey AS c, lower(c_name) AS n FROM orders JOIN customer ON o_custkey = c_custkey),
    first AS (SELECT n, min(id) AS first_id FROM rec GROUP BY n)
    SELECT rec.id AS record_id, coalesce(known.id, -1 - first_id) AS customer_id FROM rec JOIN first USING (n) LEFT JOIN known ON known.id = rec.c""")
def resolve_customers(spark: SparkSession, d: str) -> DataFrame:
    known = A.customers(spark, d).where("id % 3 <> 0")
    rows = A.table(spark, d, "orders").join(A.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    records = rows.select(F.col("o_orderkey").alias("id"), F.concat(F.upper("c_name"), F.lit(" ")).alias("customer"), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("9"), F.lpad(F.col("c_custkey").cast("string"), 11, "0"))).alias("inn"))
    return identity.resolve_customers(records, known).select("record_id", "customer_id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN lpad(cast(c_custkey AS varchar), 10, '7') WHEN c_custkey % 3 = 0 THEN lpad(cast(c_custkey AS varchar), 12, '5') END AS inn FROM customer")
def resolve_inn(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    rows = A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("/org?inn="), F.lpad(k, 10, "7"))).otherwise("/org").alias("link"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Организация. ИНН / КПП: "), F.lpad(k, 12, "5"))).otherwise("Организация").alias("page"))
    return store.look_up_once(rows, "link", lambda keys: keys).select("id", T.resolve_inn("link", r"inn=(\d{10,12})", "page").alias("inn"))


# --- Searches --------------------------------------------------------------------------------------------------------


@query(f"""WITH {PROC}, hit AS (SELECT * FROM proc WHERE number ILIKE '%7%' AND source_platform = 'portal_b' AND okpd2_codes ILIKE '%62.0%'),
    paged AS (SELECT * FROM hit ORDER BY id DESC LIMIT 20 OFFSET 5)
    SELECT row_number() OVER (ORDER BY id DESC) + 5 AS rank, id, number, okpd2_codes, (SELECT count(*) FROM hit) AS total FROM paged""")
def search_cards(spark: SparkSession, d: str) -> DataFrame:
    hit = filters.search_cards(A.cards(spark, d), A.customers(spark, d), number="7", source_platform="portal_b", okpd2="62.0")
    total = hit.agg(F.count("*").alias("total"))
    return filters.page(hit, 20, 5).join(F.broadcast(total), F.lit(True)).select("rank", "id", "number", "okpd2_codes", "total")  # one row


@query(f"WITH {PROC}, {CUST} SELECT proc.id, number, cust.name AS customer FROM proc JOIN cust ON customer_id = cust.id WHERE cust.name ILIKE '%#00000001%'")
def search_cards_by_customer(spark: SparkSession, d: str) -> DataFrame:
    c = A.customers(spark, d)
    return filters.with_customer_name(filters.search_cards(A.cards(spark, d), c, customer="#00000001"), c).select("id", "number", "customer")


@query(f"WITH {CUST}, paged AS (SELECT * FROM cust WHERE name ILIKE '%1%' ORDER BY id LIMIT 50 OFFSET 10) SELECT row_number() OVER (ORDER BY id) + 10 AS rank, id, name, inn FROM paged")
def list_customers(spark: SparkSession, d: str) -> DataFrame:
    return filters.page(filters.search_customers(A.customers(spark, d), name="1"), 50, 10, descending=False).select("rank", "id", "name", "inn")


@query(f"WITH {CUST} SELECT id, name, inn FROM cust WHERE inn = '7777777778'")
def customer_by_inn(spark: SparkSession, d: str) -> DataFrame:
    return filters.search_customers(A.customers(spark, d), inn="7777777778").select("id", "name", "inn")


@query(f"WITH {PROC} SELECT source_platform, count(*) AS total, greatest(1, cast(ceil(count(*) / 50.0) AS bigint)) AS pages FROM proc GROUP BY source_platform")
def page_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.cards(spark, d).groupBy("source_platform").agg(F.count("*").alias("total")).select("source_platform", "total", filters.page_count(F.col("total"), 50).alias("pages"))


@query(f"""WITH {PROC} SELECT id FROM proc WHERE law IN ('44-ФЗ') AND nmck >= 50000 AND nmck <= 250000 AND cast(deadline AS date) >= cast({NOW} AS date)
    AND len(list_filter(string_split(coalesce(okpd2_codes, ''), ','), lambda c: starts_with(regexp_replace(c, '[^0-9]', '', 'g'), '62') OR starts_with(regexp_replace(c, '[^0-9]', '', 'g'), '6311'))) > 0""")
def build_predicates(spark: SparkSession, d: str) -> DataFrame:
    wanted = SearchCriteria(okpd_codes=("62", "63.11"), fz44=True, nmck_min=50_000.0, nmck_max=250_000.0)
    return filters.by_criteria(A.cards(spark, d), wanted, now=A.now()).select("id")


# --- Cutoffs ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {PROC}, p AS (SELECT unnest(['portal_a', 'portal_b', 'portal_c']) AS source_platform)
    SELECT source_platform, {sql_stamp(f"coalesce(max(update_date), {NOW} - INTERVAL 7 DAY)")} AS watermark FROM p LEFT JOIN proc USING (source_platform) GROUP BY source_platform""")
def watermark(spark: SparkSession, d: str) -> DataFrame:
    platforms = spark.createDataFrame([("portal_a",), ("portal_b",), ("portal_c",)], "source_platform string")
    return store.watermarks(A.cards(spark, d), platforms, A.now(), 7).select("source_platform", stamp("watermark").alias("watermark"))


@query(f"WITH {PROC} SELECT id, cast(publication_date AS date) < cast({NOW} AS date) AS older FROM proc")
def cutoff_filter(spark: SparkSession, d: str) -> DataFrame:
    return A.cards(spark, d).select("id", filters.older_than_cutoff(F.col("publication_date"), A.now()).alias("older"))


@query(f"""WITH {PROC}, o AS (SELECT *, cast(publication_date AS date) < DATE '1995-02-01' AS older FROM proc)
    SELECT id FROM o WHERE id < coalesce((SELECT min(id) FROM o WHERE older), 9223372036854775807)""")
def take_while_cutoff(spark: SparkSession, d: str) -> DataFrame:
    older = filters.older_than_cutoff(F.col("publication_date"), F.lit("1995-02-01").cast("date"))
    return filters.take_while_newer(A.cards(spark, d), older, ["id"]).select("id")


@query(f"""WITH {PROC} SELECT id, {sql_stamp("deadline")} AS deadline FROM proc WHERE NOT coalesce(deadline < {NOW}, false)
    AND NOT coalesce((epoch_us(deadline) - epoch_us({NOW})) / 86400000000.0 < 3.5, false)""")
def stop_conditions(spark: SparkSession, d: str) -> DataFrame:
    return filters.stop_conditions(A.cards(spark, d), A.now(), StopConditions(min_deadline_days=3.5)).select("id", stamp("deadline").alias("deadline"))


# --- Store -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {PROC}, inc AS (SELECT * FROM proc WHERE id % 3 <> 0 UNION ALL SELECT * REPLACE (id + 1000000000 AS id) FROM proc WHERE id % 5 = 0)
    SELECT id, number, source_platform, false AS inserted FROM proc WHERE id % 2 = 0
    UNION ALL SELECT min(id), number, source_platform, true FROM inc WHERE number NOT IN (SELECT number FROM proc WHERE id % 2 = 0) GROUP BY number, source_platform""")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    cards = A.cards(spark, d)
    incoming = cards.where("id % 3 <> 0").unionByName(cards.where("id % 5 = 0").withColumn("id", F.col("id") + 1_000_000_000))
    return store.insert_if_absent(cards.where("id % 2 = 0"), incoming).select("id", "number", "source_platform", "inserted")


@query(f"""WITH {SCORED}, res AS (SELECT user_id AS pid, arg_max(value, event_id) AS s FROM events GROUP BY user_id)
    SELECT id, CASE WHEN s IS NULL THEN score ELSE {r2("s")} END AS score, CASE WHEN s IS NULL THEN score_method ELSE 'external' END AS score_method FROM scored LEFT JOIN res ON pid = id""")
def update_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = scoring.default_scores(A.cards(spark, d), A.now(), ScoreConfig()).select("id", "score", "score_method")
    results = A.jobs(spark, d).select("procurement_id", F.col("priority").alias("score"), F.lit("external").alias("score_method"), F.col("event_id").alias("seq"))
    return store.update_scores(scored, results)


@query(f"WITH {PROC} SELECT id, CASE WHEN id % 4 = 0 THEN 'тз-' || number ELSE 'old' END AS technical_spec_name, CASE WHEN id % 6 = 0 THEN url END AS technical_spec_url FROM proc")
def update_spec(spark: SparkSession, d: str) -> DataFrame:
    cards = A.cards(spark, d)
    rows = cards.select("id", F.lit("old").alias("technical_spec_name"), F.lit(None).cast("string").alias("technical_spec_url"))
    changes = cards.select("id", F.when(F.col("id") % 4 == 0, F.concat(F.lit("тз-"), "number")).alias("technical_spec_name"), F.when(F.col("id") % 6 == 0, F.col("url")).alias("technical_spec_url"))
    return store.update_given(rows, changes, ["technical_spec_name", "technical_spec_url"])


@query(f"WITH {CUST} SELECT id, CASE WHEN id % 10 = 0 THEN 4.5::double ELSE rating END AS rating FROM cust")
def set_ratings(spark: SparkSession, d: str) -> DataFrame:
    c = A.customers(spark, d)
    return store.set_values(c, c.where("id % 10 = 0").select("id", F.lit(4.5).alias("rating")), "rating")[0].select("id", "rating")


@query("SELECT 'procurements' AS table_name, count(*) AS deleted FROM orders UNION ALL SELECT 'customers', count(*) FROM customer")
def clear_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.clear(procurements=A.cards(spark, d), customers=A.customers(spark, d))[1]


@query(f"WITH {PROC} SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE law END AS law, CASE WHEN id % 4 = 0 THEN 'R' || (id % 7) ELSE subject END AS subject FROM proc")
def merge_pages(spark: SparkSession, d: str) -> DataFrame:
    cards = A.cards(spark, d).select("id", "law", "subject")
    detail = cards.where("id % 3 = 0").select("id", F.lit(None).cast("string").alias("law"))
    extra = cards.select("id", F.when(F.col("id") % 4 == 0, F.concat(F.lit("R"), (F.col("id") % 7).cast("string"))).alias("subject"))
    return store.merge_extra(store.merge_details(cards, detail, "id"), extra, "id")


# --- Codes -----------------------------------------------------------------------------------------------------------

# A small code tree.
TREE = (("62", ".1.", "Разработка ПО"), ("62.02.1", ".1.21.", "Консультации"), ("62.02.2", ".1.22.", ""), ("62.02.3", ".1.23.", "Сопровождение"), ("63.11", ".2.11.", "Обработка данных"), ("26.2", ".3.", "Компьютеры"))
_TREE_SQL = "tree AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{p}', '{n}', '{c.replace('.', '')}')" for c, p, n in TREE) + ") t(code, path, name, k))"


def _tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TREE), "code string, path string, name string")


_ASKED = f"""{PROC}, asked AS (SELECT id, unnest(string_split(okpd2_codes, ',')) AS code, generate_subscripts(string_split(okpd2_codes, ','), 1) AS pos FROM proc),
    q AS (SELECT id, pos, code, regexp_replace(code, '[^0-9]', '', 'g') AS d FROM asked)"""


@query(f"""WITH {_ASKED}, {_TREE_SQL},
    tiers AS (SELECT DISTINCT q.id, pos, d, CASE WHEN k = d THEN 1 WHEN length(k) > length(d) THEN 2 ELSE 3 END AS tier, code2, path, k FROM q
        JOIN (SELECT code AS code2, path, k FROM tree) ON d <> '' AND (starts_with(k, d) OR starts_with(d, k))),
    best AS (SELECT *, min(tier) OVER (PARTITION BY id, pos) AS bt, max(CASE WHEN tier = 3 THEN length(k) END) OVER (PARTITION BY id, pos) AS bl FROM tiers),
    kept AS (SELECT id, path, min(pos * 1000 + nth) AS o FROM (SELECT *, row_number() OVER (PARTITION BY id, pos ORDER BY code2, path) AS nth FROM best WHERE tier = bt AND (tier < 3 OR length(k) = bl)) GROUP BY id, path)
    SELECT proc.id, coalesce(string_agg(path, ' ' ORDER BY o), '') AS paths FROM proc LEFT JOIN kept USING (id) GROUP BY proc.id""")
def resolve_codes(spark: SparkSession, d: str) -> DataFrame:
    asked = A.cards(spark, d).select("id", F.split("okpd2_codes", ",").alias("codes"))
    return codes.resolve_codes(asked, _tree(spark), "id").select("id", F.array_join("paths", " ").alias("paths"))


@query(f"""WITH {_ASKED}, {_TREE_SQL},
    node AS (SELECT q.id, pos, coalesce((SELECT path FROM tree WHERE code = q.code), (SELECT arg_max(path, length(k)) FROM tree WHERE starts_with(q.d, k))) AS n FROM q),
    kept AS (SELECT id, n, min(pos) AS o FROM node WHERE n IS NOT NULL GROUP BY id, n)
    SELECT proc.id, string_agg(n, ',' ORDER BY o) AS ids FROM proc LEFT JOIN kept USING (id) GROUP BY proc.id""")
def resolve_code_ids(spark: SparkSession, d: str) -> DataFrame:
    asked = A.cards(spark, d).select("id", F.split("okpd2_codes", ",").alias("codes"))
    return codes.resolve_code_ids(asked, _tree(spark), "id", node_id="path")


@query(f"WITH {PROC}, {_TREE_SQL} SELECT id, okpd2_codes AS code, coalesce(nullif(tree.name, ''), okpd2_codes) AS name FROM proc LEFT JOIN tree ON code = okpd2_codes")
def code_names(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark)
    return codes.code_names(A.cards(spark, d).select("id", F.col("okpd2_codes").alias("code")), t.select("code", "path"), t.select("path", "name")).select("id", "code", "name")


# --- Files and pages -------------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT l_orderkey AS id, CASE WHEN l_linenumber % 3 = 0 THEN 'Техническое Задание ' ELSE 'Файл ' END || l_partkey AS name, 'https://f/' || l_partkey AS url FROM lineitem),
    g AS (SELECT id, min(name) FILTER (WHERE name LIKE 'Техн%') AS technical_spec_name, string_agg(url, ' ' ORDER BY name, url) FILTER (WHERE name NOT LIKE 'Техн%') AS other_files FROM f GROUP BY id)
    SELECT id, technical_spec_name, replace(technical_spec_name, 'Техническое Задание ', 'https://f/') AS technical_spec_url, other_files FROM g""")
def split_files(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.when(F.col("l_linenumber") % 3 == 0, "Техническое Задание ").otherwise("Файл "), F.col("l_partkey").cast("string"))
    files = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct(name.alias("name"), F.concat(F.lit("https://f/"), F.col("l_partkey").cast("string")).alias("url")))).alias("files"))
    return filters.split_files(files).select("id", "technical_spec_name", "technical_spec_url", F.array_join(F.transform("files_json", lambda f: f["url"]), " ").alias("other_files"))


@query(f"""WITH {PROC} SELECT id, 'https://portal.example/card/' || id || '/documents.html?id=' || id AS files_page,
    CASE WHEN id % 2 = 0 THEN url ELSE 'https://portal.example/' || number END AS absolute FROM proc""")
def files_page_url(spark: SparkSession, d: str) -> DataFrame:
    href = F.when(F.col("id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("/"), "number"))
    return A.cards(spark, d).select("id", T.files_page_url("url", "documents.html").alias("files_page"), T.absolute_url(href, F.lit("https://portal.example/")).alias("absolute"))


@query(f"WITH {PROC} SELECT id, url_encode(url || ' ' || subject || '*~+') AS encoded FROM proc")
def url_encode(spark: SparkSession, d: str) -> DataFrame:
    return A.cards(spark, d).select("id", T.percent_encode(F.concat_ws(" ", "url", F.concat("subject", F.lit("*~+")))).alias("encoded"))


def _unescaped(text: str) -> str:
    """SQL of a page's text without its tags and references."""
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    for entity, letter in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#x27", "''"), ("#39", "''"), ("amp", "&")):
        text = f"regexp_replace({text}, '&{entity};?', '{letter}', 'g')"
    return f"trim({text})"


_PLAIN = _unescaped("regexp_extract(html, '<{0}>([^<]*)</{0}>', 1)")


@query(f"""SELECT page_id, {_PLAIN.format("title")} AS title, {_PLAIN.format("h1")} AS heading,
    cast(regexp_extract(url, '/([0-9]+)', 1) AS double) AS number, 'none' AS missing FROM pages""")
def page_extract(spark: SparkSession, d: str) -> DataFrame:
    variables = [Variable("title", "title", handler="strip"), Variable("heading", "article h1", handler="strip"), Variable("missing", "div.absent", default="none")]
    rows = extract.extract(A.table(spark, d, "pages"), variables)
    return rows.select("page_id", "title", "heading", H.number(T.first_group("url", r"/([0-9]+)")).alias("number"), "missing")


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS name,
    generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1) - 1 AS pos FROM pages) SELECT page_id, pos, href, name FROM l""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return extract.links(A.table(spark, d, "pages")).withColumn("pos", F.col("pos").cast("bigint"))


_ITEMS = "regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', {})"


@query(f"""WITH items AS (SELECT page_id, url, unnest({_ITEMS.format(1)}) AS href, unnest({_ITEMS.format(2)}) AS name, generate_subscripts({_ITEMS.format(1)}, 1) - 1 AS pos FROM pages)
    SELECT page_id, pos, {_unescaped("name")} AS name, {_unescaped("href")} AS href, CASE WHEN pos % 2 = 0 THEN {_unescaped("name")} ELSE 'even' END AS odd FROM items WHERE href <> ''""")
def page_containers(spark: SparkSession, d: str) -> DataFrame:
    """One record for each container of the pages, by the variable list; selectors may name what stands around it."""
    variables = [Variable("name", "xpath=./a", handler="strip"), Variable("href", "nav > ul a", attribute="href"), Variable("odd", "li:nth-child(odd) > a", handler="strip", default="even")]
    rows = filters.has_link(extract.extract(A.table(spark, d, "pages"), variables, container="nav li:has(> a)"), "href")
    return rows.select("page_id", F.col("pos").cast("bigint").alias("pos"), "name", "href", "odd")


_AD = "regexp_extract(html, '<div class=\"ad\">([^<]*)<', 1)"
_AFTER_HEADING = "regexp_extract(html, '</h1><p>(.*?)(?:</?p>|</article>)', 1, 's')"


@query(f"""WITH found AS (SELECT page_id, html, {_unescaped(_AFTER_HEADING)} AS lead, {_ITEMS.format(2)} AS names, {_ITEMS.format(1)} AS hrefs FROM pages)
    SELECT page_id, lead, {_unescaped("names[3]")} AS third, {_unescaped("names[-1]")} AS last,
        coalesce({_unescaped("names[list_position(names, 'the') + 1]")}, 'none') AS after_the,
        CASE WHEN contains(array_to_string(hrefs, ' '), 'th') THEN {_unescaped("names[2]")} END AS second_of_th,
        CASE WHEN contains(lower(lead), 'the') THEN {_PLAIN.format("h1")} END AS heading_of_the,
        CASE WHEN starts_with({_PLAIN.format("title")}, 'The') THEN 'main' END AS site FROM found""".replace("list_filter(hrefs, lambda x: contains(x, 'th'))", "regexp_extract_all(array_to_string(hrefs, ' '), 'th')").replace("THEN 'main' END", "THEN trim(regexp_extract(html, '<div class=\"ad\">([^<]*)<', 1)) END"))
def page_selectors(spark: SparkSession, d: str) -> DataFrame:
    """Child, sibling, position and text conditions, and paths, over whole pages."""
    variables = [
        Variable("lead", "article > h1 + p", handler="strip"),
        Variable("third", "nav li:nth-child(3) > a", handler="strip"),
        Variable("last", "xpath=//nav/ul/li[last()]/a", handler="strip"),
        Variable("after_the", "li:has(> a:text-is('the')) + li > a", handler="strip", default="none"),
        Variable("second_of_th", "xpath=//nav[.//a[contains(@href,'th')]]//li[2]/a", handler="strip"),
        Variable("heading_of_the", "h1:has(+ p:has-text('The'))", handler="strip"),
        Variable("site", "xpath=//html[head/title[starts-with(., 'The')]]/body/div[@class='ad']", handler="strip"),
    ]
    return extract.extract(A.table(spark, d, "pages"), variables).select("page_id", *(v.name for v in variables))


_CAPTURED = """captured AS (SELECT page_id, cast(page_id // 10 AS varchar) AS list, cast(page_id % 10 AS int) AS page_no, url, html, regexp_extract(url, '://[^/]*[.]([a-z]+)', 1) AS platform FROM pages)"""


def _captured(spark: SparkSession, d: str) -> str:
    """The pages as a source by platform: ten neighbours make a list."""
    list_key, page_no = F.floor(F.col("page_id") / 10).cast("string"), F.col("page_id") % 10
    rows = A.table(spark, d, "pages").select("page_id", list_key.alias("list"), page_no.alias("page_no"), "url", "html", F.regexp_extract("url", r"://[^/]*[.]([a-z]+)", 1).alias("platform"))
    path = f"{shared_folder(spark)}/bidloom/captured-{uuid.uuid4().hex}"
    pages.write_pages(rows, path)
    return path


@query(f"""WITH {_CAPTURED}, asked AS (SELECT * FROM captured WHERE platform IN ('com', 'org') AND page_no BETWEEN 1 AND 8), last AS (SELECT list, min(page_no) AS l FROM asked WHERE NOT contains(html, '<p><b>') GROUP BY list)
    SELECT page_id, platform, asked.list, page_no FROM asked LEFT JOIN last ON asked.list = last.list WHERE l IS NULL OR page_no <= l""")
def captured_lists(spark: SparkSession, d: str) -> DataFrame:
    """The pages of two platforms by number, each list up to the first one without a next page."""
    asked = pages.read_pages(spark, _captured(spark, d), ["com", "org"], page_from=1, page_to=8)
    return extract.until_last(asked, "list", "page_no", "article p > b").select("page_id", "platform", "list", "page_no")


@query(f"WITH {_CAPTURED} SELECT page_id, platform, list, page_no, length(html) AS chars FROM captured WHERE page_no < 5 AND platform = 'com'")
def captured_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same source as a stream, filtered."""
    path = _captured(spark, d)
    rows = pages.stream_pages(spark, path, platforms=["com"], page_to=4).select("page_id", "platform", "list", "page_no", F.length("html").cast("bigint").alias("chars"))
    rows.writeStream.option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).format("parquet").start(f"{path}-out").awaitTermination()
    return spark.read.parquet(f"{path}-out")


@query("SELECT page_id, CASE WHEN url LIKE 'http%://%' THEN url END AS safe_url, '&lt;' || url || '&gt;' AS escaped FROM (SELECT page_id, replace(url, '&', '&amp;') AS u2, url AS u1, CASE WHEN contains(url, '&') THEN replace(url, '&', '&amp;') ELSE url END AS url FROM pages)".replace("CASE WHEN url LIKE 'http%://%' THEN url END", "CASE WHEN u1 LIKE 'http%://%' THEN u1 END"))
def safe_urls(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "pages").select("page_id", T.safe_file_url("url").alias("safe_url"), T.html_escape(F.concat(F.lit("<"), "url", F.lit(">"))).alias("escaped"))


# --- Jobs ------------------------------------------------------------------------------------------------------------


@query("""WITH latest AS (SELECT user_id AS procurement_id, arg_max(value, ts::varchar || lpad(event_id::varchar, 20, '0')) AS priority FROM events GROUP BY user_id)
    SELECT procurement_id, 'proc:' || procurement_id AS member, priority, row_number() OVER (ORDER BY priority DESC, 'proc:' || procurement_id DESC) AS place FROM latest""")
def job_priority_order(spark: SparkSession, d: str) -> DataFrame:
    latest = jobs.latest_jobs(A.jobs(spark, d), ["ts", "event_id"]).withColumn("member", jobs.member())
    ranked = ranking.ordinal_rank(latest.withColumn("_v", -F.col("priority")), "_v", "member", "_asc")
    return ranking.reverse_ties(ranked, "_v", "_asc", "place").select("procurement_id", "member", "priority", F.col("place").cast("bigint").alias("place"))


@query("""WITH lease AS (SELECT 'proc:' || event_id AS member, ts AS claimed, value, event_type FROM events WHERE event_type IN ('error', 'click'))
    SELECT member, CASE WHEN event_type = 'error' THEN value ELSE 7.0 END AS priority FROM lease WHERE claimed <= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 600 SECOND""")
def lease_recovery(spark: SparkSession, d: str) -> DataFrame:
    events = A.jobs(spark, d).where("event_type in ('error', 'click')").withColumn("member", jobs.member("event_id"))
    leases, saved = events.select("member", F.col("ts").alias("claim_time")), events.where("event_type = 'error'").select("member", "priority")
    return jobs.recover_leases(leases, saved, F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00")), 600, 7.0)[1]


@query("SELECT user_id AS procurement_id, value AS score FROM events WHERE event_id % 3 = 0 AND event_id % 4 <> 0")
def result_apply(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events")
    rows = e.select("user_id", "event_id", F.struct(F.col("user_id").alias("procurement_id"), F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("score")).alias("r"))
    raw = rows.select(F.when(F.col("event_id") % 3 == 0, F.to_json("r")).otherwise("{broken").alias("value"))
    return jobs.parse_results(raw).select("procurement_id", "score")


@query(f"WITH {SCORED} SELECT id AS procurement_id, score AS priority FROM scored WHERE id % 2 = 1 AND score_method = 'default'")
def enqueue_new(spark: SparkSession, d: str) -> DataFrame:
    scored = scoring.default_scores(A.cards(spark, d), A.now(), ScoreConfig())
    return jobs.enqueueable(store.insert_if_absent(scored.where("id % 2 = 0"), scored), 0.0)


@query("SELECT event_id, least(30.0::double, 1.0::double * pow(2, event_id % 9)) AS delay, 1.5::double * (event_id % 9 + 1) AS linear FROM events")
def retry_schedule(spark: SparkSession, d: str) -> DataFrame:
    attempt = F.col("event_id") % 9 + 1
    return A.table(spark, d, "events").select("event_id", N.retry_delay(attempt, 1.0, 30.0).alias("delay"), N.linear_delay(attempt, 1.5).alias("linear"))


# --- Alerts ----------------------------------------------------------------------------------------------------------


@query(f"WITH {SCORED} SELECT id, score FROM scored WHERE score >= 200000")
def threshold_alerts(spark: SparkSession, d: str) -> DataFrame:
    return alerts.over_threshold(scoring.default_scores(A.cards(spark, d), A.now(), ScoreConfig()), 200_000.0).select("id", "score")


#: Amounts from cents to far beyond 10 ** 7, as shown in messages and urls.
_WIDE = "(o_totalprice * [0.0000001, 1, 100, 1000.5][cast(o_orderkey % 4 AS int) + 1])::double"


def _wide(key: str = "o_orderkey", amount: str = "o_totalprice") -> Column:
    return F.col(amount) * F.element_at(F.array(*map(F.lit, (0.0000001, 1.0, 100.0, 1000.5))), (F.col(key) % 4).cast("int") + 1)


@query(f"""WITH {SCORED}, wide AS (SELECT o_orderkey AS id, {_WIDE} AS amount FROM orders)
    SELECT id, '№: ' || number || chr(10) || 'Площадка: ' || source_platform || chr(10) || 'Предмет: ' || subject
    || CASE WHEN law IS NOT NULL THEN chr(10) || 'Закон: ' || law ELSE '' END || chr(10) || 'НМЦК: ' || amount::varchar
    || chr(10) || 'Опубликовано: ' || strftime(publication_date, '%Y-%m-%dT%H:%M:%S') || chr(10) || 'Срок подачи: ' || strftime(deadline, '%Y-%m-%dT%H:%M:%S')
    || chr(10) || 'Оценка: ' || score::varchar || chr(10) || '<a href="' || url || '">' || url || '</a>' AS message FROM scored JOIN wide USING (id)""")
def alert_messages(spark: SparkSession, d: str) -> DataFrame:
    cards = scoring.default_scores(A.cards(spark, d), A.now(), ScoreConfig())
    shown = cards.withColumns({"nmck": _wide("id", "nmck"), "customer": F.lit("  ")})
    return alerts.alert_messages(shown.select("id", "number", "source_platform", "subject", "law", "nmck", "publication_date", "deadline", "score", "url", "customer"))


@query(f"""WITH {PROC}, b AS (SELECT unnest(['telegram', 'webhook']) AS backend) SELECT backend, id, CASE backend
    WHEN 'webhook' THEN '{{"id":' || id || ',"number":"' || number || '","subject":"' || subject || '"}}' ELSE '№: ' || number || chr(10) || 'Предмет: ' || subject END AS payload FROM proc, b WHERE nmck > 300000""")
def alert_outbox(spark: SparkSession, d: str) -> DataFrame:
    cards = A.cards(spark, d).where("nmck > 300000").select("id", "number", "subject")
    return alerts.outbox(cards, ["telegram", "webhook", "none"])


# --- Accuracy --------------------------------------------------------------------------------------------------------


@query(f"""WITH {LABELLED}, c AS (SELECT count(*) AS total, count(*) FILTER (WHERE a = p) AS matched, count(*) FILTER (WHERE a AND p) AS tp, count(*) FILTER (WHERE NOT a AND p) AS fp,
        count(*) FILTER (WHERE NOT a AND NOT p) AS tn, count(*) FILTER (WHERE a AND NOT p) AS fn
        FROM (SELECT category IN ('perfect', 'synonym', 'close') AS a, score >= 1500 AS p FROM sim JOIN given USING (number))),
    m AS (SELECT *, coalesce(tp::double / nullif(tp + fp, 0), 0.0) AS pr, coalesce(tp::double / nullif(tp + fn, 0), 0.0) AS re FROM c)
    SELECT total, matched, tp, fp, tn, fn, {r2("coalesce(matched::double / nullif(total, 0), 0)", 4)} AS accuracy, {r2("pr", 4)} AS precision, {r2("re", 4)} AS recall, {r2("coalesce(2 * pr * re / nullif(pr + re, 0), 0)", 4)} AS f1 FROM m""")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(A.labelled(spark, d), A.label_scores(spark, d), 1500.0)


@query(f"WITH {LABELLED} SELECT category, count(score) AS total, count(*) FILTER (WHERE score >= 1500) AS predicted_positive FROM sim LEFT JOIN given USING (number) GROUP BY category")
def category_predictions(spark: SparkSession, d: str) -> DataFrame:
    return metrics.category_predictions(A.labelled(spark, d), A.label_scores(spark, d), 1500.0)


@query(f"WITH {LABELLED}, c AS (SELECT unnest([{', '.join(map(repr, CATEGORIES))}]) AS category) SELECT category, count(number) AS n FROM c LEFT JOIN (SELECT * FROM sim WHERE category <> 'far') USING (category) GROUP BY category")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.category_counts(A.labelled(spark, d).where("category <> 'far'"))


@query(f"""WITH {LABELLED}, s AS (SELECT * FROM sim WHERE category <> 'close' OR number LIKE '%1%'), t AS (SELECT count(*) AS total FROM s)
    SELECT category, count(*) AS n, {r2("count(*) / any_value(total)::double * 100.0", 1)} AS percent, abs(count(*) / any_value(total)::double * 100.0 - 20.0) > 10 AS violation FROM s, t GROUP BY category""")
def category_balance(spark: SparkSession, d: str) -> DataFrame:
    return metrics.category_balance(A.labelled(spark, d).where("category <> 'close' or number like '%1%'"))


@query(f"WITH {PAIRS} SELECT count(*) AS n, {r2('avg(abs(predicted - expected))', 4)} AS mae, {r2('sqrt(avg((predicted - expected) * (predicted - expected)))', 4)} AS rmse, {r2('avg(CASE WHEN abs(predicted - expected) <= 1.0 THEN 1.0::double ELSE 0.0 END)', 4)} AS accuracy FROM pairs")
def fit_errors(spark: SparkSession, d: str) -> DataFrame:
    return metrics.fit_errors(A.score_pairs(spark, d))


def _pearson_sql(source: str, x: str, y: str, out: str) -> str:
    return f"m AS (SELECT avg({x}) AS mx, avg({y}) AS my FROM {source}) SELECT {r2(f'sum(({x} - mx) * ({y} - my)) / nullif(sqrt(sum(({x} - mx) * ({x} - mx))) * sqrt(sum(({y} - my) * ({y} - my))), 0)', 4)} AS {out} FROM {source}, m"


@query(f"WITH {PAIRS}, {_pearson_sql('pairs', 'expected', 'predicted', 'pearson')}")
def pearson(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pearson(A.score_pairs(spark, d))


@query(f"""WITH {PAIRS}, ranked AS (SELECT cast(row_number() OVER (ORDER BY expected, item_id) AS double) AS rx, cast(row_number() OVER (ORDER BY predicted, item_id) AS double) AS ry FROM pairs),
    {_pearson_sql("ranked", "rx", "ry", "spearman")}""")
def spearman_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return metrics.spearman_ordinal(A.score_pairs(spark, d))


# --- Small functions -------------------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN event_id % 100 BETWEEN 10 AND 20 THEN 'записей' WHEN event_id % 10 = 1 THEN 'запись' WHEN event_id % 10 BETWEEN 2 AND 4 THEN 'записи' ELSE 'записей' END AS word,
    CASE WHEN value > 50 THEN 'да' ELSE 'нет' END AS flag FROM events""")
def plural_words(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "events").select("event_id", N.plural("event_id", "запись", "записи", "записей").alias("word"), N.yes_no(F.col("value") > 50).alias("flag"))


@query("SELECT event_id, cast(json_extract(props, '$.k') AS bigint) AS k FROM events")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN strftime(CASE WHEN event_id % 2 = 0 THEN ts - INTERVAL 3 HOUR ELSE ts END, '%Y-%m-%d %H:%M:%S') END AS update_date FROM events")
def json_times(spark: SparkSession, d: str) -> DataFrame:
    """Times with a zone out of JSON, null where the field is missing or no time."""
    zone = F.when(F.col("event_id") % 2 == 0, "+03:00").otherwise("Z")
    text = F.when(F.col("event_id") % 3 != 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)).when(F.col("event_id") % 2 == 0, "soon")
    events = A.table(spark, d, "events").select("event_id", F.to_json(F.struct(text.alias("update_date"))).alias("detail_json"))
    return events.select("event_id", stamp(T.json_time("detail_json", "update_date")).alias("update_date"))


@query(f"WITH {PROC} SELECT DISTINCT source_platform FROM proc")
def platforms(spark: SparkSession, d: str) -> DataFrame:
    return A.cards(spark, d).select("source_platform").distinct()


# --- Streams ---------------------------------------------------------------------------------------------------------


@query("SELECT min(event_id) AS id, cast(user_id AS varchar) AS number, event_type AS source_platform FROM events GROUP BY user_id, event_type")
def stream_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The events' file as a stream of cards into an empty store; the store afterwards."""
    base = f"{shared_folder(spark)}/bidloom/stream-{uuid.uuid4().hex}"
    rows = streams.file_stream(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("number"), F.col("event_type").alias("source_platform"))
    streams.insert_new_cards(rows, f"{base}/store", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/store")


@query("SELECT user_id AS procurement_id, arg_max(value, ts::varchar || lpad(event_id::varchar, 20, '0')) AS priority FROM events GROUP BY user_id")
def stream_queue(spark: SparkSession, d: str) -> DataFrame:
    """The last priority of each key, kept as streaming state."""
    rows = streams.file_stream(spark, d, "events").select(F.col("user_id").alias("procurement_id"), F.col("value").alias("priority"), "ts", "event_id")
    folder = f"{shared_folder(spark)}/bidloom/queue_{uuid.uuid4().hex}"
    streams.latest_jobs_stream(rows, ["ts", "event_id"], f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return streams.latest_jobs_table(spark, f"{folder}/table")


@query(f"""WITH {SCORED} SELECT user_id AS procurement_id, event_id, score FROM events JOIN scored ON user_id = id WHERE event_type = 'click'""")
def stream_worker(spark: SparkSession, d: str) -> DataFrame:
    """Jobs as a stream, enriched with their cards and scored; the published results."""
    jobs_in = streams.file_stream(spark, d, "events").where("event_type = 'click'").select(F.col("user_id").alias("procurement_id"), "event_id")
    folder = f"{shared_folder(spark)}/bidloom/worker-{uuid.uuid4().hex}"
    score = lambda rows: scoring.default_scores(rows, A.now(), ScoreConfig()).select("procurement_id", "event_id", "score")
    streams.score_jobs(jobs_in, A.cards(spark, d), score, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/table").drop("batch")


@query("""WITH e AS (SELECT event_id AS id, cast(event_id AS varchar) AS number, event_type AS source_platform, ts AS update_date FROM events),
    old AS (SELECT * FROM e WHERE source_platform <> 'error' AND update_date < TIMESTAMP '2024-01-10 12:00:00'),
    mark AS (SELECT source_platform, max(update_date) AS m FROM old GROUP BY source_platform)
    SELECT e.id, e.source_platform FROM e LEFT JOIN mark USING (source_platform)
    WHERE e.id IN (SELECT id FROM old) OR cast(e.update_date AS date) >= cast(coalesce(m, TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 5 DAY) AS date)""")
def stream_resume(spark: SparkSession, d: str) -> DataFrame:
    """A pass that goes on from the store's latest update of each platform; the store afterwards."""
    base = f"{shared_folder(spark)}/bidloom/resume-{uuid.uuid4().hex}"
    cards = lambda e: e.select(F.col("event_id").alias("id"), F.col("event_id").cast("string").alias("number"), F.col("event_type").alias("source_platform"), F.col("ts").alias("update_date"))
    cards(A.table(spark, d, "events")).where("source_platform <> 'error' and update_date < timestamp_ntz'2024-01-10 12:00:00'").write.parquet(f"{base}/store")
    now = F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))
    streams.insert_new_cards(cards(streams.file_stream(spark, d, "events")), f"{base}/store", f"{base}/checkpoint", resume=(now, 5)).awaitTermination()
    return spark.read.parquet(f"{base}/store").select("id", "source_platform")


# --- Committed tables, the queue -------------------------------------------------------------------------------------


def _committed_cards(spark: SparkSession, d: str) -> CommittedTable:
    """Versions: the even cards, then the absent ones, new amounts of every fifth, without every seventh."""
    cards = A.cards(spark, d).select("id", "number", "source_platform", "nmck")
    table = CommittedTable.create(spark, f"{shared_folder(spark)}/bidloom/cards-{uuid.uuid4().hex}", cards.schema, ["number", "source_platform"], 16)
    table.insert(cards.where("id % 2 = 0"), "id")
    table.insert(cards.withColumn("nmck", F.lit(-1.0)), "id")
    table.update(cards.where("id % 5 = 0").withColumn("nmck", F.col("nmck") + 1), ["nmck"])
    table.delete(cards.where("id % 7 = 0").select("number", "source_platform"))
    return table


_VERSIONS = f"""{PROC}, v1 AS (SELECT id, number, source_platform, nmck FROM proc WHERE id % 2 = 0),
    v4 AS (SELECT id, number, source_platform, CASE WHEN id % 5 = 0 THEN nmck + 1 WHEN id % 2 = 0 THEN nmck ELSE -1.0 END AS nmck FROM proc WHERE id % 7 <> 0)"""


@query(f"WITH {_VERSIONS} SELECT * FROM v4")
def store_versions(spark: SparkSession, d: str) -> DataFrame:
    """The last version of a committed table after inserts, updates and deletes by key."""
    return _committed_cards(spark, d).read()


@query(f"""WITH {_VERSIONS} SELECT CASE WHEN v1.id IS NULL THEN 'insert' WHEN v4.id IS NULL THEN 'delete' ELSE 'update' END AS kind,
    coalesce(v1.number, v4.number) AS number, coalesce(v1.source_platform, v4.source_platform) AS source_platform, v1.nmck AS before_nmck, v4.nmck AS after_nmck
    FROM v1 FULL JOIN v4 USING (number, source_platform) WHERE v1.id IS NULL OR v4.id IS NULL OR v1.nmck <> v4.nmck""")
def change_feed(spark: SparkSession, d: str) -> DataFrame:
    """What differs between the first version and the last: inserts, deletes, and updates with both sides."""
    changes = _committed_cards(spark, d).changes(1)
    return changes.select("kind", "number", "source_platform", F.col("before.nmck").alias("before_nmck"), F.col("after.nmck").alias("after_nmck"))


@query("SELECT min(event_id) AS id, cast(user_id AS varchar) AS number, event_type AS source_platform FROM events GROUP BY user_id, event_type")
def stream_committed(spark: SparkSession, d: str) -> DataFrame:
    """The events' file as a stream of cards into a committed table; its last version."""
    base = f"{shared_folder(spark)}/bidloom/committed-{uuid.uuid4().hex}"
    rows = streams.file_stream(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("number"), F.col("event_type").alias("source_platform"))
    table = CommittedTable.create(spark, f"{base}/store", rows.schema, ["number", "source_platform"], 16)
    streams.insert_committed(rows, table, f"{base}/checkpoint").awaitTermination()
    return table.read()


@query(f"""WITH {_VERSIONS} SELECT id, number, source_platform, nmck, CASE WHEN id % 5 = 0 THEN 'checked' END AS note, cast(floor(nmck) AS bigint) AS whole FROM v4""")
def change_sets(spark: SparkSession, d: str) -> DataFrame:
    """A committed table after ordered change sets: an added column, new values in it, a copy with a computed column."""
    table = _committed_cards(spark, d)
    first = ChangeSet("1", add="note string")
    table.migrate([first])
    table.update(A.cards(spark, d).where("id % 5 = 0").select("number", "source_platform", F.lit("checked").alias("note")), ["note"])
    table.migrate([first, ChangeSet("2", copy=lambda rows: rows.withColumn("whole", F.floor("nmck")))])
    return table.read()


_OFFSETS = (0, 7_000, 14_990)


@query(" UNION ALL ".join(f"SELECT o_orderkey AS id, {o} + row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET {o})" for o in _OFFSETS))
def cursor_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of cards by falling amount at several offsets, each from the files that hold it."""
    path = f"{shared_folder(spark)}/bidloom/pages-{uuid.uuid4().hex}"
    paging.write_in_order(A.cards(spark, d).select("id", "nmck"), [F.desc("nmck"), F.asc("id")], path, 5_000)
    pages = [paging.page(spark, path, offset, 20).select("id", "rank") for offset in _OFFSETS]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@query("""WITH asked AS (SELECT c_custkey AS pattern_id, CASE (c_custkey // 100) % 4 WHEN 0 THEN right(c_name, 4) WHEN 1 THEN '_' || right(c_name, 3) WHEN 2 THEN upper(left(c_name, 8)) || '%' || right(c_name, 3) ELSE right(c_name, 2) END AS part
        FROM customer WHERE c_custkey % 100 = 0) SELECT pattern_id, c_custkey AS id FROM asked, customer WHERE c_name ILIKE '%' || part || '%'""")
def substring_search(spark: SparkSession, d: str) -> DataFrame:
    """Patterns made of every hundredth customer's name, against all names, through the index of substrings."""
    path = f"{shared_folder(spark)}/bidloom/trigrams-{uuid.uuid4().hex}"
    names = A.customers(spark, d).select("id", "name")
    trigrams.build_index(names, "id", "name", path)
    name, kind = F.col("name"), F.floor(F.col("id") / 100) % 4
    part = F.when(kind == 0, F.right(name, F.lit(4))).when(kind == 1, F.concat(F.lit("_"), F.right(name, F.lit(3)))).when(kind == 2, F.concat(F.upper(F.left(name, F.lit(8))), F.lit("%"), F.right(name, F.lit(3)))).otherwise(F.right(name, F.lit(2)))
    patterns = names.where("id % 100 = 0").select(F.col("id").alias("pattern_id"), trigrams.containing(part).alias("pattern"))
    return trigrams.search(names, patterns, path, "id", "name").select("pattern_id", "id")


def _queue_sql(steps: int, n: int) -> str:
    ctes = ["""ev AS (SELECT event_id % 3 AS batch, CASE WHEN event_type = 'error' THEN 'finish' ELSE 'enqueue' END AS kind, user_id AS id, value AS priority,
        ts + to_days(cast(event_id % 3 AS int)) AS moment, event_id AS seq FROM events)""", "s0 AS (SELECT NULL::bigint AS id, NULL::double AS priority, NULL::timestamp AS claimed_at, NULL::double AS claimed_priority WHERE false)"]
    for k in range(steps):
        ctes.append(f"""e{k} AS (SELECT id, arg_max(priority, moment::varchar || lpad(seq::varchar, 20, '0')) FILTER (kind = 'enqueue') AS new, coalesce(bool_or(kind = 'finish'), false) AS finished FROM ev WHERE batch = {k} GROUP BY id),
    n{k} AS (SELECT max(moment) AS now FROM ev WHERE batch = {k}),
    j{k} AS (SELECT coalesce(s.id, e.id) AS id, s.priority, s.claimed_at, s.claimed_priority, new, coalesce(finished, false) AS finished, coalesce(claimed_at <= now - INTERVAL 12 HOUR, false) AS stale
        FROM s{k} s FULL JOIN e{k} e ON s.id = e.id, n{k}),
    a{k} AS (SELECT id, coalesce(new, CASE WHEN stale AND NOT finished THEN claimed_priority END, priority) AS priority,
        CASE WHEN NOT (stale OR finished) THEN claimed_at END AS claimed_at, CASE WHEN NOT (stale OR finished) THEN claimed_priority END AS claimed_priority FROM j{k}),
    c{k} AS (SELECT {k} AS batch, id, priority, row_number() OVER (ORDER BY priority DESC, 'proc:' || id DESC) AS place FROM a{k} WHERE priority IS NOT NULL QUALIFY place <= {n}),
    s{k + 1} AS (SELECT a.id, CASE WHEN c.id IS NULL THEN a.priority END AS priority, CASE WHEN c.id IS NULL THEN a.claimed_at ELSE now END AS claimed_at, coalesce(c.priority, a.claimed_priority) AS claimed_priority
        FROM a{k} a LEFT JOIN c{k} c ON a.id = c.id, n{k})""")
    claims = " UNION ALL ".join(f"SELECT batch, place, id AS procurement_id, priority FROM c{k}" for k in range(steps))
    return f"WITH {', '.join(ctes)} {claims}"


@query(_queue_sql(3, 20))
def queue_claims(spark: SparkSession, d: str) -> DataFrame:
    """The events as three micro-batches of the job queue; what each step claims, in order."""
    base = f"{shared_folder(spark)}/bidloom/claims-{uuid.uuid4().hex}"
    part = F.col("event_id") % 3
    kind = F.when(F.col("event_type") == "error", "finish").otherwise("enqueue")
    at = F.col("ts") + F.make_dt_interval(days=part.cast("int"))
    events = A.table(spark, d, "events").select(part.alias("batch"), kind.alias("kind"), F.col("user_id").alias("procurement_id"), F.col("value").alias("priority"), at.alias("at"), F.col("event_id").alias("seq"))
    queue = queues.open_queue(spark, f"{base}/queue", 16)
    for k in range(3):
        claims = queues.step(queue, events.where(F.col("batch") == k), k, 20, 43_200, 0.0)
        place = F.row_number().over(Window.orderBy(F.desc("priority"), F.desc(jobs.member())))  # at most 20 rows
        claims.withColumn("place", place).write.parquet(f"{base}/claims/batch={k}")
    return spark.read.parquet(f"{base}/claims").select(F.col("batch").cast("bigint").alias("batch"), F.col("place").cast("bigint").alias("place"), "procurement_id", "priority")


# --- Reads, list urls, output -----------------------------------------------------------------------------------------


@query(f"WITH {PROC} SELECT id, number, law, nmck FROM proc WHERE id = 7")
def card_by_id(spark: SparkSession, d: str) -> DataFrame:
    return reads.by_id(A.cards(spark, d), 7).select("id", "number", "law", "nmck")


@query(f"""WITH {PROC} SELECT number, CASE WHEN id % 3 = 0 THEN 'portal_c' ELSE source_platform END AS source_platform, id % 3 <> 0 AS found FROM proc""")
def cards_known(spark: SparkSession, d: str) -> DataFrame:
    cards = A.cards(spark, d)
    asked = cards.select("number", F.when(F.col("id") % 3 == 0, "portal_c").otherwise(F.col("source_platform")).alias("source_platform"))
    return reads.known(cards, asked)


@query(f"""WITH {SCORED}, {CUST} SELECT number, source_platform, url, cust.name AS customer, law, subject, nmck, {sql_stamp("publication_date")} AS publication_date, {sql_stamp("deadline")} AS deadline,
    score, score_method FROM scored LEFT JOIN cust ON customer_id = cust.id""")
def alert_view(spark: SparkSession, d: str) -> DataFrame:
    view = reads.alert_view(scoring.default_scores(A.cards(spark, d), A.now(), ScoreConfig()), A.customers(spark, d))
    return view.withColumns({c: stamp(c) for c in ("publication_date", "deadline")})


@query(f"WITH {PROC}, {CUST} SELECT proc.id, number, cust.name AS customer, okpd2_codes, cast(NULL AS varchar) AS kpgz_codes, CASE WHEN proc.id % 2 = 0 THEN '{{}}' END AS detail_json FROM proc LEFT JOIN cust ON customer_id = cust.id")
def detail_view(spark: SparkSession, d: str) -> DataFrame:
    cards = A.cards(spark, d).withColumn("detail_json", F.when(F.col("id") % 2 == 0, "{}"))
    view = reads.detail_view(cards, A.customers(spark, d))
    return view.select("id", "number", "customer", "okpd2_codes", F.col("kpgz_codes").cast("string").alias("kpgz_codes"), "detail_json")


@query("""WITH c AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 1 THEN 'https://portal.example/f/' || o_orderkey WHEN 2 THEN 'specs/a b ' || o_orderkey || '.PDF' WHEN 3 THEN '' END AS u FROM orders)
    SELECT id, CASE WHEN id % 4 = 1 THEN 302 WHEN id % 4 = 2 THEN 200 ELSE 404 END AS status, CASE WHEN id % 4 = 1 THEN u END AS location, CASE WHEN id % 4 = 2 THEN substr(u, 7) END AS file_name,
    CASE WHEN id % 4 = 2 THEN 'application/pdf' END AS media_type, CASE WHEN id % 4 = 2 THEN 'attachment; filename="a%20b%20' || id || '.PDF"; filename*=UTF-8''a%20b%20' || id || '.PDF' END AS disposition FROM c""".replace("UTF-8''", "UTF-8''''"))
def spec_downloads(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    url = F.when(k % 4 == 1, F.concat(F.lit("https://portal.example/f/"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("specs/a b "), k.cast("string"), F.lit(".PDF"))).when(k % 4 == 3, "")
    return reads.spec_downloads(A.cards(spark, d).select("id", url.alias("technical_spec_url"))).drop("technical_spec_url")


@query(f"""WITH {PROC}, page AS (SELECT * FROM proc ORDER BY id DESC LIMIT 100)
    SELECT (SELECT count(*) FROM proc) || ':' || string_agg(id || '@' || strftime(update_date, '%Y-%m-%dT%H:%M:%S'), ',' ORDER BY id DESC) AS signature FROM page""")
def page_signature(spark: SparkSession, d: str) -> DataFrame:
    return reads.page_signature(A.cards(spark, d))


@query(f"WITH {PROC} SELECT id FROM proc ORDER BY cast(publication_date AS date) DESC, id LIMIT 50")
def newest_first(spark: SparkSession, d: str) -> DataFrame:
    return reads.newest_first(A.raw_cards(spark, d), "dates", "id").select("id").limit(50)  # a list page of 50


@query(f"WITH {PROC}, p AS (SELECT id, publication_date, lag(publication_date) OVER (PARTITION BY id // 10 ORDER BY id) AS before FROM proc) SELECT id FROM p WHERE publication_date > before")
def out_of_order(spark: SparkSession, d: str) -> DataFrame:
    cards = A.cards(spark, d).select("id", "publication_date", F.floor(F.col("id") / 10).alias("page_no"))
    return reads.out_of_order(cards, "publication_date", "page_no", "id").select("id")


@query(f"""WITH {_ASKED}, {_TREE_SQL},
    node AS (SELECT q.id, pos, coalesce((SELECT k FROM tree WHERE code = q.code), (SELECT arg_max(k, length(k)) FROM tree WHERE starts_with(q.d, k))) AS n FROM q),
    kept AS (SELECT id, n, min(pos) AS o FROM node WHERE n IS NOT NULL GROUP BY id, n),
    ids AS (SELECT id, string_agg(n, ',' ORDER BY o) AS ids FROM kept GROUP BY id),
    r AS (SELECT proc.id, id % 2 = 0 AS fz, CASE WHEN id % 3 <> 0 THEN {_WIDE.replace("o_totalprice", "nmck").replace("o_orderkey", "id")} END AS low, ids.ids FROM proc LEFT JOIN ids USING (id))
    SELECT id, 'https://portal.example/purchase/list?page=1&filter=' || url_encode('{{"typeIn":{{"values":[2]}},"need":{{"paths":["x.' || id || '."]' || CASE WHEN low IS NOT NULL THEN ',"from":' || low::varchar ELSE '' END
    || '}},"published":"01.07.1998 15:00:00","note":"a\\"b\\\\c\\n' || id || '"}}') || '&state=' || url_encode('{{"tab":2}}') || CASE WHEN fz THEN '&fz44=on' ELSE '' END
    || CASE WHEN low IS NOT NULL THEN '&priceFrom=' || url_encode(CASE WHEN low = floor(low) THEN low::bigint::varchar ELSE low::varchar END) ELSE '' END || CASE WHEN ids IS NOT NULL THEN '&okpd2Ids=' || url_encode(ids) ELSE '' END AS list_url,
    'https://portal.example/purchase/list' AS plain_url FROM r""")
def list_page_urls(spark: SparkSession, d: str) -> DataFrame:
    m = list_urls.Mapping
    search = list_urls.Search(
        {"page": "1", "filter": "{filter_json}", "state": "{state_json}"},
        {"typeIn": {"values": [2]}},
        {"tab": 2},
        {"paths": m("need.paths"), "fz44": m(query_param="fz44"), "fz223": m(query_param="fz223"), "nmck_min": m("need.from", "priceFrom"), "publish_date": m("published"), "note": m("note"), "okpd2": m(query_params={"okpd2Ids": "{okpd2_ids}"})},
    )
    cards = A.cards(spark, d).withColumn("codes", F.split("okpd2_codes", ","))
    tree = _tree(spark).withColumn("node_id", T.digits("code"))
    asked = cards.join(codes.resolve_code_ids(cards.select("id", "codes"), tree, "id"), "id")
    k = F.col("id")
    criteria = list_urls.Criteria(cutoff=A.now(), okpd_ids=F.col("ids"), fz44=k % 2 == 0, fz223=F.lit(False), nmck_min=F.when(k % 3 != 0, _wide("id", "nmck")))
    terms = {"paths": lambda c, s: F.array(F.concat(F.lit("x."), k.cast("string"), F.lit("."))), "note": lambda c, s: F.concat(F.lit('a"b\\c\n'), k.cast("string"))}
    site = ("https://portal.example/", "/purchase/list")
    return asked.select("id", list_urls.list_url(*site, search, criteria, terms).alias("list_url"), list_urls.list_url(*site, None, criteria).alias("plain_url"))


@query(f"""WITH {PROC} SELECT id, '{{"card":{{"id":' || id || ',"law":' || coalesce('"' || law || '"', 'null') || ',"deadline":"' || strftime(deadline, '%Y-%m-%dT%H:%M:%S') || '"}},"dates":["' || strftime(update_date, '%Y-%m-%dT%H:%M:%S') || '"]}}' AS value FROM proc""")
def json_cards(spark: SparkSession, d: str) -> DataFrame:
    nested = F.struct(F.struct("id", "law", "deadline").alias("card"), F.array("update_date").alias("dates"))
    return A.cards(spark, d).select("id", writers.iso_json(nested).alias("value"))


@query(f"""WITH {PAIRS}, m AS (SELECT '{{"metrics":{{"n":' || count(*) || '}}}}' AS value FROM pairs) SELECT value FROM m
    UNION ALL SELECT '{{"item":{{"item_id":' || item_id || ',"good":' || CASE WHEN predicted > 5 THEN 'true' ELSE 'false' END || '}}}}' FROM pairs""")
def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    pairs = A.score_pairs(spark, d)
    return writers.evaluation_report(metrics.fit_errors(pairs).select("n"), pairs.select("item_id", (F.col("predicted") > 5).alias("good")))


@query(f"""WITH {PROC}, p AS (SELECT *, cast(floor(nmck) AS bigint) AS w, cast(round(nmck * 100) AS bigint) % 100 AS f FROM proc)
    SELECT id, replace(format('{{:,}}', w), ',', chr(160)) || CASE WHEN f = 0 THEN '' WHEN f % 10 = 0 THEN ',' || f // 10 ELSE ',' || lpad(cast(f AS varchar), 2, '0') END AS amount,
    strftime(deadline, '%d.%m.%Y, %H:%M:%S') AS until, strftime(update_date, '%d.%m.%Y, %H:%M') AS updated FROM p""")
def shown_values(spark: SparkSession, d: str) -> DataFrame:
    return A.cards(spark, d).select("id", N.shown_number("nmck").alias("amount"), N.shown_time("deadline").alias("until"), N.shown_time("update_date", False).alias("updated"))


@query(f"WITH {PROC} SELECT id, cast(nmck AS varchar) IS NOT NULL AS priced, law, source_platform, 'none' AS score_method, (SELECT max(id) FROM proc) AS last_id FROM proc")
def schema_copy(spark: SparkSession, d: str) -> DataFrame:
    new = reads.migrated(A.cards(spark, d), "law string, id bigint, nmck double, source_platform string, score_method string, comment string", {"score_method": F.lit("none")})
    return new.join(reads.last_identity(new), F.lit(True)).select("id", F.col("nmck").isNotNull().alias("priced"), "law", "source_platform", "score_method", "last_id")  # one row


@query("""SELECT page_id, 'https://portal.example' || regexp_extract(html, '<a href="([^"]*)"', 1) AS href, contains(html, '<footer') AS has_next FROM pages""")
def page_navigation(spark: SparkSession, d: str) -> DataFrame:
    """The first link of each page, absolute, and whether an element tells that the list goes on."""
    pages = A.table(spark, d, "pages")
    return extract.first_link(pages, "nav a[href]", F.lit("https://portal.example/")).join(extract.list_pages(pages, "body footer"), "page_id")


@query("""WITH rec AS (SELECT o_orderkey AS id, c_custkey AS c, c_name FROM orders JOIN customer ON o_custkey = c_custkey), fresh AS (SELECT lower(c_name) AS n, min(id) AS f FROM rec WHERE c % 3 = 0 GROUP BY 1)
    SELECT lower(c_name) AS normalized_name, CASE WHEN c % 3 <> 0 THEN c ELSE 1000000 - 1 + (SELECT count(*) FROM fresh b WHERE b.f <= fresh.f) END AS customer_id
    FROM (SELECT DISTINCT c, c_name FROM rec) LEFT JOIN fresh ON n = lower(c_name)""")
def append_customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers that the store lacks get ids in the order of their first card; every name finds its customer."""
    known = A.customers(spark, d).where("id % 3 <> 0").select("id", "name", "normalized_name")
    asked = A.table(spark, d, "orders").join(A.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.upper("c_name").alias("name"))
    return identity.append_customers(known, asked, 1_000_000)[1]
