"""Operators on small tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bidloom.config import ScoreConfig, SearchCriteria, StopConditions, Variable, enabled_sites, layered, redacted, require_platforms
from bidloom.operators import alerts, codes, extract, filters, graph, identity, jobs, metrics, ranking, scoring, store

NOW = datetime(2026, 8, 5, 12)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_default_scores(spark):
    data = [(1, "62.01.29.000", 1000.0, None), (2, "99", 200.0, None), (3, None, 100.0, None), (4, "62.01", 100.0, datetime(2026, 8, 1)), (5, "62-01, 99", 1234.567, NOW), (6, "62.01", None, None)]
    cards = spark.createDataFrame(data, "id int, okpd2_codes string, nmck double, deadline timestamp")
    out = scoring.default_scores(cards, F.lit(NOW), ScoreConfig(fit_table={"62.01": 0.9, "62": 0.1}))
    assert rows(out, "id", "score", "score_method") == [(1, 900.0, "default"), (2, 100.0, "default"), (3, 50.0, "default"), (4, 0.0, "deadline_expired"), (5, round(0.9 * 1234.567, 2), "default"), (6, 0.0, "default")]


def test_external_and_stub_scores(spark):
    r = spark.createDataFrame([(8.0, 100.0)], "fit double, nmck double")
    assert r.select(scoring.external_score("fit", "nmck", ScoreConfig())).first()[0] == 80.0
    assert r.select(scoring.external_score("fit", "nmck", ScoreConfig(normalize_fit=False))).first()[0] == 800.0
    stub = scoring.stub_scores(spark.createDataFrame([(55.555, 3.0), (None, None)], "score double, nmck double"), ScoreConfig())
    assert rows(stub, "score", "final_fit_score") == [(0.0, 0.0), (55.55 if round(55.555, 2) == 55.55 else 55.56, 10.0)]


def test_model_scores_refine(spark):
    cards = spark.createDataFrame([(1, "a")], "procurement_id long, description string")
    seen = scoring.model_scores(cards, lambda texts, hints: [7.0 if h == "more" else 3.0 for h in hints], lambda texts, fits: [("accept" if f > 5 else "reject", "more", f) for f in fits], 1)
    assert rows(seen, "fit_score", "verdict", "rounds") == [(7.0, "accept", 1)]
    never = scoring.model_scores(cards, lambda texts, hints: [30.0] * len(texts), lambda texts, fits: [("reject", "no", f) for f in fits], 2)
    assert rows(never, "fit_score", "verdict", "rounds") == [(10.0, "reject", 2)]


def test_prompt(spark):
    out = spark.createDataFrame([("a {who}", None)], "text string, hint string").select(scoring.prompt("Rate {text}. {hint}|{other}", text=F.col("text"), hint=F.col("hint")))
    assert out.first()[0] == "Rate a {who}. |{other}"


def test_description(spark):
    data = [("  Закупка \n ПО ", '{"customer": " A  B ", "law": null, "nmck": 5}', "44-ФЗ", "C"), (None, None, None, None)]
    cards = spark.createDataFrame(data, "subject string, detail_json string, law string, customer string")
    out = [r[0] for r in cards.select(scoring.description("detail_json", "law", "customer")).collect()]
    assert out == ["Закупка ПО\ncustomer: A B\nnmck: 5\nlaw: 44-ФЗ", scoring.NO_DESCRIPTION]


TREE = [("62", ".1."), ("62.02.1", ".1.21."), ("62.02.2", ".1.22."), ("62.02.3", ".1.23."), ("63.11", ".2.")]


@pytest.mark.parametrize(
    ("asked", "wanted"),
    [(["62.02"], [".1.21.", ".1.22.", ".1.23."]), (["62.09.2.100"], [".1."]), (["62-00"], [".1."]), (["6 2 0 0"], [".1."]), (["11.1"], []), (["63.11", "62.02.1", "63.11"], [".2.", ".1.21."]), ([], []), (["--"], [])],
)
def test_resolve_codes(spark, asked, wanted):
    tree = spark.createDataFrame(TREE, "code string, path string")
    requests = spark.createDataFrame([(1, asked)], "request_id int, codes array<string>")
    assert codes.resolve_codes(requests, tree).first()["paths"] == wanted


def test_resolve_code_ids(spark):
    tree = spark.createDataFrame([("62", "8873937"), ("63", "8873938")], "code string, node_id string")
    requests = spark.createDataFrame([(1, ["62", "63.1", "62"]), (2, ["11.1"])], "request_id int, codes array<string>")
    assert rows(codes.resolve_code_ids(requests, tree), "request_id", "ids") == [(1, "8873937,8873938"), (2, None)]


def test_longest_prefix_and_tree(spark):
    table = spark.createDataFrame([("62", 0.1), ("62.01", 0.9), ("", 0.4)], "code string, fit double")
    cards = spark.createDataFrame([(1, "62.01.29"), (2, "62.9"), (3, "11"), (4, None)], "id int, code string")
    assert rows(codes.longest_prefix(cards, F.col("code"), table, "code", "fit", "fit"), "id", "fit") == [(1, 0.9), (2, 0.1), (3, None), (4, None)]
    html = '<a value=".1.2.">Old(62.1)<i/></a><a value=".1.3."> New (62.1)<i/></a><a value=".4.">B(63)<'
    tree = codes.tree_from_html(spark.createDataFrame([(html,)], "html string"))
    assert rows(tree, "code", "path", "name") == [("62.1", ".1.3.", "New"), ("63", ".4.", "B")]


@pytest.mark.parametrize(("until", "least", "kept"), [(None, 2, True), (datetime(2026, 8, 5, 11), None, False), (datetime(2026, 8, 5, 12), None, True), (datetime(2026, 8, 7, 11), 2, False), (datetime(2026, 8, 7, 12), 2, True)])
def test_stop_conditions(spark, until, least, kept):
    cards = spark.createDataFrame([(1, until)], "id int, deadline timestamp")
    assert filters.stop_conditions(cards, F.lit(NOW), StopConditions(min_deadline_days=least)).count() == kept
    assert filters.stop_conditions(cards, F.lit(NOW), StopConditions(min_deadline_days=least, enabled=False)).count() == 1


def test_cutoff_and_take_while(spark):
    days = spark.createDataFrame([(0, datetime(2026, 8, 5, 0)), (1, datetime(2026, 8, 4)), (2, None), (3, datetime(2026, 8, 6))], "pos int, p timestamp")
    older = filters.older_than_cutoff(F.col("p"), F.lit(NOW))
    assert rows(days.select("pos", older.alias("o")), "pos", "o") == [(0, False), (1, True), (2, None), (3, False)]
    assert rows(filters.take_while_newer(days, older, ["pos"]), "pos") == [(0,)]
    assert filters.take_while_newer(days, F.lit(False), ["pos"]).count() == 4


def test_search_and_page(spark):
    cards = spark.createDataFrame([(i, f"n{i}", "ab"[i % 2], f"62.{i}", i % 3) for i in range(30)], "id int, number string, source_platform string, okpd2_codes string, customer_id int")
    who = spark.createDataFrame([(0, "Alpha", "1"), (1, "Beta", None), (2, "Gamma", "2")], "id int, name string, inn string")
    assert filters.search_cards(cards, who).count() == 30
    assert rows(filters.search_cards(cards, who, number="N1", source_platform="b", customer="ALPHA"), "id") == [(15,)]
    assert filters.search_cards(cards, who, number="n_").count() == 30
    assert rows(filters.page(cards, 2, 3), "rank", "id") == [(4, 26), (5, 25)]
    assert rows(filters.search_customers(who, inn="2"), "name") == [("Gamma",)]
    with pytest.raises(ValueError, match="limit"):
        filters.page(cards, 101)
    pages = spark.createDataFrame([(0,), (1,), (50,), (51,)], "n int").select(filters.page_count(F.col("n"), 50)).collect()
    assert [r[0] for r in pages] == [1, 1, 1, 2]


def test_files_and_validation(spark):
    files = [("ТЕХНИЧЕСКОЕ ЗАДАНИЕ.doc", "u1"), ("a", "u2"), (None, "u3"), ("a", "u2"), ("Техническое задание 2", "u4")]
    out = filters.split_files(spark.createDataFrame([(files,), ([],)], "files array<struct<name string, url string>>")).collect()
    assert (out[0]["technical_spec_url"], [f["url"] for f in out[0]["files_json"]]) == ("u1", ["u2", "u3", "u2"])
    assert out[1]["technical_spec_name"] is None and out[1]["files_json"] is None
    good, bad = filters.valid_rows(spark.createDataFrame([(1.0, "far"), (-1.0, "far"), (1.0, "x"), (None, "far")], "nmck double, category string"), ["far"])
    assert (good.count(), bad.count()) == (1, 3)


def test_pushdown_of_criteria(spark, tmp_path):
    path = str(tmp_path / "cards")
    spark.range(100).selectExpr("id", "cast(id as double) nmck", "'44-ФЗ' law", "'62.01' okpd2_codes", "timestamp'2026-08-01' publication_date", "timestamp'2026-09-01' deadline").write.parquet(path)
    hit = filters.by_criteria(spark.read.parquet(path), SearchCriteria(okpd_codes=("62",), fz44=True, nmck_max=9.0)).select("id")
    assert hit.count() == 10
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(nmck,9.0)" in plan and "deadline" not in plan.split("ReadSchema")[1]


def test_store(spark):
    schema = "id int, number string, source_platform string, score double, score_method string"
    old = spark.createDataFrame([(1, "a", "p", 1.0, "default")], schema)
    new = spark.createDataFrame([(5, "a", "p", 2.0, "x"), (7, "b", "p", 3.0, "x"), (6, "b", "p", 4.0, "x"), (8, None, "p", 5.0, "x"), (9, "", "p", 5.0, "x"), (10, "a", "q", 6.0, "x")], schema)
    after = store.insert_if_absent(old, new)
    assert set(rows(after, "id", "inserted")) == {(1, False), (6, True), (10, True)}
    results = spark.createDataFrame([(1, 9.999, "m1", 1), (1, 5.555, "m2", 2), (99, 1.0, "m", 3)], "procurement_id int, score double, score_method string, seq int")
    assert rows(store.update_scores(old, results), "id", "score", "score_method") == [(1, round(5.555, 2), "m2")]
    given = store.update_given(spark.createDataFrame([(1, "n", "u")], "id int, name string, url string"), spark.createDataFrame([(1, None, "v")], "id int, name string, url string"), ["name", "url"])
    assert rows(given, "name", "url") == [("n", "v")]
    rated, found = store.set_values(spark.createDataFrame([(1, 2.0)], "id int, rating double"), spark.createDataFrame([(1, None), (2, 3.0)], "id int, rating double"), "rating")
    assert rows(rated, "rating") == [(None,)] and rows(found, "id", "found") == [(1, True), (2, False)]
    base = spark.createDataFrame([(1, "a", "b")], "id int, x string, y string")
    none = spark.createDataFrame([(1, None, "z")], "id int, x string, z string")
    assert store.merge_details(base, none, "id").first()["x"] is None
    assert store.merge_extra(base, none, "id").first()["x"] == "a"
    two = store.with_code_fallback(spark.createDataFrame([("", "62"), ("63", "62"), (None, None)], "okpd2_codes string, okpd2_code string"))
    assert [r[0] for r in two.collect()] == ["62", "63", None]


def test_watermark(spark):
    cards = spark.createDataFrame([("a", datetime(2026, 8, 3, 21))], "source_platform string, update_date timestamp")
    marks = store.watermarks(cards, spark.createDataFrame([("a",), ("b",)], "source_platform string"), F.lit(NOW), 7)
    assert rows(marks, "source_platform", "watermark") == [("a", datetime(2026, 8, 3, 21)), ("b", datetime(2026, 7, 29, 12))]


RECORD = "id long, customer string, inn string"
CUSTOMER = "id long, name string, normalized_name string, inn string"


def _naive(records, known):
    """The sequential rule, one record after another."""
    by_name, inns, out = {c[2]: c[0] for c in known}, {c[0]: c[3] for c in known}, {}
    for key, name, inn in sorted(records):
        norm = " ".join((name or "").split()).lower()
        if not norm:
            continue
        if norm in by_name:
            own = by_name[norm]
            if inn and not inns[own]:
                inns[own] = inn
        elif inn and inn in inns.values():
            own = next(c for c, i in inns.items() if i == inn)
        else:
            own = by_name[norm] = -1 - key
            inns[own] = inn or None
        out[key] = own
    return out


@pytest.mark.parametrize(
    ("records", "known"),
    [
        ([(1, "ООО Ромашка", None), (2, "ООО   Ромашка ", "7701234567"), (3, "", "1"), (4, None, None)], []),
        ([(1, "A", "1"), (2, "B", "1"), (3, "B", None), (4, "C", "1"), (5, "a ", "2")], []),
        ([(1, "X", None), (2, "Y", "9"), (3, "X", "9"), (4, "Z", "9")], [(100, "X", "x", None), (101, "Old", "old", "9")]),
        ([(1, "N", None), (2, "M", "5"), (3, "N", "5"), (4, "K", "5"), (5, "N", "6"), (6, "L", "6")], []),
    ],
)
def test_resolve_customers(spark, records, known):
    out = identity.resolve_customers(spark.createDataFrame(records, RECORD), spark.createDataFrame(known, CUSTOMER))
    assert {r["record_id"]: r["customer_id"] for r in out.collect()} == _naive(records, known)


@pytest.mark.parametrize("seed", range(4))
def test_resolve_customers_like_one_after_another(spark, seed):
    """Hot names and numbers that connect most records: only deciding ones are folded, and all agree with the rule."""
    import random

    rng = random.Random(seed)
    names = [f"n{k}" for k in range(25)] + ["Hot"] * 8
    inns = [str(k) for k in range(8)] + ["7"] * (3 + 8 * (seed % 2)) + [None, ""]
    records = [(k, rng.choice(names), rng.choice(inns)) for k in range(300)]
    records += [(300 + k, f"leaf{rng.randint(0, 40)}", "7") for k in range(120)]
    rng.shuffle(records)
    records = [(k, r[1], r[2]) for k, r in enumerate(records)]
    known = [(1000, "N3", "n3", None), (1001, "N4", "n4", "7"), (1002, "Other", "other", "2"), (1003, "N5", "n5", "2")][: 4 if seed > 1 else 0]
    old = spark.createDataFrame(known, CUSTOMER)
    out = identity.resolve_customers(spark.createDataFrame(records, RECORD).repartition(3), old)
    got = {r["record_id"]: r["customer_id"] for r in out.collect()}
    assert len(got) == 420 and got == _naive(records, known)
    made = out.where("new_name is not null")
    assert sorted(r["customer_id"] for r in made.collect()) == sorted({c for c in got.values() if c < 0})


def test_backfilled_inn(spark):
    out = identity.resolve_customers(spark.createDataFrame([(1, "Q", None), (2, "Q", "1"), (3, "Q", "2")], RECORD), spark.createDataFrame([], CUSTOMER))
    assert rows(out, "record_id", "new_name", "backfilled_inn") == [(1, "Q", None), (2, None, "1"), (3, None, None)]


def test_backfill_and_ids(spark):
    legacy = spark.createDataFrame([(3, "ООО  A"), (1, "ооо a"), (2, None), (4, "B")], "id int, customer string")
    customers, links = identity.backfill_customers(legacy)
    assert rows(customers, "normalized_name", "name") == [("b", "B"), ("ооо a", "ооо a")] and links.count() == 3
    ids = identity.surrogate_ids(spark.createDataFrame([("x", 5), ("y", 2), ("x", 1)], "name string, pos int"), "name", "pos", 901)
    assert rows(ids, "name", "surrogate_id") == [("x", 901), ("y", 902)]


def test_components(spark):
    links = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "e"), ("f", "f"), *[(f"p{i:02}", f"p{i + 1:02}") for i in range(20)]], "a string, b string")
    found = dict(map(tuple, graph.components(links).collect()))
    assert found["c"] == "a" and found["e"] == "d" and found["f"] == "f" and {v for k, v in found.items() if k[0] == "p"} == {"p00"}


@pytest.mark.parametrize("hot", [False, True])
def test_ordinal_rank(spark, hot):
    data = [(i, float(7 if hot and i % 3 else (i * 37) % 11)) for i in range(500)] + [(1000, None)]
    out = ranking.ordinal_rank(spark.createDataFrame(data, "i int, v double"), "v", "i", "r")
    wanted = [i for i, _ in sorted(data, key=lambda x: (x[1] is not None, x[1] or 0, x[0]))]
    assert [r["i"] for r in sorted(out.collect(), key=lambda r: r["r"])] == wanted
    assert sorted(r["r"] for r in out.collect()) == list(range(1, 502)) and out.columns == ["i", "v", "r"]
    assert ranking.ordinal_rank(spark.createDataFrame([], "i int, v double"), "v", "i", "r").count() == 0


def test_ranks_of_a_hot_value_are_dealt_evenly(spark):
    rows = spark.range(40_000).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 100).otherwise(7).alias("v"))
    parts, before = ranking.in_parts(rows.repartition(8), ["v", "id"])
    sizes = sorted(r["count"] for r in parts.groupBy("_part").count().collect())
    assert before.count() == len(sizes) and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_jobs(spark):
    queued = spark.createDataFrame([(1, 10.0, 1), (2, 200.0, 2), (3, 50.0, 3), (1, 20.0, 4)], "procurement_id int, priority double, seq int")
    latest = jobs.latest_jobs(queued, ["seq"])
    assert tuple(jobs.pop_jobs(latest).select("procurement_id", "priority").first()) == (2, 200.0)
    ties = spark.createDataFrame([(9, 1.0), (10, 1.0)], "procurement_id int, priority double")
    assert jobs.pop_jobs(ties).first()["procurement_id"] == 9
    leases = spark.createDataFrame([("proc:1", datetime(2026, 8, 5, 11, 50)), ("proc:2", datetime(2026, 8, 5, 11, 50)), ("proc:3", datetime(2026, 8, 5, 11, 51))], "member string, claim_time timestamp")
    saved = spark.createDataFrame([("proc:1", 100.0)], "member string, priority double")
    on, back = jobs.recover_leases(leases, saved, F.lit(NOW), 600, 7.0)
    assert rows(on, "member") == [("proc:3",)] and rows(back, "member", "priority") == [("proc:1", 100.0), ("proc:2", 7.0)]
    raw = spark.createDataFrame([('{"procurement_id": 1, "score": 2.5}',), ('{"procurement_id": 1}',), ("junk",), (None,)], "value string")
    assert rows(jobs.parse_results(raw), "procurement_id", "score") == [(1, 2.5)]


def test_alerts(spark):
    cards = spark.createDataFrame([(1, 50.0, "<A>", " "), (2, 150.0, None, "u"), (3, None, "x", None)], "id int, score double, subject string, url string")
    hit = alerts.over_threshold(cards, 100.0)
    assert rows(alerts.alert_messages(hit), "id", "message") == [(2, 'Оценка: 150.0\n<a href="u">u</a>')]
    assert alerts.alert_messages(cards.where("id = 1")).first()["message"] == "Предмет: &lt;A&gt;\nОценка: 50.0"
    assert alerts.outbox(hit, ["none", "telegram", "webhook"]).count() == 2


def test_metrics(spark):
    pairs = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 4.0), (3, 3.0, 3.0)], "item_id int, expected double, predicted double")
    assert rows(metrics.fit_errors(pairs), "n", "mae", "accuracy") == [(3, 0.6667, 0.6667)]
    with pytest.raises(Exception, match="no pairs"):
        metrics.fit_errors(pairs.limit(0)).collect()
    flat = pairs.withColumn("predicted", F.lit(1.0))
    assert metrics.pearson(flat).first()[0] is None and metrics.pearson(pairs.limit(1)).first()[0] is None
    assert metrics.spearman_ordinal(flat).first()[0] == 1.0
    data = spark.createDataFrame([("1", "perfect"), ("2", "far"), ("3", "close"), ("4", "far")], "number string, category string")
    scores = spark.createDataFrame([("1", 5.0), ("2", 5.0), ("3", 1.0)], "number string, score double")
    assert rows(metrics.confusion(data, scores, 2.0), "total", "matched", "tp", "fp", "tn", "fn", "f1") == [(3, 1, 1, 1, 0, 1, 0.5)]
    assert rows(metrics.confusion(data, scores.limit(0), 2.0), "total", "accuracy", "f1") == [(0, 0.0, 0.0)]
    assert metrics.category_balance(data.limit(0)).count() == 0
    assert rows(metrics.category_balance(data), "category", "n", "violation")[0] == ("close", 1, False)
    with pytest.raises(Exception, match="lengths differ"):
        metrics.aligned(pairs.select("item_id", "expected"), pairs.where("item_id > 1").select("item_id", "predicted")).collect()


PAGE = """<div class="list"><div class="card new"><a class="t link" href="/c/1?inn=7701234567">№1</a><span class=p>10,50 ₽<p>x<p>y</div>
<div class='card'><a class="t" href="">№2</a><a class="t" href="/c/9">№9</a></div></div><div id="files"><a href="/f/1">Spec &amp; more</a></div>"""


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "v", None), (3, "w", "")], "page_id long, url string, html string")
    variables = [Variable("number", "a.t"), Variable("href", "a[href]", attribute="href", index=1), Variable("price", ".p", handler="money", default=None), Variable("none", "b", default="d"), Variable("nulled", "a.t", handler="money", default=3.0), Variable("last", "div.list a[href^='/c/9']")]
    out = {r["pos"]: r for r in extract.extract(pages, variables, "div.card").collect()}
    assert len(out) == 2
    assert (out[0]["number"], out[0]["href"], out[0]["none"]) == ("№1", "/c/1?inn=7701234567", "d")
    assert (out[1]["href"], out[1]["price"], out[1]["last"]) == ("/c/9", None, "№9")
    assert out[1]["nulled"] == 2.0
    assert filters.has_link(extract.extract(pages, [Variable("href", "a", "href")], "div.card")).count() == 1
    files = extract.files(pages, "#files a").first()["files"]
    assert [(f["name"], f["url"]) for f in files] == [("Spec & more", "/f/1")]
    assert pages.select(extract.between_markers(F.col("html"), '<div id="files">', "</div>").alias("x")).first()["x"].startswith('<div id="files"><a')
    found = extract.follow(spark.createDataFrame([("v",), ("zz",)], "link string"), pages, F.col("link"))
    assert rows(found, "link", "target_page_id") == [("v", 2), ("zz", None)]


def test_config():
    assert layered({"a": None, "b": 1}, {"a": 2, "b": 3}) == {"a": 2, "b": 1}
    assert redacted({"db": {"dsn": "x", "pool": 5}, "bot_token": "t"}) == {"db": {"pool": 5}}
    with pytest.raises(ValueError, match="platform"):
        require_platforms([])
    assert enabled_sites({"a": True, "b": False, "c": True}, []) == ([], ["a", "c"])


def test_unknown_settings_are_rejected():
    from bidloom.config import Platform, from_settings

    given = {"id": "a", "url": "u", "list_variables": [{"name": "n", "selector": "a"}]}
    assert from_settings(Platform, given) == Platform("a", "u", list_variables=(Variable("n", "a"),))
    for bad, where in (({**given, "urls": 1}, "urls"), ({**given, "list_variables": [{"name": "n", "selektor": "a"}]}, r"list_variables\[0\]\.selektor")):
        with pytest.raises(ValueError, match=where):
            from_settings(Platform, bad)
    assert from_settings(ScoreConfig, {"fit_table": {"62": 1.0}}).fit_table == {"62": 1.0}


def test_backends_can_be_added(spark, monkeypatch):
    monkeypatch.setattr(alerts, "BACKENDS", dict(alerts.BACKENDS))
    cards = spark.createDataFrame([(1, "a", 25000000.0)], "id int, subject string, nmck double")
    alerts.register_backend("mail", lambda columns: F.concat(F.lit("new: "), F.col("subject")))
    out = {r["backend"]: r["payload"] for r in alerts.outbox(cards, ["mail", "telegram", "other", "mail"]).collect()}
    assert out == {"mail": "new: a", "telegram": "Предмет: a\nНМЦК: 25000000.0"}
    assert alerts.active_backends(["mail", "webhook", "none"], {"mail": {"enabled": True}, "webhook": {"enabled": False}}) == ["mail"]
    assert alerts.active_backends("max", {}) == []
    with pytest.raises(ValueError):
        alerts.register_backend("none", lambda columns: F.lit(""))


def test_messages_with_examples(spark):
    examples = [scoring.Example("Один", 9.0, {"a": 'b "c"'}), scoring.Example("Два", 1.5, {}, negative=True)]
    rows_ = spark.createDataFrame([("Д1",), (None,)], "d string")
    first, second = [r[0] for r in rows_.select(scoring.fit_messages("S", examples, F.lit("К"), F.col("d"))).collect()]
    assert [m["role"] for m in first] == ["system", "human", "ai", "human", "ai", "human"]
    assert first[1]["content"] == "[POSITIVE] ОПИСАНИЕ ЗАКУПКИ:\nОдин" and first[3]["content"].startswith("[NEGATIVE]")
    assert first[2]["content"] == '{"reasoning": {"a": "b \\"c\\""}, "fit_score": 9.0}'
    assert first[5]["content"] == "КОМПЕТЕНЦИИ ПОСТАВЩИКА:\nК\n\nОПИСАНИЕ ЗАКУПКИ:\nД1" and second[5]["content"].endswith("ОПИСАНИЕ ЗАКУПКИ:\n")
    judged = rows_.select(scoring.judge_messages("J", F.lit("К"), F.col("d"), F.lit('{"fit_score": 1}'), "Оцени.")).first()[0]
    assert judged[1]["content"].endswith('ОЦЕНКА МОДЕЛИ (JSON):\n{"fit_score": 1}\n\nОцени.') and len(judged) == 2
