"""Reads, list urls, output, and the streams that enrich and resume."""

import json
import urllib.parse
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bidloom.functions import numbers
from bidloom.operators import extract, identity, reads, scoring
from bidloom.config import ScoreConfig
from bidloom.sources import list_urls, writers
from bidloom.streaming import jobs as streams


def _search(**more):
    return list_urls.Search({"page": "1", "filter": "{filter_json}", "state": "{state_json}", "q": "a b"}, {"typeIn": {"values": [2]}, "need": {"kept": True}}, {"tab": 2}, **more)


def test_query_string(spark):
    m = list_urls.Mapping
    search = _search(criteria_map={"publish_date": m("dates.from"), "okpd2": m("need.paths", "codes"), "fz44": m(query_param="fz44"), "nmck_min": m("low", "low"), "nmck_max": m("high"), "other": m("x"), "own": m("own")})
    criteria = list_urls.Criteria(cutoff=F.lit(datetime(2026, 8, 3, 21)), okpd_paths=F.array(F.lit("x.y."), F.lit("a.b.")), fz44=F.lit(True), nmck_min=F.lit(2.5), nmck_max=F.lit(None).cast("double"))
    with pytest.warns(UserWarning, match="other"):
        text = spark.range(1).select(list_urls.query_string(search, criteria, {"own": lambda c, s: F.lit('say "a"')})).first()[0]
    got = dict(urllib.parse.parse_qsl(text))
    assert json.loads(got["filter"]) == {"typeIn": {"values": [2]}, "need": {"kept": True, "paths": ["x.y.", "a.b."]}, "dates": {"from": "04.08.2026 00:00:00"}, "low": 2.5, "own": 'say "a"'}
    assert (json.loads(got["state"]), got["q"], got["codes"], got["fz44"], got["low"]) == ({"tab": 2}, "a b", "x.y.,a.b.", "on", "2.5") and "q=a%20b" in text
    bare = spark.range(1).select(list_urls.query_string(search := _search(criteria_map={"publish_date": m("dates.from"), "fz44": m(query_param="fz44"), "okpd2": m("paths")}), list_urls.Criteria(fz44=F.lit(False), okpd_paths=F.array().cast("array<string>")))).first()[0]
    assert json.loads(dict(urllib.parse.parse_qsl(bare))["filter"]) == {"typeIn": {"values": [2]}, "need": {"kept": True}} and "fz44" not in bare
    both = _search(criteria_map={"nmck_min": m("from", "price"), "nmck_max": m("to", "price"), "okpd2": m(query_params={"okpd2Ids": "{okpd2_ids}", "okpd2IdsCodes": "{okpd2_codes}"})})
    lit = lambda v: F.lit(v).cast("double")
    for low, high, ids, wanted in ((25000000.0, 12345678.5, "8873937,8873938", "&price=12345678.5&okpd2Ids=8873937%2C8873938"), (0.0001, None, None, "&price=0.0001"), (None, 2e7, "", "&price=20000000")):
        text = spark.range(1).select(list_urls.query_string(both, list_urls.Criteria(nmck_min=lit(low), nmck_max=lit(high), okpd_ids=F.lit(ids).cast("string")))).first()[0]
        assert text.endswith(wanted) and ("25000000.0" in text) == (low == 25000000.0)
    off = list_urls.Search(enabled=False)
    assert [spark.range(1).select(list_urls.list_url("https://x.ru//", "/list", s, list_urls.Criteria())).first()[0] for s in (None, off)] == ["https://x.ru/list"] * 2
    assert search.filter_json == {"typeIn": {"values": [2]}, "need": {"kept": True}}  # not changed


def test_reads(spark):
    cards = spark.createDataFrame([(1, "a", "p", None, datetime(2026, 8, 1)), (2, "b", "p", "http://x/y", None), (3, "c", "q", "d/Тз.zip", datetime(2026, 8, 2)), (4, "d", "q", "d/plain", None)], "id int, number string, source_platform string, technical_spec_url string, update_date timestamp")
    assert [r["number"] for r in reads.by_id(cards, 2).collect()] == ["b"] and reads.by_id(cards, 9).count() == 0
    asked = spark.createDataFrame([("a", "p"), ("a", "q")], "number string, source_platform string")
    assert sorted(map(tuple, reads.known(cards, asked).collect())) == [("a", "p", True), ("a", "q", False)]
    out = {r["id"]: r for r in reads.spec_downloads(cards).collect()}
    assert [(out[i]["status"], out[i]["file_name"], out[i]["media_type"]) for i in (1, 2, 3, 4)] == [(404, None, None), (302, None, None), (200, "Тз.zip", "application/zip"), (200, "plain", "application/octet-stream")]
    assert out[3]["disposition"] == "attachment; filename=\"%D0%A2%D0%B7.zip\"; filename*=UTF-8''%D0%A2%D0%B7.zip"
    assert reads.page_signature(cards, 3).first()[0] == "4:4@,3@2026-08-02T00:00:00,2@"
    customers = spark.createDataFrame([(7, "Who")], "id int, name string")
    view = reads.detail_view(cards.withColumn("customer_id", F.lit(7)), customers)
    assert view.columns == [*reads.CARD_FIELDS, "detail_json"] and view.first()["customer"] == "Who"
    texts = spark.createDataFrame([(0, "с 01.08.2026 до"), (1, "?"), (2, "с 03.08.2026"), (3, "с 01.08.2026"), (4, None)], "pos int, dates string")
    assert [r["pos"] for r in reads.newest_first(texts, "dates", "pos").collect()] == [2, 0, 3, 1, 4]
    with pytest.raises(ValueError, match="order"):
        reads.require_order("price_asc")
    new = reads.migrated(cards, "number string, id bigint, note string", {"note": F.lit("n")})
    assert tuple(new.orderBy("id").first()) == ("a", 1, "n") and reads.last_identity(new.limit(0)).first()[0] == 1


def test_shown_values_and_json(spark, tmp_path):
    values = spark.createDataFrame([(1234567.5,), (1000.0,), (0.125,), (None,)], "v double")
    assert [r[0] for r in values.select(numbers.shown_number("v")).collect()] == ["1\u00a0234\u00a0567,5", "1\u00a0000", "0,125", None]
    rows = spark.createDataFrame([(1, datetime(2026, 8, 5, 12))], "id int, at timestamp")
    assert json.loads(rows.select(writers.iso_json(F.struct("id", F.array("at").alias("at")))).first()[0]) == {"id": 1, "at": ["2026-08-05T12:00:00"]}
    writers.write_dataset(rows, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).first()["at"] == "2026-08-05T12:00:00"


def test_existing_score_stays(spark):
    cards = spark.createDataFrame([(1, "62.01", 100.0, None, 5.0, "external"), (2, "62.01", 100.0, None, None, None)], "id int, okpd2_codes string, nmck double, deadline timestamp, score double, score_method string")
    out = scoring.default_scores(cards, F.lit(datetime(2026, 8, 5)), ScoreConfig())
    assert sorted((r["id"], r["score"], r["score_method"]) for r in out.collect()) == [(1, 5.0, "external"), (2, 90.0, "default")]


def test_append_customers(spark):
    known = spark.createDataFrame([(1, "A", "a", 5.0)], "id long, name string, normalized_name string, rating double")
    asked = spark.createDataFrame([(3, "b  B"), (1, " A "), (2, "C"), (4, "B b"), (5, ""), (6, None), (7, "B B")], "id long, name string")
    after, ids = identity.append_customers(known, asked, 10)
    assert sorted(map(tuple, after.collect())) == [(1, "A", "a", 5.0), (10, "C", "c", None), (11, "b  B", "b b", None)]
    assert sorted(map(tuple, ids.collect())) == [("a", 1), ("b b", 11), ("c", 10)]


def test_list_pages(spark):
    page = lambda more: f"<div class='x'><a class='org' href='/o/1'>O</a></div>{more}"
    rows = [(1, "u", page("<a class='next' href='?2'>n</a>"), "l", 1), (2, "u", page(""), "l", 2), (3, "u", page(""), "l", 3), (4, "u", "<p>no link", "m", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, list string, page_no int")
    assert sorted(map(tuple, extract.first_link(pages, "div.x a.org", F.lit("https://p.ru/")).collect()), key=repr) == [(1, "https://p.ru/o/1"), (2, "https://p.ru/o/1"), (3, "https://p.ru/o/1"), (4, None)]
    assert sorted(r["page_id"] for r in extract.until_last(pages, "list", "page_no", "a.next").collect()) == [1, 2, 4]


def test_passes_follow_one_another(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "p")], "id long, number string, source_platform string")
    rows.write.parquet(str(tmp_path / "in"))
    query = streams.insert_new_cards(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "cp"), period="1 second")
    try:
        query.processAllAvailable()
        assert query.isActive and spark.read.parquet(str(tmp_path / "store")).count() == 1
    finally:
        query.stop()
