"""Column functions against fixed vectors."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bidloom.functions import handlers as H
from bidloom.functions import numbers as N
from bidloom.functions import text as T

NB = " "


def one(spark, column, **values):
    row = {k: v for k, v in values.items()}
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "value", "wanted"),
    [
        ("money", f"3{NB}250,00 ₽", 3250.0),
        ("money", "186 000,00 ₽", 186000.0),
        ("money", None, None),
        ("money", "1.2.3", None),
        ("money", "", None),
        ("float", " 1.5 ", 1.5),
        ("float", "1,5", None),
        ("float", "1d", None),
        ("int", "1 234", 1234),
        ("int", "3.7", None),
        ("int", "3,5", None),
        ("strip", None, ""),
        ("strip", f"\t{NB} a b \n", "a b"),
        ("lower", " ПРИВЕТ ", "привет"),
        ("date_iso", "06.08.2026", "2026-08-06T00:00:00"),
        ("date_iso", "05.08.2026 10:00", "2026-08-05T10:00:00"),
        ("date_iso", "6.8.2026", "2026-08-06T00:00:00"),
        ("date_iso", "2026-08-06T01:02:03", "2026-08-06T01:02:03"),
        ("date_iso", "soon", None),
        ("law", "Закупка по 44-ФЗ и 223-ФЗ", "44-ФЗ"),
        ("law", "ЕЭТП B2B", None),
        ("security", "10 %", 10.0),
        ("security", "3 600 239,70 Российский рубль (12,5 %)", 3600239.7),
        ("security", f"3{NB}600{NB}239,70 руб", 3600239.7),
        ("security", "нет", None),
        ("security_unit", "10 %", "%"),
        ("security_unit", "3 600 239,70 Российский рубль (12,5 %)", "руб."),
        ("security_unit", "нет", None),
        ("unknown", "as is", "as is"),
        ("", "as is", "as is"),
    ],
)
def test_handlers(spark, name, value, wanted):
    assert one(spark, H.apply_handler(name, "c"), c=value) == wanted


def test_dated_handlers(spark):
    text = "с 04.08.2026 до 12.08.2026 9:30 (МСК)"
    assert one(spark, F.date_format(H.pub_date("c"), "yyyy-MM-dd HH:mm"), c=text) == "2026-08-03 21:00"
    assert one(spark, F.date_format(H.deadline("c"), "yyyy-MM-dd HH:mm"), c=text) == "2026-08-12 06:30"
    assert one(spark, H.pub_date("c"), c="с 99.99.2026") is None
    assert one(spark, F.date_format(H.date("c"), "yyyy-MM-dd HH:mm"), c=" 5.8.2026 ") == "2026-08-04 21:00"
    assert one(spark, H.date("c"), c="05.08.2026 10:00") is None
    assert one(spark, H.regex("c", r"№(\d+)"), c="№77 a") == "77"
    assert one(spark, H.regex("c", None), c="№77 a") is None


def test_date_range_round_trip(spark):
    rows = spark.createDataFrame([(datetime(2026, 8, 4), datetime(2026, 8, 12, 15, 5))], "p timestamp, u timestamp")
    text = rows.select(H.date_range_text("p", "u").alias("t"))
    assert text.first()["t"] == "с 04.08.2026 до 12.08.2026 15:05 (МСК)"
    assert text.select(F.date_format(H.deadline("t"), "dd HH:mm").alias("x")).first()["x"] == "12 12:05"


@pytest.mark.parametrize(("value", "wanted"), [("ООО\tРомашка\nПлюс", "ооо ромашка плюс"), ("   ", ""), (None, ""), (f" ООО{NB} X ", "ооо x")])
def test_normalize_name(spark, value, wanted):
    assert one(spark, T.normalize_name("c"), c=value) == wanted


def test_inn(spark):
    assert one(spark, T.inn_from_link("c"), c="/org?inn=7701234567&x=1") == "7701234567"
    assert one(spark, T.inn_from_text("c"), c="Реквизиты Инн/кпп: 770123456789") == "770123456789"
    assert one(spark, T.inn_from_text("c"), c="ИНН " + "x" * 21 + "7701234567") is None
    assert one(spark, T.resolve_inn("c", r"inn=(\d{10,12})", "p"), c="/org", p="ИНН 7701234567") == "7701234567"
    assert one(spark, T.resolve_inn("c", None, None), c="/org?inn=7701234567") is None


def test_urls(spark):
    assert one(spark, T.absolute_url("c", F.lit("https://a/")), c="/x") == "https://a/x"
    assert one(spark, T.absolute_url("c", F.lit("https://a/")), c="http://b") == "http://b"
    assert one(spark, T.files_page_url("c", "documents.html"), c="https://a/b/common.html?id=1/2") == "https://a/b/documents.html?id=1/2"
    assert one(spark, T.percent_encode("c"), c="a b*~é/") == "a%20b%2A~%C3%A9%2F"
    assert one(spark, T.html_escape("c"), c="<a & 'b'>\"") == "&lt;a &amp; &#39;b&#39;&gt;&quot;"
    for bad in ("javascript:x", "//host/x", "", "http:///x"):
        assert one(spark, T.safe_file_url("c"), c=bad) is None
    for good in ("https://a/b", "/files/1", "x.pdf"):
        assert one(spark, T.safe_file_url("c"), c=good) == good
    assert one(spark, T.mask_dsn("c"), c="postgresql://u:secret@h:5432/d") == "postgresql://u:***@h:5432/d"
    assert one(spark, T.bem_classes("c"), c="div.a .card__x.card__y > .card__x") == ["card__x", "card__y"]
    assert one(spark, T.first_class("c", "z"), c="div") == "z"


def test_numbers(spark):
    for value in (2.675, 1.005, 0.125, -2.675, 123.456789, 1e15 + 0.3, 0.0):
        assert one(spark, N.round_half("c"), c=value) == round(value, 2)
    assert one(spark, N.money_text("c"), c=1234567.891) == f"1{NB}234{NB}567,89 ₽"
    words = [one(spark, N.plural("c", "a", "b", "c"), c=n) for n in (1, 2, 5, 11, 14, 21, 22, 111, 0)]
    assert words == ["a", "b", "c", "c", "c", "a", "b", "c", "c"]
    assert one(spark, N.query_text("c", "double"), c=5.0) == "5"
    assert one(spark, N.query_text("c", "double"), c=5.5) == "5.5"
    assert [one(spark, N.retry_delay("c", 1, 10), c=n) for n in (1, 2, 4, 9)] == [1.0, 2.0, 8.0, 10.0]


def test_plain_text_is_the_shortest(spark):
    """As Python's str of floats, over all magnitudes."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    hard = [0.0, -0.0, 1e16, 1e15, 9999999999999998.0, 1e-4, 1e-5, 0.00012, 123456789012345680.0, 1e22, 1e23, 2e23, 8.41e21, 5e-324, 1.7976931348623157e308, 25000000.0, 12345678.5, 1e7, 1e-3]
    hard += [float("nan"), float("inf"), -float("inf"), 2.2250738585072014e-308, -7.185939415176897e18, 2.0691299989270937e25, 2.0**63, 2.0**53, 1e36, 9.9e36, 1e37]
    values = np.concatenate([rng.integers(0, 2**64, 60_000, dtype=np.uint64).view(np.float64), 10 ** rng.uniform(-8, 26, 60_000), np.round(10 ** rng.uniform(0, 14, 30_000), 2), hard])
    out = spark.createDataFrame(pd.DataFrame({"x": values})).select("x", N.plain_text("x").alias("t")).toPandas()
    assert out["t"].tolist() == [repr(x) for x in out["x"].tolist()]
    assert spark.range(1).select(N.plain_text(F.lit(None).cast("double"))).first()[0] is None


def test_shown_values_by_type(spark):
    from datetime import datetime
    from decimal import Decimal

    rows = spark.createDataFrame(
        [(25000000.0, True, datetime(2026, 8, 5, 9, 0), datetime(2026, 8, 5, 9, 0, 1, 500), " x ", 7, Decimal("1.50")), (None, None, None, None, " ", None, None)],
        "d double, f boolean, t timestamp, n timestamp_ntz, s string, i long, m decimal(9,2)",
    )
    out = [r[0] for r in rows.select(T.as_texts(*rows.columns)).collect()]
    assert out == [["25000000.0", "True", "2026-08-05T09:00:00+00:00", "2026-08-05T09:00:01.000500", "x", "7", "1.50"], [None] * 7]
    assert rows.select(T.as_text("d")).first()[0] == "25000000.0"
    told = """{"a": 1, "b": 2.50, "c": "2.5E7", "d": 2.5E7, "e": null, "f": true, "g": 12345678901234567890123.5, "h": " "}"""
    texts = spark.range(1).select(T.json_texts(F.lit(told), *"abcdefghi")).first()[0]
    assert texts == ["1", "2.5", "2.5E7", "25000000.0", None, "True", "1.2345678901234568e+22", None, None]
    assert spark.range(1).select(T.json_texts(F.lit("no json"), "a")).first()[0] in (None, [None])
