"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from bidloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    out = catalogue.QUERIES[name](spark, SF).toPandas()
    sql = catalogue.ORACLE_SQL.get(name)
    if sql is None:
        assert len(out)
        return
    wanted = duck.sql(sql).df()
    columns = sorted(out.columns)
    assert columns == sorted(wanted.columns)
    assert normal(out, columns) == normal(wanted, columns)


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
