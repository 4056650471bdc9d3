"""Every registered query against its SQL on the smallest given tables; without SQL, that it runs."""

import functools
import os

import pytest

import __spark_entry__
from feedloom.plans import store

SF = os.environ.get("FEEDLOOM_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[: -len('.parquet')]} AS SELECT * FROM '{SF}/{f}'")
    return con


def lines(table):
    return sorted(map(str, zip(*[table[c].to_pylist() for c in sorted(table.column_names)])))


@pytest.mark.parametrize("name", sorted(__spark_entry__.queries()))
def test_query(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF).toArrow()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql).to_arrow_table()
        assert sorted(got.column_names) == sorted(want.column_names)
        assert {c: str(got.schema.field(c).type) for c in got.column_names} == {c: str(want.schema.field(c).type) for c in got.column_names}
        assert lines(got) == lines(want)


def test_repair_of_a_log_whose_first_half_is_more_than_may_wait(spark, duck, monkeypatch):
    first = duck.sql("SELECT count(*) FROM feed_rows WHERE delivery_id < (SELECT min(delivery_id) + (max(delivery_id) - min(delivery_id) + 2) // 2 FROM feed_rows)").fetchall()[0][0]
    monkeypatch.setattr(store, "LogStore", functools.partial(store.LogStore, merge_after=first // 2))
    got = __spark_entry__.queries()["store_repair"](spark, SF).toArrow()
    assert lines(got) == lines(duck.sql(__spark_entry__.oracle_sql()["store_repair"]).to_arrow_table())


def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert __spark_entry__.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
