import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedloom.operators import changes, reads, resolve, retention
from model import newest, rows_of

LOG = "tx_id bigint, seq bigint, prefix string, key string, value string, ts_id bigint, tombstoned boolean, version bigint"


def log(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in ("tx_id", "seq", "prefix", "key", "value", "ts_id", "tombstoned", "version")) for r in rows], LOG)


def some_rows(seed, n):
    r = random.Random(seed)
    return [
        {"tx_id": i // 4, "seq": i, "prefix": r.choice(["a", "b", "", None]), "key": str(r.randrange(6)), "value": r.choice([None, "", str(i)]), "ts_id": r.randrange(1, 9), "tombstoned": r.random() < 0.3, "version": r.randrange(1, 4)}
        for i in range(n)
    ]


@given(st.integers(0, 10_000), st.integers(0, 40))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_lww_against_model(spark, seed, n):
    rows = some_rows(seed, n)
    got = {(x["prefix"] or "", x["key"]): x["seq"] for x in resolve.lww(log(spark, rows)).collect()}
    assert got == {k: r["seq"] for k, r in newest(rows).items()}


def test_ties_and_nulls(spark):
    rows = [
        (1, 0, None, "k", "first", 5, False, 1),
        (1, 1, "", "k", "last of its commit", 5, False, 1),
        (2, 2, "", "k", "later commit", 5, False, 1),
        (3, 3, "", "n", None, None, None, None),
        (3, 4, "", "n", "dated", 1, None, 1),
    ]
    got = {r["key"]: r["value"] for r in resolve.lww(spark.createDataFrame(rows, LOG)).collect()}
    assert got == {"k": "last of its commit", "n": "dated"}
    assert resolve.lww(spark.createDataFrame([], LOG)).count() == 0


def test_extra_and_clashing_columns(spark):
    df = log(spark, some_rows(1, 30)).withColumns({"__rank": F.lit("mine"), "Rank": F.lit(1)})
    assert set(resolve.lww(df).columns) == set(df.columns)
    assert {r["__rank"] for r in resolve.lww(df).collect()} == {"mine"}


def test_eventual_consistency(spark):
    """hello at 10, hello2 at 11; later puts at 11 and 10 change nothing."""
    state = spark.createDataFrame([(1, 0, "p", "k", "hello", 10, False, 1)], LOG)
    for tx, ts, value, mode in ((2, 11, "hello2", "clobbered"), (3, 11, "hello3", "clobbered"), (4, 10, "fail", "ignored")):
        up = spark.createDataFrame([(tx, 0, "p", "k", value, ts, False, 1 if ts == 10 else 2)], LOG)
        if value == "hello3":
            mode = "ignored"
        assert [r["mode"] for r in resolve.merge_modes(state, up).collect()] == [mode]
        state = state.unionByName(up)
    assert resolve.lww(state).first()["value"] == "hello2"


def test_tombstones_before_resolving_would_come_back(spark):
    df = spark.createDataFrame([(1, 0, "p", "k", "v", 1, False, 1), (2, 1, "p", "k", None, 2, True, 2)], LOG)
    assert resolve.live(resolve.lww(df)).count() == 0
    assert resolve.lww(resolve.live(df)).count() == 1


def test_commit_changes(spark):
    cur = spark.createDataFrame([(1, 0, "p", "a", "1", 5, False, 1), (1, 1, "p", "b", "1", 5, False, 1)], LOG)
    up = spark.createDataFrame([(2, 0, "p", "a", None, 6, True, 2), (2, 1, "p", "b", "0", 4, False, 2), (2, 2, "p", "c", "1", 1, False, 2)], LOG)
    got = {r["key"]: (r["change"], r["old_ts_id"]) for r in resolve.commit_changes(cur, up).collect()}
    assert got == {"a": ("remove", 5), "c": ("apply", None)}
    assert resolve.commit_changes(cur, up, force=True).count() == 3


def test_ranges(spark):
    df = resolve.lww(spark.createDataFrame([(1, i, p, k, "v", 1, False, 1) for i, (p, k) in enumerate([("a", "1"), ("a", "2"), ("b", "1"), (None, "9"), ("", "1")])], LOG))
    keys = lambda d: [(r["prefix"] or "", r["key"]) for r in d.collect()]
    assert keys(reads.scan(df)) == [("", "1"), ("", "9"), ("a", "1"), ("a", "2"), ("b", "1")]
    assert keys(reads.scan(df, reads.KeyRange("a", "2", "b", "1"))) == [("a", "2")]
    assert keys(reads.scan(df, reads.KeyRange(None, "2", "a", "2"))) == [("", "9"), ("a", "1")]
    assert len(keys(reads.scan(df, reads.KeyRange("b", None, "b", None)))) == 5  # a prefix without a key bounds nothing
    with pytest.raises(ValueError):
        reads.scan(df, reads.KeyRange("b", "1", "a", "1"))
    both = [reads.KeyRange("a", "1", "b", ""), reads.KeyRange("a", "2", "c", "")]
    assert [(r["range_id"], r["key"]) for r in reads.multi_range_scan(df, both).collect()] == [(0, "1"), (0, "2"), (1, "2"), (1, "1")]
    assert reads.multi_range_scan(df, []).count() == 0


def test_gets(spark):
    df = spark.createDataFrame([(1, 0, "p", "a", "hello", 3, False, 7), (1, 1, "p", "d", None, 4, True, 8)], LOG)
    assert [tuple(r) for r in reads.multi_get(df, "p", ["d", "x", "a", "a"]).collect()] == [(0, "d", None, -1, -1), (1, "x", None, -1, -1), (2, "a", "hello", 3, 7), (3, "a", "hello", 3, 7)]
    assert [tuple(r) for r in reads.get_raw(df, "p", ["d", "x"]).collect()] == [(0, "d", None, 4, 8, True), (1, "x", None, None, None, None)]
    assert [tuple(r)[1:3] for r in reads.contains_keys(df, "p", ["d", "x", "a"]).collect()] == [("d", False), ("x", False), ("a", True)]
    asks = spark.createDataFrame([(0, "a", 0, 9), (1, "a", 1, 3), (2, "a", 5, 1), (3, "a", 6, 1), (4, "a", 2, 0), (5, "d", 0, 1)], "pos int, key string, offset bigint, length bigint")
    assert [r["slice"] for r in reads.get_offset(df, "p", asks).orderBy("pos").collect()] == ["hello", "ell", None, None, "", None]


def test_counts(spark):
    rows = some_rows(5, 80)
    base, delta = log(spark, rows[:50]), log(spark, rows[50:])
    want = sum(not r["tombstoned"] for r in newest(rows).values())
    assert reads.exact_count(base.unionByName(delta)).first()[0] == want
    both = [{**r, "prefix": r["prefix"] or ""} for r in rows]
    assert reads.delta_count(log(spark, both[:50]), log(spark, both[50:])).first()[0] == want


def test_take_is_cut_between_transactions(spark):
    df = log(spark, some_rows(2, 40))
    got = [r["tx_id"] for r in changes.take_since(df, 1, 5).orderBy("tx_id").collect()]
    assert got == [2] * 4 + [3] * 4
    assert changes.take_since(df, 1, 0).count() == 32
    assert changes.take_since(df, 99, 5).count() == 0
    each = changes.take_each(df.withColumn("part", F.col("tx_id") % 2), ["part"], None, 5)
    assert {(r["part"], r["tx_id"]) for r in each.collect()} == {(0, 0), (0, 2), (1, 1), (1, 3)}


def test_reject_on_first_row_of_a_transaction(spark):
    df = log(spark, some_rows(2, 12))
    assert {r["tx_id"] for r in changes.take_until_rejected(df, -1, F.col("seq") == 4).collect()} == {0}
    assert changes.take_until_rejected(df, -1, F.col("seq") == 0).count() == 0
    assert {r["tx_id"] for r in changes.take_until_accepted(df, -1, F.col("seq") == 4).collect()} == {0, 1}
    assert tuple(changes.took_to_end(df, df.where("tx_id < 2")).first()) == (1, False)
    assert tuple(changes.took_to_end(df, df).first()) == (2, True)


def test_fates(spark):
    rows = [
        (1, 0, "p", "a", "old", 1, False, 1),
        (1, 1, "p", "a", "new", 2, False, 100),
        (1, 2, "p", "a", "new", 2, False, 100),
        (1, 3, "p", "t", None, 3, True, 20),
        (1, 4, "p", "e", "x", 3, False, 5),
        (1, 5, "p", "d", "x", 3, False, 12),
        (1, 6, "p", "n", None, None, None, None),
    ]
    cut = retention.Cutoffs(tombstone_version=30, ttl_version=10, disposal_version=15)
    got = {r["seq"]: r["fate"] for r in retention.classify(spark.createDataFrame(rows, LOG), cut).collect()}
    assert got == {0: "clobber", 1: "keep", 2: "keep", 3: "tombstone", 4: "ttl", 5: "disposal", 6: "keep"}


def test_ages():
    ages = retention.Ages(tombstone_ts=1000, tombstone_ts_interval=100, ttl_version=2000)
    assert ages.cutoffs(10_000) == retention.Cutoffs(9000, 0, 0, 8000 << 12, 0)
    assert ages.cutoffs(10_000, checking=True).tombstone_ts == 8900


def test_should_compact_rounds_down(spark):
    df = spark.createDataFrame([(i, 0, "p", "k", "v", i, False, 1) for i in range(1, 6)], LOG)
    assert not retention.should_compact(df, retention.Cutoffs()).first()["needed"]  # 5 div 2 is not above 2
    assert retention.should_compact(df, retention.Cutoffs(), whole_division=False).first()["needed"]
    assert rows_of(retention.compact(df, retention.Cutoffs()).select("ts_id")) == [(5,)]


def test_absent_and_empty_prefixes_are_one(spark):
    log = spark.createDataFrame([(1, 0, None, "b", "", 1, False, 1), (2, 0, "", "a", "xyz", 1, False, 1), (3, 0, "p", "a", None, 1, True, 1)], "tx_id bigint, seq bigint, prefix string, key string, value string, ts_id bigint, tombstoned boolean, version bigint")
    assert [r["key"] for r in reads.multi_range_scan(log, [reads.KeyRange()]).collect()] == ["a", "b"]
    assert sorted(r["tx_id"] for r in changes.take_prefix_since(log, "", 0).collect()) == [1, 2]
    again = log.where("key = 'b'").withColumns({"prefix": F.lit(""), "tx_id": F.lit(9).cast("bigint"), "ts_id": F.lit(2).cast("bigint")})
    assert reads.delta_count(log, again).first()[0] == 2
    asks = spark.createDataFrame([(i, k, o, n) for i, (k, o, n) in enumerate([("b", 0, 0), ("b", 0, 5), ("b", 1, 5), ("a", 0, 3), ("a", 0, 2), ("a", 2, 9), ("a", 3, 1), ("c", 0, 9), ("a", -1, 1)])], "pos int, key string, offset bigint, length bigint")
    got = [tuple(r)[2:] for r in reads.get_offset(log, None, asks).orderBy("pos").collect()]
    assert got == [("", 1, 1), ("", 1, 1), (None, 1, 1), ("xyz", 1, 1), ("xy", 1, 1), ("z", 1, 1), (None, 1, 1), (None, -1, -1), (None, 1, 1)]
    assert reads.timestamped_get(log, "p", "a").count() == 0 and reads.timestamped_get(log, "", "b").first()["value"] == ""
    assert reads.replica_count(log.where("false").selectExpr("1 AS n")).first()[0] == 0
