import random

import pytest
from pyspark.sql import functions as F

from feedloom.client import Engine, StringMap, puts, removes
from feedloom.functions.keys import norm_prefix
from feedloom.operators import differential as diff
from feedloom.operators import changes, reads, retention
from feedloom.operators.delete_vectors import DeleteVectorTable
from feedloom.operators.identifier_index import IdentifierIndex
from feedloom.operators.resolve import lww
from feedloom.operators.retention import Cutoffs
from feedloom.schema import LOG
from feedloom.sources import shared
from feedloom.sources.generate import random_log
from feedloom.sources.log_store import LogStore
from feedloom.sources.sync_configs import SyncConfigs
from feedloom.streaming import feeds
from model import newest, rows_of


def b(n):
    return n.to_bytes(4, "big", signed=True)


def test_delta_lifecycle(spark, folder):
    """put at 2 is seen, put at 1 is ignored, delete at 3 removes; the count stays until it is purged."""
    p = Engine(spark, folder).create("test")
    pre = b(-1)
    p.commit("none", pre, puts((b(1), b(10), 2)))
    assert bytes(p.get("none", pre, [b(1)]).first()["value"]) == b(10)
    assert p.commit("none", pre, puts((b(1), b(11), 1))).count() == 0
    assert bytes(p.get("none", pre, [b(1)]).first()["value"]) == b(10)
    p.store.merge()
    assert [r["change"] for r in p.commit("none", pre, removes((b(1), 3))).collect()] == ["remove"]
    row = p.get_raw("none", pre, [b(1)]).first()
    assert row["tombstoned"] and row["value"] is None and row["ts_id"] == 3
    assert not p.contains("none", pre, [b(1)]).first()["contained"]
    assert p.approximate_count() == 2 and p.count() == 0
    stats = p.store.compact(Cutoffs(tombstone_ts=4))
    assert (stats["clobbers"], stats["tombstones"], stats["keeps"]) == (1, 1, 0)
    assert p.store.log().count() == 0 and p.approximate_count() == 0


def test_prefix_feed_before_and_after_merge(spark, folder):
    p = Engine(spark, folder).create("test")
    for i in range(1, 5):
        p.commit("none", b"a", puts((b(i), b(100 + i), 1000 + i)))
        p.commit("none", b"b", puts((b(i), b(200 + i), 2000 + i)))
    for _ in range(2):
        got = p.take(prefix=b"a").orderBy("tx_id", "seq").collect()
        assert [bytes(r["value"]) for r in got] == [b(100 + i) for i in range(1, 5)]
        last = got[1]["tx_id"]
        assert p.take(last, prefix=b"a").count() == 2
        p.store.merge()
    assert [bytes(r["key"]) for r in p.scan("none", [reads.KeyRange(b"a", b(2), b"b", b(2))]).collect()] == [b(2), b(3), b(4), b(1)]
    assert p.scan_prefix("none", b"b").count() == 4


def test_commit_rules(spark, folder):
    p = Engine(spark, folder).create("test", merge_after=3)
    p.commit("none", None, puts((b"k", b"first", 5), (b"k", b"last", 5), (b"j", b"older", 7), (b"j", b"newer", 8)))
    got = {bytes(r["key"]): bytes(r["value"]) for r in p.scan("none").collect()}
    assert got == {b"k": b"last", b"j": b"newer"}
    p.commit("none", b"", puts((b"k", b"clock")))
    row = p.get("none", None, [b"k"]).first()
    assert bytes(row["value"]) == b"clock" and row["ts_id"] > 10**12
    with pytest.raises(Exception, match="key"):
        p.commit("none", None, [(None, b"v", 1, False)])
    store = LogStore(spark, f"{folder}/full", merge_after=1)
    up = spark.createDataFrame(puts((b"a", b"1", 1), (b"b", b"1", 1)), "key binary, value binary, ts_id bigint, tombstoned boolean")
    store.commit(up)
    with pytest.raises(RuntimeError):
        store.commit(up)
    assert store.mergeable()
    store.merge()
    store.commit(up, force=True)


def test_damaged_manifest_is_passed_over(spark, folder):
    store = LogStore(spark, folder)
    up = lambda v: spark.createDataFrame(puts((b"a", v, 1)), "key binary, value binary, ts_id bigint, tombstoned boolean")
    store.commit(up(b"1"))
    store.commit(up(b"2"))
    last = store.manifest()["version"]
    shared.write_text(spark, f"{folder}/manifest/{last}", shared.read_text(spark, f"{folder}/manifest/{last}").replace('"n": 1', '"n": 3'))
    assert store.manifest()["version"] == last - 1
    assert [bytes(r["value"]) for r in store.state().collect()] == [b"1"]
    store.commit(up(b"3"))  # goes behind the damaged one
    assert store.manifest()["version"] == last + 1
    assert [bytes(r["value"]) for r in store.state().collect()] == [b"3"]


def test_a_commit_during_another_and_during_compaction_is_kept(spark, folder, monkeypatch):
    up = lambda k: spark.createDataFrame(puts((k, b"v", 1)), "key binary, value binary, ts_id bigint, tombstoned boolean")
    one, two = LogStore(spark, folder), LogStore(spark, folder)
    one.commit(up(b"a"))
    plain, came = LogStore._store, []

    def slow(self, rows, tx):
        entry = plain(self, rows, tx)
        if self is one and not came:
            came.append(two.commit(up(b"b")))  # another writer is quicker
        return entry

    monkeypatch.setattr(LogStore, "_store", slow)
    one.commit(up(b"c"))
    assert sorted(bytes(r["key"]) for r in one.state().collect()) == [b"a", b"b", b"c"]
    blocks = shared.blocks_for
    monkeypatch.setattr(shared, "blocks_for", lambda df: (two.commit(up(b"d")), blocks(df))[1])
    one.compact()
    now = one.manifest()
    assert now["base"] and now["pending"] == 1
    assert sorted(bytes(r["key"]) for r in one.state().collect()) == [b"a", b"b", b"c", b"d"]


def test_take_opens_only_what_can_hold_later_transactions(spark, folder):
    store = LogStore(spark, folder)
    rows = [(t, 0, None, b"k%d" % t, b"v", 1, False, 1, "primary") for t in range(1, 200)]
    store.append(spark.createDataFrame(rows[:150], LOG))
    store.merge()
    store.append(spark.createDataFrame(rows[150:], LOG))
    for since in (-1, 0, 100, 148, 149, 150, 170, 199):
        log = store.rows(since)
        assert sorted(r["tx_id"] for r in changes.take_since(log, since).collect()) == [t for t in range(1, 200) if t > since]
    assert store.rows(150).count() == 49  # the base isn't read
    assert store.rows(148).where("tx_id <= 150").count() <= 3  # of the base one folder
    assert store.append(spark.createDataFrame(rows[140:], LOG)) == 0  # a repeated batch adds nothing


def test_replicas(spark, folder):
    engine = Engine(spark, folder)
    engine.create("p", consistency="quorum")
    held = engine.replicas("p", ["a", "b", "c"])
    held.commit("quorum", None, puts((b"x", b"1", 5), (b"y", b"1", 5)))
    held.down = {"c"}
    held.commit("quorum", None, puts((b"x", b"2", 6)))
    held.down = {"b", "c"}
    with pytest.raises(RuntimeError):
        held.commit("quorum", None, puts((b"x", b"3", 7)))
    with pytest.raises(RuntimeError):
        held.get("quorum", None, [b"x"])
    held.down = {"a"}
    got = {bytes(r["key"]): r["value"] and bytes(r["value"]) for r in held.get("quorum", None, [b"x", b"y", b"z"]).collect()}
    assert got == {b"x": b"2", b"y": b"1", b"z": None}
    assert [bytes(r["value"]) for r in held.scan("quorum").collect()] == [b"2", b"1"]
    take = held.take(["a", "c"])
    assert take.member == "c" and take.rows.count() == 2 and take.highwaters["a"] == take.cursors["c"]
    more = held.take(["c"], take.cursors)
    assert more.rows.count() == 0 and more.cursors == take.cursors
    assert held.pull("c", "b") == 1 and held.pull("c", "b") == 0
    part = held.take(["b"], {}, limit=1)
    assert part.rows.count() == 2 and part.highwaters is None  # both rows of the first transaction, and more to come
    held.down = set()
    assert held.approximate_count() >= 2
    led = Engine(spark, folder).replicas("p", ["a", "b", "c"], "a")
    led.down = {"a"}
    with pytest.raises(ValueError):
        led.get("leader", None, [b"x"])
    assert [bytes(r["value"]) for r in led.get("leader_quorum", None, [b"x"]).collect()] == [b"2"]


def test_replica_keeps_what_is_newer(spark, folder):
    store = LogStore(spark, f"{folder}/r")
    store.commit(spark.createDataFrame(puts((b"k", b"mine", 9)), "key binary, value binary, ts_id bigint, tombstoned boolean"))
    rows = [(1, 0, None, b"k", b"old", 5, False, 1, "primary"), (2, 0, None, b"j", b"new", 5, False, 1, "primary")]
    spark.createDataFrame(rows, LOG).write.parquet(f"{folder}/s")
    feeds.replicate(feeds.log_stream(spark, f"{folder}/s"), store, f"{folder}/c", "m", resolve=True).awaitTermination()
    assert {bytes(r["key"]): bytes(r["value"]) for r in store.rows().collect()} == {b"k": b"mine", b"j": b"new"}
    assert store.highwater("m") == 2
    store.clear_highwater("m")
    assert store.highwater("m") == -1


def test_ages_wait_for_their_interval(spark, folder):
    engine = Engine(spark, folder)
    p = engine.create("p", ttl_age_ms=1000, ttl_interval_ms=500)
    p.commit("none", None, puts((b"a", b"1", 10_000), (b"b", b"1", 50_000)))
    assert p.compact(now_ms=11_200) is None  # older than the age, but not by the interval yet
    told = p.compact(now_ms=11_600)
    assert told["ttls"] == 1 and told["keeps"] == 1 and told["bytes_before"] > 0
    assert engine.migrate("p", "noop_persistent").store.log_only


def test_engine(spark, folder):
    e = Engine(spark, folder)
    p = e.create("part", consistency="leader_all", require_consistency=True, row_type="snappy_primary", ttl_age_ms=1000)
    with pytest.raises(ValueError):
        p.commit("quorum", None, puts((b"a", b"1")))
    with pytest.raises(ValueError):
        e.create("bad", replicated=False, consistency="quorum")
    p.commit("leader_all", None, puts((b"a", b"1", 5000), (b"b", b"1", 9500)))
    assert p.compact(10_000)["ttls"] == 1
    assert p.compact(10_000) is None
    p = e.mark_for_disposal("part")
    assert p.scan("leader").count() == 0 and p.take().count() == 0
    p.commit("leader_all", None, puts((b"c", b"1", 1)))
    assert p.scan("leader").count() == 1
    assert [r["contained"] for r in p.contains("leader", None, [b"b", b"c"]).collect()] == [False, True]
    p = e.abandon_version("part")
    assert p.scan("leader").count() == 0
    assert e.compost() == ["part/v1"]
    e.destroy("part")
    assert e.names() == []


def test_log_only_partition_answers_takes_alone(spark, folder):
    p = Engine(spark, folder).create("log", index_class_name="noop_persistent")
    p.commit("none", None, puts((b"a", b"1", 1)))
    assert p.scan("none").count() == 1
    p.store.merge()
    assert p.scan("none").count() == 0 and p.get("none", None, [b"a"]).first()["ts_id"] == -1
    assert p.take().count() == 1


def test_string_map(spark, folder):
    m = StringMap(Engine(spark, folder).create("m"))
    m.put(a="1", b="2", é="ü")
    m.remove("b")
    assert m.get("a", "b", "é", "x") == {"a": "1", "é": "ü"}
    assert [tuple(r) for r in m.all().collect()] == [("a", "1"), ("é", "ü")]


def test_random_updates_agree_on_all_replicas(spark, folder):
    """100 random puts and deletes over 10 keys; the log replicated in steps holds the same rows."""
    r = random.Random(7)
    e = Engine(spark, folder)
    p = e.create("source")
    for _ in range(5):
        ups = [(str(r.randrange(10)).encode(), str(r.randrange(99)).encode(), r.randrange(1, 99), False) if r.random() < 0.5 else (str(r.randrange(10)).encode(), None, r.randrange(1, 99), True) for _ in range(20)]
        p.commit("none", b"a", ups)
    replica = LogStore(spark, f"{folder}/replica")
    stream = feeds.log_stream(spark, f"{folder}/source/v1/data/*", max_files=2)
    for _ in range(2):  # the second run finds nothing new
        feeds.replicate(stream, replica, f"{folder}/check").awaitTermination()
    fields = lambda s: sorted((bytes(x["key"]), x["ts_id"], x["tombstoned"], x["version"], x["value"] and bytes(x["value"])) for x in s.collect())
    assert fields(p.store.state()) == fields(replica.state())
    p.store.compact()
    replica.merge()
    assert fields(p.store.state()) == fields(replica.state())


def test_sync_keeps_cursors(spark, folder):
    def rows(start, n):
        return [(i, 0, None, b(i), b(i), i, False, i, "primary") for i in range(start, start + n)]

    target = LogStore(spark, f"{folder}/t")
    for k, (last, kept) in enumerate(((10, 5), (20, 15))):
        spark.createDataFrame(rows(1 + 10 * k, 10), LOG).write.mode("append").parquet(f"{folder}/s")
        stream = feeds.log_stream(spark, f"{folder}/s").withColumn("replica", F.lit("m"))
        feeds.sync(stream, target, f"{folder}/c", f"{folder}/check", from_ts=5, shift_ms=100).awaitTermination()
        assert tuple(feeds.read_cursors(spark, f"{folder}/c").first()) == ("m", last, last, last)
        assert target.rows().count() == kept
    assert target.rows().agg(F.min("ts_id")).first()[0] == 106


def test_watch_sees_every_commit(spark, folder):
    seen = []
    spark.range(5).write.parquet(f"{folder}/s")
    stream = spark.readStream.schema("id bigint").parquet(f"{folder}/s")
    feeds.watch(stream, lambda rows, n: seen.extend(r[0] for r in rows.collect()), f"{folder}/check").awaitTermination()
    assert sorted(seen) == list(range(5))


def test_streams_equal_batch(spark, folder):
    r = random.Random(11)
    cut = {"x": 5_000_000, "y": None}
    txs = [i // 2 for i in range(120)]
    r.shuffle(txs)  # transactions come in disorder
    rows = [(i, p := r.choice("xxy"), txs[i], r.randrange(1, 20_000_000), cut[p], r.choice(["k", "l"]), i % 40) for i in range(120)]
    schema = "id bigint, p string, tx bigint, t bigint, cut bigint, prefix string, dup bigint"
    df = spark.createDataFrame(rows, schema)
    keys = {"p": F.col("p"), "hour": F.col("t") - F.col("t") % 3_600_000}
    state = feeds.DifferentialState(spark, f"{folder}/d", ["id"], ["p"], keys, "tx", "t", "cut")
    table = DeleteVectorTable(spark, f"{folder}/v", {"p": F.col("p"), "prefix": norm_prefix("prefix")}, ["t"], ["tx"])
    index = IdentifierIndex(spark, f"{folder}/i", [F.col("dup")], "id")
    for part in range(3):
        df.where((F.col("id") >= 40 * part) & (F.col("id") < 40 * part + 40)).coalesce(1).write.mode("append").parquet(f"{folder}/s")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/s")
        state.follow(stream, f"{folder}/c1").awaitTermination()
        feeds.apply_changes(stream, table, f"{folder}/c2").awaitTermination()
        feeds.drop_repeats(stream, index, f"{folder}/c3").awaitTermination()
    told, deltas = diff.late_corrected(*[df.withColumn("v", F.expr("id div 40 + 1"))] * 2, ["p"], "tx", "t", "cut", "v", 3, keep=["p"])
    assert sorted((x["p"], x["hour"], x["sign"], x["n"]) for x in state.deltas().collect()) == sorted((x["p"], x["period_start"], x["sign"], x["n"]) for x in deltas.collect())
    assert any(s["sign"] < 0 for x in told.collect() for s in x["signs"])
    state.apply(df, 7)  # every message again: each counts once
    assert state.spark.read.parquet(f"{folder}/d/deltas/7").count() == 0
    want = {(x["p"], x["h"]): x["n"] for x in told.where("lateness != 'too_late'").groupBy("p", (F.col("t") - F.col("t") % 3_600_000).alias("h")).agg(F.count("*").alias("n")).collect()}
    assert {(x["p"], x["hour"]): x["n"] for x in state.state().collect()} == want
    assert {(x["p"], x["hour"]): x["n"] for x in diff.fold(state.deltas(), ["p", "hour"], ["n"]).collect()} == want
    assert told.where("lateness = 'too_late'").count() > 0
    assert table.read().count() == df.select("p", "prefix").distinct().count()
    assert sorted(x[0] for x in index.kept().collect()) == list(range(40))
    state.apply(df, 2)  # taken in before: skipped
    assert {(x["p"], x["hour"]): x["n"] for x in state.state().collect()} == want


def test_repair_drops_torn_commits(spark, folder):
    store = LogStore(spark, folder)
    for i in range(3):
        store.commit(spark.createDataFrame(puts((b"k%d" % i, b"v", 1)), "key binary, value binary, ts_id bigint, tombstoned boolean"))
    assert store.validate() == []
    shared.remove(spark, f"{folder}/{store.manifest()['commits'][1]['path']}")
    assert len(store.validate()) == 1
    assert store.repair() == 2 and store.validate() == [] and store.repair() == 0
    assert [bytes(r["key"]) for r in store.state().collect()] == [b"k0"]


def test_row_types_and_marks(spark, folder):
    rows = [(1, 0, None, b"k", b"v", 1, False, 1, "primary"), (1, 1, None, b"member-1", b"77", 0, False, 0, "highwater"), (1, 2, None, b"x", None, 0, False, 0, "system"), (2, 0, None, b"", None, 0, False, 0, "end_of_merge")]
    df = spark.createDataFrame(rows, LOG)
    assert [tuple(r) for r in changes.marks(df).collect()] == [(1, "member-1", 77)]
    assert changes.data_rows(df).count() == 1
    store = LogStore(spark, folder)
    store.append(df)
    store.compact(row_type="snappy_primary")
    assert sorted(r["row_type"] for r in store.log().collect()) == ["end_of_merge", "highwater", "snappy_primary"]


def test_sync_configs(spark, folder):
    c = SyncConfigs(spark, folder)
    c.put("s", "a/b", "c", shift_ms=5)
    assert c.get("s", "a/b", "c")["shift_ms"] == 5 and c.get("s", "x", "c") is None
    assert list(c.all("s")) == [("a/b", "c")]
    c.remove("s", "a/b", "c")
    assert c.all("s") == {}


def test_scheduled_compaction(spark, folder):
    e = Engine(spark, folder)
    e.create("a", ttl_age_ms=1000).commit("none", None, puts((b"k", b"v", 5000)))
    e.create("b").commit("none", None, puts((b"k", b"v", 5000)))
    e.merge_all()
    assert list(e.compact_all(10_000)) == ["a"]


def test_hot_key_log(spark):
    log = random_log(spark, 2000, 50, hot=0.4)
    assert rows_of(log.select("seq", "key")) == rows_of(random_log(spark, 2000, 50, hot=0.4).select("seq", "key"))
    rows = [r.asDict() for r in log.collect()]
    assert {(r["prefix"], r["key"]): r["seq"] for r in lww(log).collect()} == {k: r["seq"] for k, r in newest(rows).items()}
    kept = retention.classify(log, retention.Cutoffs()).where("fate = 'keep'")
    assert {r["seq"] for r in kept.collect()} == {r["seq"] for r in newest(rows).values()}
