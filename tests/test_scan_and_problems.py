"""Problems 1 to 6 against brute force on small inputs, with nulls, ties, repeats, skew and empty tables."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from feedloom.functions.keys import norm_prefix
from feedloom.operators import differential as diff
from feedloom.operators import delete_vectors, incremental, inspect, sync
from feedloom.operators.delete_vectors import DeleteVectorTable
from feedloom.operators.dense_groups import dense_group_totals
from feedloom.operators.identifier_index import IdentifierIndex, offer_in_order
from feedloom.operators.prefix_scan import prefix_scan, runs
from feedloom.operators.reconcile import compare_copies, row_checksums
from feedloom.sources import shared
from feedloom.sources.manifests import Conflict


def skewed(r, n):
    return "hot" if r.random() < 0.4 else r.choice(["a", "b", None, ""]) if n is None else r.randrange(n)


@pytest.mark.parametrize("blocks", [1, 3, 7])
def test_prefix_scan(spark, blocks):
    r = random.Random(blocks)
    rows = [(skewed(r, None), i, r.choice([None, r.randrange(100)])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, v bigint").withColumn("__block", F.lit("mine"))
    got = {x["i"]: (x["top"], x["sum"], x["__block"]) for x in prefix_scan(df, ["g"], ["i"], {"top": (F.col("v"), "max"), "sum": (F.col("v"), "sum")}, blocks).collect()}
    seen = defaultdict(list)
    for g, i, v in rows:
        before = [x for x in seen[g] if x is not None]
        assert got[i] == (max(before, default=None), sum(before) if before else None, "mine")
        seen[g].append(v)


def test_prefix_scan_whole_table_and_empty(spark):
    df = spark.range(50).repartition(5)
    got = {r["id"]: r["s"] for r in prefix_scan(df, [], ["id"], {"s": (F.col("id"), "sum")}, 4).collect()}
    assert got == {i: (i * (i - 1) // 2 if i else None) for i in range(50)}
    assert prefix_scan(df.where("id < 0"), [], ["id"], {"s": (F.col("id"), "sum")}).count() == 0


@pytest.mark.parametrize("how", ["max", "min", "sum", "float"])
def test_prefix_scan_over_small_batches(spark, how):
    """Arrow batches of three rows, so that groups go on over batches and blocks."""
    r = random.Random(5)
    rows = [(r.choice(["a", "hot", "hot", None]), i, r.choice([None, -r.randrange(50), r.randrange(50)])) for i in range(200)]
    kind = "double" if how == "float" else "bigint"
    df = spark.createDataFrame(rows, "g string, i int, v bigint").withColumn("v", F.col("v").cast(kind))
    fold = {"max": max, "min": min, "sum": sum, "float": sum}[how]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {x["i"]: x["s"] for x in prefix_scan(df, ["g"], ["i"], {"s": (F.col("v"), "sum" if how == "float" else how)}, 4).collect()}
        told = {(x["i"], x["run"]) for x in runs(df.withColumn("k", F.col("v") > 0), ["g"], ["i"], "k", F.col("i") % 50 == 0, 4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    seen, last, n, want = defaultdict(list), {}, {}, set()
    for g, i, v in rows:
        assert got[i] == (fold(seen[g]) if seen[g] else None)
        if v is not None:
            seen[g].append(v)
        k = None if v is None else v > 0
        n[g] = n[g] + (k != last[g] or i % 50 == 0) if g in last else 0
        last[g] = k
        want.add((i, n[g]))
    assert told == want


def test_runs(spark):
    rows = [(i, i, "aabbbaac"[i]) for i in range(8)]
    df = spark.createDataFrame(rows, "tx_id bigint, seq bigint, kind string").withColumn("n", F.lit(2))
    told = inspect.log_runs(df, [], "kind", F.col("n"), F.col("seq") == 4)
    assert sorted((r["run"], r["kind"], r["start_tx"], r["n"], r["bytes"]) for r in told.collect()) == [(0, "a", 0, 2, 4), (1, "b", 2, 2, 4), (2, "b", 4, 1, 2), (3, "a", 5, 2, 4), (4, "c", 7, 1, 2)]
    p = sync.prefix_batches(df.select("tx_id", "seq", F.when(F.col("kind") != "b", F.lit(None)).otherwise("").alias("prefix")))
    assert [tuple(r) for r in p.collect()] == [(0, "", 8, 0, 7)]


# --- 1 ---


def feed(r, n):
    return [
        {"id": i, "p": "hot" if r.random() < 0.5 else r.choice(["x", "y", None]), "tx": i // 3, "t": r.choice([None, -1, 0] + [r.randrange(1, 40_000_000)] * 9), "cut": r.choice([3_600_000, None])}
        for i in range(n)
    ]


def brute_signs(rows, cut, versions):
    """(message, version, sign) by looking at every row in every version."""
    first, out, found = {}, [], set()
    for x in rows:
        first.setdefault(x["id"], x)
    for x in first.values():
        if not x["t"] or x["t"] <= 0:
            continue
        front = lambda v: max((y["t"] for y in rows if x["p"] is not None and y["p"] == x["p"] and y["tx"] < x["tx"] and y["v"] <= v and y["t"] and y["t"] > 0), default=None)  # noqa: B023, E731
        behind = [v for v in range(x["v"], versions + 1) if cut[x["p"]] is not None and front(v) is not None and front(v) - x["t"] > cut[x["p"]]]
        if not behind or behind[0] > x["v"]:
            out.append((x["id"], x["v"], 1))
        if behind:
            found.add(x["id"])
            if behind[0] > x["v"]:
                out.append((x["id"], behind[0], -1))
    return out, found


@pytest.mark.parametrize("seed", [1, 2])
def test_late_events(spark, seed):
    r = random.Random(seed)
    rows = feed(r, 240)
    r.shuffle(rows)  # delivered in disorder
    cut = {"hot": 3_600_000, "x": None, "y": 7_200_000, None: 1}
    for i, x in enumerate(rows):
        x["v"] = 1 + i // 60
    schema = "id int, p string, tx bigint, t bigint, cut bigint, v bigint, signs string"
    df = spark.createDataFrame([(x["id"], x["p"], x["tx"], x["t"], cut[x["p"]], x["v"], "mine") for x in rows], schema)
    log = df.unionByName(df.limit(50))  # repeats in the log change nothing
    told, deltas = diff.late_corrected(df, log, ["p"], "tx", "t", "cut", "v", 4, keep=["p"])
    signs, found = brute_signs(rows, cut, 4)
    assert any(s < 0 for _, _, s in signs)
    assert sorted((x["id"], x["version"], x["sign"]) for x in told.select("id", F.inline("signs")).collect()) == sorted(signs)
    assert {x["id"] for x in told.where("lateness = 'too_late'").collect()} == found
    assert told.count() == len(rows)
    by_id = {x["id"]: x for x in rows}
    for upto in (1, 2, 3, 4):
        want = Counter()
        for i, v, sign in signs:
            if v <= upto:
                want[by_id[i]["p"], by_id[i]["t"] - by_id[i]["t"] % 3_600_000] += sign
        got = diff.fold(deltas, ["p", "period_start"], ["n"], as_of=upto)
        assert {(x["p"], x["period_start"]): x["n"] for x in got.collect()} == {k: n for k, n in want.items() if n}
    days = diff.fold(diff.roll_up(deltas, {"p": F.col("p")}, ["n"]), ["p"], ["n"])
    assert {x["p"]: x["n"] for x in days.collect()} == {p: n for p in cut if (n := sum(m for (q, _), m in want.items() if q == p))}


def test_a_retraction_comes_in_a_later_version_and_is_carried_on(spark):
    # Transaction 9 counts in version 1; in version 2 transaction 5, smaller but far ahead in time, pushes it past the cut-off.
    hour = 3_600_000
    df = spark.createDataFrame([(1, "p", 9, hour, 1), (2, "p", 5, 5 * hour, 2)], "id int, p string, tx bigint, t bigint, v bigint").withColumn("cut", F.lit(hour).cast("bigint"))
    told, deltas = diff.late_corrected(df, df, ["p"], "tx", "t", "cut", "v", 2, keep=["p"])
    assert [tuple(x) for x in told.where("id = 1").select(F.inline("signs")).collect()] == [(1, 1), (2, -1)]
    assert sorted(tuple(x) for x in deltas.collect()) == [("p", hour, 1, 1, 1), ("p", hour, 2, -1, 1), ("p", hour, 2, 1, 0), ("p", 5 * hour, 2, 1, 1)]
    up = diff.roll_up(deltas, {"p": F.col("p"), "day": F.lit(0)}, ["n"])
    assert [tuple(x) for x in up.collect()] == [("p", 0, 1, 1, 1)]  # a day's count stays 1: one taken back, one come
    assert diff.fold(deltas, ["p", "period_start"], ["n"]).collect() == [("p", 5 * hour, 1)]


def test_late_events_without_rows(spark):
    df = spark.createDataFrame([], "id int, p string, tx bigint, t bigint, cut bigint, v bigint")
    told, deltas = diff.late_corrected(df, df, ["p"], "tx", "t", "cut", "v", 4, keep=["p"])
    assert told.count() == 0 and deltas.count() == 0


def test_retractions_undo_what_was_told(spark):
    ch = spark.createDataFrame([("k", 1, 2), ("k", 2, 3), ("k", 3, -5), ("k", 4, 0), ("j", 1, None)], "k string, version bigint, n bigint")
    rows = sorted((r["version"], r["sign"], r["n"]) for r in diff.signed_deltas(ch, ["k"], ["n"]).collect())
    assert rows == [(1, 1, 2), (2, -1, 2), (2, 1, 5), (3, -1, 5), (3, 1, 0)]


# --- 2 ---

CHANGES = "part string, prefix string, key string, value string, ts bigint, version bigint, tx bigint, gone boolean"


def some_changes(seed, n):
    r = random.Random(seed)
    rows = [(r.choice(["p", "q", None]), r.choice([None, "", "x"]), "hot" if r.random() < 0.3 else str(r.randrange(9)), r.choice([None, "", "v" * r.randrange(50)]), r.randrange(5), r.randrange(3), i // 2, r.choice([True, False, None])) for i in range(n)]
    return rows + r.sample(rows, n // 5)


def standing(rows):
    best = {}
    for p, f, k, v, ts, ver, tx, gone in rows:
        key = (p, f or "", k)
        if key not in best or (ts, ver, -tx) > best[key][0]:
            best[key] = ((ts, ver, -tx), tx)
    return {k: tx for k, (_, tx) in best.items()}


def table(spark, root, **more):
    key = {"part": F.col("part"), "prefix": norm_prefix("prefix"), "key": F.col("key")}
    return DeleteVectorTable(spark, root, key, ["ts", "version"], ["tx"], **more)


@pytest.mark.parametrize(("limit", "merge_at"), [(64 << 20, 8), (0, 8), (0, 1)])
def test_delete_vectors_over_batches(spark, folder, limit, merge_at):
    rows = some_changes(3, 200)
    t = table(spark, folder, broadcast_limit=limit, merge_at=merge_at)
    for b in range(3):
        part = rows[b::3]
        v = t.apply(spark.createDataFrame(part, CHANGES).repartition(3), f"b{b}")
        assert t.apply(spark.createDataFrame(part, CHANGES), f"b{b}") >= v  # a repeated batch is skipped
        done = [x for c in range(b + 1) for x in rows[c::3]]
        got = {(r["part"], r["prefix"] or "", r["key"]): r["tx"] for r in t.read().collect()}
        assert got == standing(done)
        assert t.read(["key"]).count() == len(got)
    again = table(spark, folder)
    assert again.read(["tx"]).count() == len(standing(rows))


def test_delete_vectors_after_a_failure(spark, folder):
    rows = some_changes(4, 60)
    t = table(spark, folder)
    t.apply(spark.createDataFrame(rows[:30], CHANGES), "a")
    spark.createDataFrame(rows[30:40], CHANGES).write.parquet(f"{folder}/data/2")  # a batch that died half way
    shared.write_text(spark, t.manifests._marker("b"), "2")
    t.apply(spark.createDataFrame(rows[30:], CHANGES), "b")
    assert {(r["part"], r["prefix"] or "", r["key"]): r["tx"] for r in t.read().collect()} == standing(rows)


def test_delete_vectors_leave_clashing_columns_alone(spark, folder):
    df = spark.createDataFrame(some_changes(6, 40), CHANGES).withColumns({c: F.lit(c) for c in ("__file", "__pos", "__block", "__gone", "__row", "_metadata", "__rank", "a.b")})
    df.write.parquet(f"{folder}/files")
    t = table(spark, f"{folder}/t")
    t.apply(f"{folder}/files", "all")
    got = t.read()
    assert got.columns == df.columns
    assert {(r["__file"], r["__pos"], r["_metadata"], r["a.b"]) for r in got.collect()} == {("__file", "__pos", "_metadata", "a.b")}


def test_delete_vectors_read_without_moving_rows(spark, folder):
    """Beyond the limit files are read in groups, each with its own words: no exchange over the rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = table(spark, folder, broadcast_limit=64)
        for b in range(4):
            t.apply(spark.createDataFrame([("p", "x", str(i), f"v{b}", b, 0, b * 100 + i, False) for i in range(60)], CHANGES).repartition(2), f"b{b}")
        small, big = t.read(), table(spark, folder).read()
        plan = small._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Union") >= 1
        # Every exchange is of words, none of rows: what is joined from the files' side is a scan.
        physical = table(spark, folder).read()._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in physical and "SortMergeJoin" not in physical
        assert sorted(map(tuple, small.collect())) == sorted(map(tuple, big.collect()))
        assert small.count() == 60
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("small", [0, 1 << 40])
def test_delete_vectors_by_shelf(spark, folder, monkeypatch, small):
    monkeypatch.setattr(delete_vectors, "PER_SHELF", 1 << 10)
    monkeypatch.setattr(delete_vectors, "SMALL_BATCH", small)
    rows = some_changes(8, 160)
    t = table(spark, folder, merge_at=2)
    for b in range(4):
        t.apply(spark.createDataFrame(rows[b::4], CHANGES), f"b{b}")
    assert t.manifests.newest()["bits"] > 0
    assert {(r["part"], r["prefix"] or "", r["key"]): r["tx"] for r in t.read().collect()} == standing(rows)


def test_two_writers_lose_nothing(spark, folder):
    t, other = table(spark, folder), table(spark, folder)
    before = other.manifests.newest()
    t.apply(spark.createDataFrame(some_changes(9, 20), CHANGES), "mine")
    with pytest.raises(Conflict):
        other.manifests.commit(before, {"data": []}, "theirs")
    assert other.manifests.newest()["batch"] == "mine" and other.manifests.version_of("theirs") is None


def test_delete_vectors_over_files_and_empty(spark, folder):
    rows = some_changes(5, 90)
    spark.createDataFrame(rows, CHANGES).repartition(4).write.parquet(f"{folder}/files")
    t = table(spark, f"{folder}/t")
    t.apply(f"{folder}/files", "all")
    assert t.read(["tx"]).count() == len(standing(rows))
    t.apply(f"{folder}/files", "again")  # equal rows change nothing
    assert t.read(["tx"]).count() == len(standing(rows))
    e = table(spark, f"{folder}/e")
    e.apply(spark.createDataFrame([], CHANGES), "none")
    assert e.read().count() == 0
    with pytest.raises(ValueError):
        table(spark, f"{folder}/none").read()


# --- 3 ---

COPY = "part string, key string, value string, ts bigint, gone boolean, version bigint"
FIELDS = ["value", "ts", "gone", "version"]


def brute_compare(a, b):
    def best(rows):
        out = {}
        for r in rows:
            k = r[:2]
            if k not in out or (r[3], r[5]) > (out[k][3], out[k][5]):
                out[k] = r
        return out

    x, y = best(a), best(b)
    out = set()
    for k in x.keys() | y.keys():
        if k not in y:
            out.add((*k, "only_first"))
        elif k not in x:
            out.add((*k, "only_second"))
        else:
            out |= {(*k, FIELDS[i]) for i in range(4) if x[k][2 + i] != y[k][2 + i]}
    return out


@pytest.mark.parametrize(("seed", "leaf"), [(1, 1), (2, 4), (3, 64)])
def test_compare_copies(spark, seed, leaf):
    r = random.Random(seed)
    a = [(r.choice(["p", None]), str(i), r.choice([None, "", "v"]), i, r.choice([True, False, None]), i % 5) for i in range(300)]
    b = [x if r.random() < 0.9 else (x[0], x[1], r.choice([None, "", "w"]), x[3], x[4], x[5] + 1) for x in a if r.random() < 0.95] + [("p", f"new{i}", "v", 1, False, 1) for i in range(5)]
    a += r.sample(a, 20)
    a += [(*x[:3], x[3] - 1, *x[4:]) for x in r.sample(a, 20)]
    got = compare_copies(spark.createDataFrame(a, COPY).withColumn("side", F.lit("mine")), spark.createDataFrame(b, COPY), ["part", "key"], FIELDS, ["ts", "version"], rows_per_leaf=leaf)
    assert {tuple(x) for x in got.collect()} == brute_compare(a, b)


def test_compare_clashing_names(spark):
    rows = [("a", 1), ("b", 2)]
    one = spark.createDataFrame(rows, "side string, token int").withColumns({c: F.lit(1) for c in ("c1", "h", "l", "difference", "k0")})
    two = spark.createDataFrame([("a", 1), ("b", 3)], "side string, token int")
    assert [tuple(r) for r in compare_copies(one, two, ["side"], ["token"], ["token"]).collect()] == [("b", "token")]


def test_compare_tied_rows(spark):
    """Two rows of a copy are equally new and differ: the larger value counts, whichever the checksums would have met."""
    a = [("p", str(i), v, 1, False, 1) for i in range(40) for v in ("x", "y")]
    b = [("p", str(i), "y" if i % 2 else "x", 1, False, 1) for i in range(40)]
    assert {tuple(x) for x in compare_copies(*[spark.createDataFrame(x, COPY) for x in (a, b)], ["part", "key"], FIELDS, ["ts", "version"], rows_per_leaf=2).collect()} == {("p", str(i), "value") for i in range(0, 40, 2)}


def test_compare_moves_only_what_differs(spark):
    """Fields are shuffled after the checksums only: the first aggregation knows hashes and the newest columns alone."""
    rows = spark.createDataFrame([("p", "k", "v", 1, False, 1)], COPY).withColumn("side", F.lit(0))
    plan = row_checksums(rows, ["part", "key"], FIELDS, ["ts", "version"])._jdf.queryExecution().executedPlan().toString()
    exchanged = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(exchanged) == 1 and "value" not in exchanged[0] and "key" not in exchanged[0]


def test_compare_empty(spark):
    e, one = spark.createDataFrame([], COPY), spark.createDataFrame([("p", "k", None, 1, None, 1)], COPY)
    keys = (["part", "key"], FIELDS, ["ts", "version"])
    assert compare_copies(e, e, *keys).count() == 0
    assert [r[2] for r in compare_copies(one, e, *keys).collect()] == ["only_first"]
    assert [r[2] for r in compare_copies(e, one, *keys).collect()] == ["only_second"]
    assert compare_copies(one, one, *keys).count() == 0


# --- 4 ---


def test_identifier_index(spark, folder):
    r = random.Random(1)
    rows = [(i, "hot" if r.random() < 0.3 else r.choice([None, "", "a", "b"]), r.randrange(30)) for i in range(400)]
    df = spark.createDataFrame(rows, "seq bigint, name string, n bigint")
    want, seen = set(), set()
    for i, name, n in rows:
        if (name, n) not in seen:
            want.add(i)
            seen.add((name, n))
    for merge_at, batches in ((1, 5), (9, 3)):
        index = IdentifierIndex(spark, f"{folder}/{merge_at}", [F.col("name"), F.col("n")], "seq", bits=4, merge_at=merge_at)
        offer_in_order(index, df, batches)
        offer_in_order(index, df, batches)  # the same batches again change nothing
        assert {x[0] for x in index.kept().collect()} == want
        index.offer(df.withColumn("seq", F.col("seq") + 1000), "late copies")
        index.merge()
        index.vacuum()
        assert {x[0] for x in index.kept().collect()} == want
    empty = IdentifierIndex(spark, f"{folder}/e", [F.col("name")], "seq")
    offer_in_order(empty, df.where("seq < 0"), 3)
    empty.offer(df.where("seq < 0"), "none")
    assert empty.kept().count() == 0
    assert IdentifierIndex.bits_for(0) == 4 and IdentifierIndex.bits_for(1 << 40) == 25


def test_identifier_index_grows_and_opens_few_shelves(spark, folder):
    index = IdentifierIndex(spark, folder, [F.col("id")], "seq", bits=9, merge_at=1, per_array=1)
    df = spark.range(6000).withColumn("seq", F.col("id"))
    index.offer(df.where("id < 3000"), "a")
    index.offer(df.where("id >= 2000"), "b")
    now = index.manifests.newest()
    assert now["bits"] == IdentifierIndex.bits_for(6000, 1) and len(now["runs"]) == 1  # arrays were split
    assert sorted(x[0] for x in index.kept().collect()) == list(range(6000))
    one = index._read(now, [3])
    assert "PartitionFilters: [isnotnull(shelf" in one._jdf.queryExecution().executedPlan().toString()
    assert 0 < one.count() < index._read(now).count() / 8
    index.offer(df.withColumn("seq", F.col("seq") + 10_000).where("id < 5"), "copies")
    assert index.kept().count() == 6000


# --- 5 ---


def test_dense_groups_with_a_million_keys(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        df = spark.range(0, 1_200_000, 1, 6).select((F.col("id") % 1_000_000).cast("string").alias("k"), F.col("id").alias("v"))
        got = dense_group_totals(df, ["k"], ["v"], per_block=1 << 20)
        told = got.agg(F.count("*"), F.sum("n"), F.count_if(F.col("n") == 2), F.count_if(F.col("max_v").cast("string") == F.col("k"))).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert tuple(told) == (1_000_000, 1_200_000, 200_000, 800_000)


def test_dense_groups(spark):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.5 else r.choice([None, "", "a", "é\u0000b"]), r.choice([None, "", "x"]), r.choice([None, r.randrange(-99, 99)])) for _ in range(500)]
    df = spark.createDataFrame(rows, "a string, b string, v bigint").repartition(5)
    n, top = Counter(), {}
    for a, b, v in rows:
        n[a, b] += 1
        if v is not None:
            top[a, b] = max(top.get((a, b), v), v)
    for flush in (1, 1 << 20):
        got = dense_group_totals(df, ["a", "b"], ["v"], fan_in=2, flush_at=flush)
        assert {(x["a"], x["b"]): (x["n"], x["max_v"]) for x in got.collect()} == {k: (c, top.get(k)) for k, c in n.items()}
    assert dense_group_totals(df.where("v > 1000"), ["a", "b"], ["v"]).count() == 0


# --- 6 ---


def test_uncovered(spark):
    r = random.Random(3)
    log = [("p" if r.random() < 0.7 else "q", r.choice([None, r.randrange(80)])) for _ in range(300)]
    takers = [("m1", "p"), ("m2", "p"), ("m1", "q"), ("m3", "none"), ("m1", "p")]
    covers = [(r.choice(["m1", "m2"]), r.choice(["p", "q"]), r.choice([None, -1, r.randrange(80)]), r.choice([None, r.randrange(80)])) for _ in range(25)]
    got = incremental.uncovered(
        spark.createDataFrame(log, "part string, tx bigint"), spark.createDataFrame(takers, "who string, part string"), spark.createDataFrame(covers, "who string, part string, low bigint, high bigint"), ["who", "part"], ["part"], "tx", "low", "high"
    )
    want = {
        (w, p, tx) for w, p in set(takers) for q, tx in log
        if q == p and tx is not None and not any(a == w and b == p and lo is not None and hi is not None and lo < tx <= hi for a, b, lo, hi in covers)
    }
    assert {tuple(x) for x in got.collect()} == want


def test_capture_job_survives_failures(spark, folder):
    make = lambda: incremental.CaptureJob(spark, folder, ["part"], "at", ["part"], "tx")
    # Positions rise with delivery; transactions come in disorder and again.
    log = spark.createDataFrame([("p", i, t) for i, t in enumerate([5, 3, 5, 1, 4, 2, 3, 9])] + [(None, 0, 7), ("q", 3, 1)], "part string, at bigint, tx bigint")
    upto = lambda n: log.where(F.col("at") <= n)

    def broken(rows):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        make().run(upto(2), broken)
    assert make().offsets() is None and make().open_plan() == 0
    make().run(upto(5), lambda rows: rows)  # more has come, but the open plan is replayed as it was written
    assert {(r["part"], r["tx"]) for r in make().sink().collect()} == {("p", 5), ("p", 3), (None, 7)}
    assert {(r["part"], r["position"]) for r in make().offsets().collect()} == {("p", 2), (None, 0)}
    job = make()
    n = job.plan(upto(7))
    assert {(r["part"], r["from_position"], r["to_position"]) for r in job.ranges(n).collect()} == {("p", 2, 7), ("q", None, 3)}
    job.deliver(n, job.planned(n, log).unionByName(job.planned(n, log)))  # delivered, then lost before the commit
    assert make().sink().count() == 3
    make().run(log, lambda rows: rows)
    want = [("p", t) for t in (1, 2, 3, 4, 5, 9)] + [("q", 1), (None, 7)]
    assert sorted(map(str, ((r["part"], r["tx"]) for r in make().sink().collect()))) == sorted(map(str, want))
    make().run(log, lambda rows: rows)  # nothing new
    assert make().sink().count() == len(want) and make().offsets().count() == 3
