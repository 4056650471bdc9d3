import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedloom.functions.keys import free_name, prefix_upper, prefix_upper_text
from feedloom.operators import catalog, consistency, inspect


@given(st.binary(max_size=4), st.binary(max_size=3))
def test_bound_is_above_all_with_the_prefix(p, more):
    up = prefix_upper(p)
    assert up is None or up > p + more
    assert up is not None or p.strip(b"\xff") == b""


@given(st.text(max_size=4), st.text(max_size=3))
def test_text_bound(p, more):
    up = prefix_upper_text(p)
    assert up is None or [ord(c) for c in up] > [ord(c) for c in p + more]


def test_bytes_order(spark):
    keys = [b"\x00", b"\x7f", b"\x7f\x00", b"\x80", b"\xff"]
    df = spark.createDataFrame([(k,) for k in reversed(keys)], "k binary").orderBy("k")
    assert [bytes(r[0]) for r in df.collect()] == keys


def test_free_name(spark):
    df = spark.createDataFrame([(1, 2)], "__X int, ___x int")
    assert free_name(df, "x", "x") == ["____x", "_____x"]


def test_quorums():
    assert [consistency.write_quorum("quorum", n) for n in range(5)] == [0, 1, 1, 2, 2]
    assert [consistency.repair_quorum("leader_quorum", n) for n in range(5)] == [0, 0, 1, 1, 2]
    with pytest.raises(ValueError):
        consistency.write_quorum("leader_plus_one", 0)
    with pytest.raises(ValueError):
        consistency.repair_quorum("leader", 3)
    with pytest.raises(ValueError):
        consistency.check_allowed("leader_all", "quorum", True, True)
    consistency.check_allowed("leader_all", "quorum", False, True)


def test_categories():
    for i, root in enumerate("abcde"):
        got = dict(consistency.take_categories(list("abcde"), root))
        after = [c for c in "abcdeabcde"[i + 1 : i + 5]]
        assert root not in got
        assert {got[after[0]], got[after[1]]} == {1} and {got[after[2]], got[after[3]]} == {2}
    assert consistency.take_categories(["a"], "a") == []


def test_replicas():
    ring = list("abcde")
    assert consistency.read_replicas("leader_quorum", ring, "b") == ["b"]
    assert len(consistency.read_replicas("leader_quorum", ring, "b", failover=True)) == 3
    assert consistency.read_replicas("leader_plus_one", ring, "b", failover=True) == list("acde")
    assert len(consistency.read_replicas("quorum", ring, None)) == 3
    assert consistency.read_replicas("write_one_read_all", ring, None) == ring
    assert consistency.ordered_ring(ring, "c") == list("cabde")
    assert consistency.ordered_ring(ring, "c", ["e", "x", "a"]) == list("eabcd")
    assert consistency.leaderless_ring(ring, "c") == list("abde")


def test_build_ring():
    members = [(f"m{i}", f"rack-{i % 3}") for i in range(9)]
    ring = catalog.build_ring("r", members, 6)
    assert ring == catalog.build_ring("r", members, 6) and len(set(ring)) == 6
    racks = [dict(members)[m] for m in ring]
    assert all(racks.count(f"rack-{i}") == 2 for i in range(3))
    assert catalog.build_ring("r", members, 4, ["m0", "m3"])[:2] == ["m0", "m3"]
    with pytest.raises(ValueError):
        catalog.build_ring("r", members, 10)


def test_hosts(spark):
    df = spark.createDataFrame([("dc", "r", "h", 1), (None, "r", "h", 2), ("dc", "r", None, 3)], "d string, r string, h string, p int")
    text = df.select(catalog.host_text(*[F.col(c) for c in "drhp"]).alias("t"))
    assert [r[0] for r in text.collect()] == ["dc:r:h:1", "h:2", "unknownRingHost"]
    back = [tuple(r[0]) for r in text.select(catalog.parse_host(F.col("t"))).collect()]
    assert back == [("dc", "r", "h", 1), (None, None, "h", 2), (None, None, None, None)]


def test_chunk_power(spark):
    sizes = [0, 1, 2, 3, 4, 5, 8, 9, 1 << 40, (1 << 40) + 1]
    df = spark.createDataFrame([(s,) for s in sizes], "s bigint").select(inspect.chunk_power(F.col("s")))
    assert [r[0] for r in df.collect()] == [0, 0, 1, 2, 2, 3, 3, 4, 40, 41]


def test_catalog_changes(spark):
    cat = spark.createDataFrame([("p", 1, 1, None), ("q", 1, 1, 5)], "partition_name string, ts_id bigint, version bigint, disposal_version bigint")
    new = spark.createDataFrame([("p", 2, 1, 9), ("q", 0, 9, 9)], cat.schema)
    assert {r["partition_name"]: r["disposal_version"] for r in catalog.upsert_properties(cat, new).collect()} == {"p": 9, "q": 5}
    assert {r["partition_name"]: r["disposal_version"] for r in catalog.mark_for_disposal(cat, "q", 4).collect()} == {"p": None, "q": 5}


def test_member_state(spark):
    rows = [("p", "a", "leader", 5), ("p", "a", "inactive", 1), ("p", "b", "leader", 2), ("p", "c", "follower", 2)]
    got = {(r["member"], r["state"], r["at_quorum"]) for r in consistency.member_state(spark.createDataFrame(rows, "partition_name string, member string, state string, ts_id bigint")).collect()}
    assert got == {("a", "leader", True), ("b", "leader", True), ("c", "follower", False)}
