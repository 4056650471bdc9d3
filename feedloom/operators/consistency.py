"""Consistency levels: quorums, what a partition allows, which replicas answer, and merging their answers."""

from __future__ import annotations

import random
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.operators.reads import in_key_order, multi_get
from feedloom.operators.resolve import live, lww

#: The levels, in order.
LEVELS = ("leader", "leader_plus_one", "leader_quorum", "leader_all", "quorum", "write_all_read_one", "write_one_read_all", "none")
#: Levels that need a leader.
LED = LEVELS[:4]
#: For a partition's level, the levels at which it may be written.
WRITES = {
    "leader": ("leader", "leader_plus_one", "leader_quorum", "leader_all", "write_all_read_one"),
    "leader_plus_one": ("leader_plus_one", "leader_quorum", "leader_all", "write_all_read_one"),
    "leader_quorum": ("leader_quorum", "leader_all", "write_all_read_one"),
    "leader_all": ("leader_all", "write_all_read_one"),
    "quorum": ("leader_quorum", "leader_all", "quorum", "write_all_read_one"),
    "write_all_read_one": ("leader_all", "write_all_read_one"),
    "write_one_read_all": LEVELS,
    "none": LEVELS,
}
#: The same for reads.
READS = {
    "leader": ("leader", "write_one_read_all", "none"),
    "leader_plus_one": ("leader", "leader_plus_one", "write_one_read_all", "none"),
    "leader_quorum": ("leader", "leader_quorum", "quorum", "write_one_read_all", "none"),
    "leader_all": LEVELS,
    "quorum": ("quorum", "write_one_read_all", "none"),
    "write_all_read_one": LEVELS,
    "write_one_read_all": ("write_one_read_all", "none"),
    "none": LEVELS,
}
#: Levels at which a scan merges the answers of several replicas.
MERGED = ("leader_plus_one", "leader_quorum", "quorum", "write_one_read_all")


def write_quorum(level: str, neighbours: int) -> int:
    """Neighbours that must have a write before it counts."""
    if level == "leader_plus_one":
        if neighbours == 0:
            raise ValueError("leader_plus_one needs a neighbour")
        return 1
    if level in ("leader_quorum", "quorum"):
        return (neighbours + 1) // 2
    return neighbours if level in ("leader_all", "write_all_read_one") else 0


def repair_quorum(level: str, neighbours: int) -> int:
    """Neighbours to hear before a replica that was away is whole again."""
    if level == "leader":
        raise ValueError("leader has no repair quorum")
    if level == "leader_plus_one":
        return neighbours - 1
    if level in ("leader_quorum", "quorum"):
        return neighbours // 2
    return neighbours if level == "write_one_read_all" else 0


def quorum_table(spark: SparkSession, most: int = 8) -> DataFrame:
    """level, neighbours, write_quorum and repair_quorum (null where there is none), for 0..``most`` neighbours."""
    rows = []
    for level in LEVELS:
        for n in range(most + 1):
            w = None if level == "leader_plus_one" and n == 0 else write_quorum(level, n)
            r = None if level == "leader" else repair_quorum(level, n)
            rows.append((level, n, w, r))
    return spark.createDataFrame(rows, "level string, neighbours int, write_quorum int, repair_quorum int")


def support_matrix(spark: SparkSession) -> DataFrame:
    """partition_level, level, writes, reads for every pair of levels."""
    rows = [(p, c, c in WRITES[p], c in READS[p]) for p in LEVELS for c in LEVELS]
    return spark.createDataFrame(rows, "partition_level string, level string, writes boolean, reads boolean")


def check_allowed(partition_level: str, level: str, require: bool, write: bool) -> None:
    """Raise if a partition that insists on its level doesn't allow another one."""
    if require and level not in (WRITES if write else READS)[partition_level]:
        raise ValueError(f"{level} isn't allowed on a partition at {partition_level}")


def supported(asks: DataFrame, partitions: DataFrame, write: bool) -> DataFrame:
    """Asks of (partition_name, level) that their partition allows; those that don't insist allow all."""
    matrix = support_matrix(asks.sparkSession).where("writes" if write else "reads").select(F.col("partition_level").alias("consistency"), "level")
    known = asks.join(partitions.select("partition_name", "consistency", "require_consistency"), "partition_name")
    free = known.where(~F.coalesce("require_consistency", F.lit(False)))
    bound = known.where(F.coalesce("require_consistency", F.lit(False))).join(F.broadcast(matrix), ["consistency", "level"], "left_semi")
    return free.unionByName(bound).select(*asks.columns)


def acked(acks: DataFrame, tx_id: int | Column, quorum: int, partition: Sequence[str], leadership: Column | None = None) -> DataFrame:
    """Per partition: neighbours that acknowledged ``tx_id`` or more, and whether they make the quorum.

    ``leadership`` is true on an ack that reports a later leader; one such ack fails the write.
    """
    enough = F.count_if(F.col("tx_id") >= (tx_id if isinstance(tx_id, Column) else F.lit(tx_id)))
    usurped = F.lit(False) if leadership is None else F.coalesce(F.bool_or(leadership), F.lit(False))
    return acks.groupBy(*partition).agg(enough.alias("acks"), ((enough >= quorum) & ~usurped).alias("committed"))


def read_replicas(level: str, members: Sequence[str], leader: str | None, failover: bool = False, seed: int | None = None) -> list[str]:
    """Which members answer a read; with ``failover``, those that stand in for a leader that is away."""
    rest = [m for m in members if m != leader]
    pick = random.Random(seed)
    if level in LED:
        if leader is None and not failover:
            raise ValueError("there is no leader")
        if not failover:
            return [leader]
        if level == "leader":
            raise ValueError("a read at leader has no stand-in")
        if level == "leader_plus_one":
            return rest
        return pick.sample(rest, min(len(rest), 1 + len(rest) // 2 if level == "leader_quorum" else 1))
    if level == "write_one_read_all":
        return list(members)
    if level == "quorum":
        return pick.sample(list(members), min(len(members), 1 + len(members) // 2))
    return pick.sample(list(members), min(1, len(members)))


def ordered_ring(members: Sequence[str], leader: str | None, preferred: Sequence[str] | None = None) -> list[str]:
    """Members in the order to ask them: the preferred ones first, else the leader first."""
    if preferred is None:
        return [m for m in members if m == leader] + [m for m in members if m != leader]
    return [m for m in dict.fromkeys(preferred) if m in members] + [m for m in members if m not in preferred]


def leaderless_ring(members: Sequence[str], leader: str | None) -> list[str]:
    return [m for m in members if m != leader]


def quorum_merge(answers: Sequence[DataFrame]) -> DataFrame:
    """Replicas' logs as one.  Each replica numbers its own rows, so of rows equal in timestamp and version any may stand."""
    out = answers[0]
    for a in answers[1:]:
        out = out.unionByName(a)
    return out


def quorum_state(log: DataFrame, replicas: Sequence[Any], member: str = "replica") -> DataFrame:
    """The answers of the replicas as one state: the newest row of every key."""
    return lww(log.where(F.col(member).isin(list(replicas))))


def quorum_get(log: DataFrame, replicas: Sequence[Any], prefix: Any, keys: Sequence[Any], member: str = "replica") -> DataFrame:
    return multi_get(log.where(F.col(member).isin(list(replicas))), prefix, keys)


def quorum_scan(log: DataFrame, replicas: Sequence[Any], member: str = "replica") -> DataFrame:
    """Live rows of the merged answers in key order; tombstones are dropped after merging."""
    return in_key_order(live(quorum_state(log, replicas, member)))


def take_categories(members: Sequence[str], root: str | None, system: bool = False) -> list[tuple[str, int]]:
    """Neighbours in the order they are asked, with their category (1 first).

    The others stand in a circle from the root on.  Every one in turn asks for those at distances 1, 2, 4, ...
    behind it, itself at the last; of each neighbour the first asking counts, and one already asked for asks no more.
    A category has half the ring, on system rings as many as there are bits in its size.
    """
    n = len(members)
    each = max(1, (n - 1).bit_length()) if system else max(n // 2, 1)
    cut = members.index(root) + 1 if root in members else 0
    circle = [m for m in [*members[cut:], *members[:cut]] if m != root]
    doublings = [2**i for i in range(len(circle).bit_length())]
    order: dict[str, None] = {}
    for place, asker in enumerate(circle):
        if asker not in order:
            order.update(dict.fromkeys(circle[(place + d - 1) % len(circle)] for d in doublings))
    return [(m, 1 + i // each) for i, m in enumerate(order)]


def slow_category(lags: DataFrame, factor: int, slow: int) -> DataFrame:
    """Per partition, the widest category needed until ``factor`` takers are fast enough.

    ``lags`` has partition_name, ``place`` (order of asking), ``category`` and ``lag``, null for a member without a session.
    A taker is fast if it lags not at all or less than ``slow`` times its category.
    """
    fast = F.coalesce((F.col("lag") <= 0) | (F.col("lag") < F.lit(slow).cast("bigint") * F.col("category")), F.lit(False)).cast("int")
    before = Window.partitionBy("partition_name").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = lags.withColumn("__fast", F.coalesce(F.sum(fast).over(before), F.lit(0)))
    return rows.groupBy("partition_name").agg(F.coalesce(F.max(F.when(F.col("__fast") < factor, F.col("category"))), F.lit(1)).alias("category"))


def member_state(states: DataFrame) -> DataFrame:
    """The state of each (partition_name, member) by the latest ``ts_id``, and how many of its ring share it at quorum."""
    now = states.groupBy("partition_name", "member").agg(F.max_by("state", F.struct("ts_id", "state")).alias("state"))
    per = Window.partitionBy("partition_name")
    same = F.count(F.lit(1)).over(Window.partitionBy("partition_name", "state"))
    return now.select("*", (same > F.count(F.lit(1)).over(per) / 2).alias("at_quorum"))


def replica_diff(a: DataFrame, b: DataFrame, fields: Sequence[str] = ("value", "ts_id", "tombstoned", "version")) -> DataFrame:
    """Per key: ``missing`` (only in b), ``extra`` (only in a), ``differs`` or ``same``."""
    x, y = lww(a).alias("x"), lww(b).alias("y")
    empty = F.lit(b"") if a.schema["prefix"].dataType.typeName() == "binary" else F.lit("")
    on = (F.coalesce(F.col("x.prefix"), empty) == F.coalesce(F.col("y.prefix"), empty)) & (F.col("x.key") == F.col("y.key"))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"x.{f}").eqNullSafe(F.col(f"y.{f}"))
    told = F.when(F.col("x.key").isNull(), "missing").when(F.col("y.key").isNull(), "extra").when(same, "same").otherwise("differs")
    return x.join(y, on, "full_outer").select(F.coalesce("x.prefix", "y.prefix", empty).alias("prefix"), F.coalesce("x.key", "y.key").alias("key"), told.alias("outcome"))
