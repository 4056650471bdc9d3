"""Partitions, their properties, and the rings that hold them."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the host of a member nobody knows the host of.
UNKNOWN_HOST = "unknownRingHost"


def ring_lookup(rings: DataFrame, nodes: DataFrame) -> DataFrame:
    """ring_name, ring_member, host of every member; UNKNOWN_HOST for a member without a node."""
    hosts = nodes.groupBy("ring_member").agg(F.max("host").alias("host"))
    return rings.select("ring_name", "ring_member").distinct().join(hosts, "ring_member", "left").select("ring_name", "ring_member", F.coalesce("host", F.lit(UNKNOWN_HOST)).alias("host"))


def member_rings(rings: DataFrame, member: str) -> DataFrame:
    """The rings a member belongs to."""
    return rings.where(F.col("ring_member") == member).select("ring_name").distinct()


def host_text(datacenter: Column, rack: Column, host: Column, port: Column) -> Column:
    """A host in one string: four parts, or host and port where datacenter and rack are missing."""
    four = F.concat_ws(":", datacenter, rack, host, port.cast("string"))
    two = F.concat_ws(":", host, port.cast("string"))
    return F.when(host.isNull() | port.isNull(), UNKNOWN_HOST).when(datacenter.isNull() | rack.isNull(), two).otherwise(four)


def parse_host(text: Column) -> Column:
    """The parts of such a string as a struct."""
    part = F.split(text, ":")
    n = F.size(part)
    at = lambda i: F.element_at(part, i)
    return F.struct(
        F.when(n == 4, at(1)).alias("datacenter"),
        F.when(n == 4, at(2)).alias("rack"),
        F.when(n == 4, at(3)).when(n == 2, at(1)).alias("host"),
        F.when(n == 4, at(4)).when(n == 2, at(2)).cast("int").alias("port"),
    )


def build_ring(ring_name: str, members: Sequence[tuple[str, str | None]], size: int, current: Sequence[str] = ()) -> list[str]:
    """Members of a ring of ``size`` out of (member, rack), the least used racks first; the same on every call.

    Members in ``current`` stay.  Raises if there are too few.
    """
    if len({m for m, _ in members}) < size:
        raise ValueError(f"{len(members)} members can't make a ring of {size}")
    rack_of = dict(members)
    ring = list(dict.fromkeys(current))
    pick = random.Random(int.from_bytes(hashlib.sha256(ring_name.encode()).digest()[:8], "big"))
    free: dict[str, list[str]] = {}
    for m, rack in sorted(rack_of.items(), key=lambda x: (x[1] or "", x[0])):
        if m not in ring:
            free.setdefault(rack or "", []).append(m)
    for rack in free:
        pick.shuffle(free[rack])
    while len(ring) < size:
        used = {r: sum((rack_of.get(m) or "") == r for m in ring) for r in free if free[r]}
        rack = min(used, key=lambda r: (used[r], r))
        ring.append(free[rack].pop())
    return ring


def upsert_properties(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """The catalog after changes, both with partition_name, ts_id and version among their columns: the newer row stands."""
    both = catalog.unionByName(changes, allowMissingColumns=True)
    newest = F.max_by(F.struct(*[F.col(c) for c in both.columns]), F.struct("ts_id", "version")).alias("r")
    return both.groupBy("partition_name").agg(newest).select("r.*")


def mark_for_disposal(catalog: DataFrame, partition_name: str, version: int) -> DataFrame:
    """The catalog with a partition's disposal version raised to ``version``."""
    mine = F.col("partition_name") == partition_name
    return catalog.withColumn("disposal_version", F.when(mine, F.greatest(F.coalesce("disposal_version", F.lit(version)), F.lit(version))).otherwise(F.col("disposal_version")))


def bump_version(catalog: DataFrame, partition_name: str) -> DataFrame:
    """The catalog with the next storage version of a partition; the old one's files become orphans."""
    return catalog.withColumn("partition_version", F.when(F.col("partition_name") == partition_name, F.col("partition_version") + 1).otherwise(F.col("partition_version")))


def orphans(stored: DataFrame, catalog: DataFrame) -> DataFrame:
    """Stored (partition_name, partition_version) that the catalog no longer names."""
    return stored.join(catalog.select("partition_name", "partition_version"), ["partition_name", "partition_version"], "left_anti")


def partitions_of_member(catalog: DataFrame, rings: DataFrame, member: str) -> DataFrame:
    """Partitions whose ring has the member, and all system partitions."""
    mine = member_rings(rings, member)
    return catalog.where("is_system").unionByName(catalog.where("NOT is_system").join(mine, "ring_name", "left_semi").select(*catalog.columns))


def in_name_order(catalog: DataFrame) -> DataFrame:
    """Partitions by their total order: not system before system, then ring, then name."""
    return catalog.orderBy("is_system", "ring_name", "partition_name")


def route(catalog: DataFrame, rings: DataFrame, nodes: DataFrame, leaders: DataFrame | None = None) -> DataFrame:
    """Per partition: its members in order with their hosts, its leader (of ``leaders`` partition_name, leader; null if none or
    not of its ring), and whether it is marked for disposal."""
    seats = ring_lookup(rings, nodes).groupBy("ring_name").agg(F.sort_array(F.collect_list(F.struct("ring_member", "host"))).alias("members"))
    told = catalog.join(seats, "ring_name", "left")
    if leaders is None:
        told = told.withColumn("leader", F.lit(None).cast("string"))
    else:
        told = told.drop("leader").join(leaders.groupBy("partition_name").agg(F.max("leader").alias("leader")), "partition_name", "left")
    mine = F.exists(F.coalesce("members", F.array()), lambda m: m["ring_member"] == F.col("leader"))
    return told.select("partition_name", "ring_name", "members", F.when(mine, F.col("leader")).alias("leader"), F.col("disposal_version").isNotNull().alias("disposed"))


def highwater_max(marks: DataFrame, by: Sequence[str], tx: str) -> DataFrame:
    """The mark that stands: a mark only ever replaces a smaller one, negative ones are none."""
    return marks.where(F.col(tx) >= 0).groupBy(*by).agg(F.max(tx).alias(tx))
