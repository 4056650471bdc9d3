"""Processing only what is new since the last success, whatever failed in between.

A log is read in the order of its delivery, by an offset per partition.  Before anything is
processed, a batch is written down as a plan: per partition the offsets it goes from and to.  A run
that fails is repeated from its plan, over the same records; committing a plan stores the offsets it
leads to, and the next plan begins there.  The sink keeps one record per key and offset.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.prefix_scan import prefix_scan
from feedloom.sources import shared

#: Past any transaction.
END = (1 << 63) - 1


def gaps(consumers: DataFrame, covers: DataFrame, consumer: Sequence[str], low: str, high: str) -> DataFrame:
    """What each consumer's ranges leave open: ``consumer``, ``open_after`` < offset <= ``open_to``.

    ``covers`` holds ranges ``low`` < offset <= ``high`` per consumer, in any order, overlapping or with gaps;
    ranges with a null end or without any offset count for nothing.  A range begins a gap's end if
    the furthest end of all ranges that begin below it doesn't reach it, which one running maximum tells.  The
    last gap of a consumer has no end (``END``); one without ranges is open altogether.
    """
    who = list(consumer)
    first = -(1 << 63)
    ranges = covers.where(F.col(high) > F.col(low)).groupBy(*who, F.col(low).cast("bigint").alias("__low")).agg(F.max(F.col(high).cast("bigint")).alias("__high"))
    # A last range of no length stands for the end of the line.
    ends = consumers.select(*who).distinct().select(*who, F.lit(END).alias("__low"), F.lit(END).alias("__high"))
    line = prefix_scan(ranges.unionByName(ends), who, ["__low"], {"__reach": (F.col("__high"), "max")})
    after = F.coalesce("__reach", F.lit(first))
    return line.where(after < F.col("__low")).select(*who, after.alias("open_after"), F.col("__low").alias("open_to"))


def _bin(at: Column, low: int, width: int) -> Column:
    return F.floor((at.cast("double") - float(low)) / float(width)).cast("int")


def within(points: DataFrame, openings: DataFrame, consumer: Sequence[str], partition: Sequence[str], offset: str, bins: int = 256) -> DataFrame:
    """Every (consumer, offset) of ``points``, each once, that lies in one of the consumer's gaps; null offsets in none.

    A join by partition and part of the offsets' range: a gap is told to each of the ``bins`` parts that it touches, so
    that no offset is held against gaps far from it, and a partition with very many offsets is spread over as
    many tasks.  Partitions that are null match nothing.
    """
    low, high = points.agg(F.min(offset), F.max(offset)).first()
    if low is None:
        return points.select(*[F.lit(None).cast(openings.schema[c].dataType).alias(c) for c in consumer], offset).limit(0)
    width = max(1, -(-(high - low + 1) // bins))
    part = _bin(F.col(offset), low, width)
    ends = F.sequence(_bin(F.greatest("open_after", F.lit(low)), low, width), _bin(F.least("open_to", F.lit(high)), low, width))
    told = openings.where((F.col("open_to") >= low) & (F.col("open_after") < high)).select(*consumer, "open_after", "open_to", F.explode(ends).alias("__bin"))
    points = points.where(F.col(offset).isNotNull()).select(*partition, offset).distinct()
    met = points.withColumn("__bin", part).join(told, [*partition, "__bin"])
    return met.where((F.col(offset) > F.col("open_after")) & (F.col(offset) <= F.col("open_to"))).select(*consumer, offset)


def uncovered(log: DataFrame, consumers: DataFrame, covers: DataFrame, consumer: Sequence[str], partition: Sequence[str], offset: str, low: str, high: str) -> DataFrame:
    """Every (consumer, offset of its partition in the log) that lies in none of the consumer's ranges (see ``gaps``).

    ``partition`` names the consumer's columns shared with the log.  Null offsets count for nothing, and neither does a
    null partition; repeated consumers and log rows count once.
    """
    return within(log.select(*partition, offset), gaps(consumers, covers, consumer, low, high), consumer, partition, offset)


class CaptureJob:
    """Batches of a log with a plan written ahead, below ``root``; one job runs at a time.

    ``partition`` and ``position`` tell where a log row lies: positions rise with delivery within a partition.
    ``key`` and ``offset`` name what identifies a record in the sink.  Layout: ``planned/<n>`` (ranges per
    partition, whose marker ``plan/<n>`` is written last), ``sink/<n>``, ``offsets/<n>`` and ``done/<n>``.
    """

    def __init__(self, spark: SparkSession, root: str, partition: Sequence[str], position: str, key: Sequence[str], offset: str):
        self.spark, self.root, self.partition, self.position, self.key, self.offset = spark, root.rstrip("/"), list(partition), position, list(key), offset

    def _ids(self, kind: str) -> list[int]:
        return sorted(int(n) for n in shared.names(self.spark, f"{self.root}/{kind}") if n.isdigit())

    def open_plan(self) -> int | None:
        """The plan that was written but never committed, if any."""
        waiting = sorted(set(self._ids("plan")) - set(self._ids("done")))
        return waiting[0] if waiting else None

    def offsets(self) -> DataFrame | None:
        """The committed position of every partition, or None before the first commit."""
        done = self._ids("done")
        return self.spark.read.parquet(f"{self.root}/offsets/{done[-1]}") if done else None

    def plan(self, log: DataFrame) -> int:
        """Write the next batch's ranges down and return its number; an open plan is returned as it is."""
        if (n := self.open_plan()) is not None:
            return n
        n = (self._ids("plan") or [-1])[-1] + 1
        ends = log.groupBy(*self.partition).agg(F.max(self.position).alias("to_position"))
        if (at := self.offsets()) is not None:
            same = [F.col(f"e.{c}").eqNullSafe(F.col(f"o.{c}")) for c in self.partition]
            ends = ends.alias("e").join(at.alias("o"), same, "left").select("e.*", F.col("o.position").alias("from_position"))
        else:
            ends = ends.withColumn("from_position", F.lit(None).cast(ends.schema["to_position"].dataType))
        ends = ends.where(F.col("from_position").isNull() | (F.col("to_position") > F.col("from_position")))
        ends.write.mode("overwrite").parquet(f"{self.root}/planned/{n}")
        shared.write_text(self.spark, f"{self.root}/plan/{n}", json.dumps({"plan": n}))
        return n

    def ranges(self, n: int) -> DataFrame:
        """Per partition of plan ``n``: from_position (null: the start) < position <= to_position."""
        return self.spark.read.parquet(f"{self.root}/planned/{n}")

    def planned(self, n: int, log: DataFrame) -> DataFrame:
        """The log rows of a plan, the same ones on every run."""
        renamed = {c: f"__{c}" for c in self.partition}
        told = self.ranges(n).withColumnsRenamed(renamed)
        same = [F.col(c).eqNullSafe(F.col(r)) for c, r in renamed.items()]
        after = F.col("from_position").isNull() | (F.col(self.position) > F.col("from_position"))
        return log.join(told, [*same, after, F.col(self.position) <= F.col("to_position")], "left_semi")

    def deliver(self, n: int, rows: DataFrame) -> DataFrame:
        """Write the batch's result, one record per key and offset, and return it.

        The batch has a folder of its own, which a repeated run replaces.  Records that an earlier batch
        delivered are left out: only what lies in the batch's own range of offsets is read of those.
        """
        who = [*self.key, self.offset]
        rows = rows.dropDuplicates(who)
        if earlier := [b for b in self._ids("done") if b != n]:
            rows = shared.materialize(rows, "batch")
            low, high = rows.agg(F.min(self.offset), F.max(self.offset)).first()
            if low is not None:
                before = self.spark.read.schema(rows.schema).parquet(*[f"{self.root}/sink/{b}" for b in earlier])
                before = before.where(F.col(self.offset).between(low, high)).select(*who)
                match = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in who]
                rows = rows.alias("a").join(before.alias("b"), match, "left_anti")
        rows.sortWithinPartitions(self.offset).write.mode("overwrite").parquet(f"{self.root}/sink/{n}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/sink/{n}")

    def commit(self, n: int) -> None:
        """Store the offsets that the plan leads to; only then is it done."""
        moved = self.ranges(n).select(*self.partition, F.col("to_position").alias("position"))
        if (at := self.offsets()) is not None:
            moved = moved.unionByName(at).groupBy(*self.partition).agg(F.max("position").alias("position"))
        moved.write.mode("overwrite").parquet(f"{self.root}/offsets/{n}")
        shared.write_text(self.spark, f"{self.root}/done/{n}", json.dumps({"plan": n}))

    def run(self, log: DataFrame, process: Callable[[DataFrame], DataFrame]) -> int:
        """Plan (or take up the open plan), process, deliver and commit."""
        n = self.plan(log)
        self.deliver(n, process(self.planned(n, log)))
        self.commit(n)
        return n

    def sink(self) -> DataFrame | None:
        """All committed records."""
        done = self._ids("done")
        return self.spark.read.parquet(*[f"{self.root}/sink/{b}" for b in done]) if done else None


def covers_from_takes(takes: DataFrame, marks: DataFrame, success: Column) -> DataFrame:
    """The ranges that successful takes cover: (``remote_tx_id``, largest mark], by ``take_id``.

    Marks without ``take_id`` and takes without a mark give none; repeated lines give one.
    """
    top = marks.where(F.col("take_id").isNotNull()).groupBy("take_id").agg(F.max("highwater_tx_id").alias("__mark"))
    good = takes.where(success).select("take_id", "ring_member", "partition_name", "partition_version", "remote_tx_id").distinct()
    return good.join(top, "take_id").select("ring_member", "partition_name", "partition_version", "remote_tx_id", F.col("__mark").alias("highwater_tx_id"))
