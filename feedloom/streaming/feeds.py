"""Logs as streams: watching, replicating, syncing, and correcting aggregates batch by batch.

Every sink works by ``foreachBatch`` and is safe to repeat: what it writes is named by the
batch, or skipped if the batch was taken in before.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.operators import differential as diff
from feedloom.operators.delete_vectors import DeleteVectorTable
from feedloom.operators.identifier_index import IdentifierIndex
from feedloom.operators.sync import cursor, window_shift
from feedloom.schema import LOG
from feedloom.sources import shared
from feedloom.sources.log_store import LogStore


def log_stream(spark: SparkSession, path: str, schema=LOG, max_files: int = 100) -> DataFrame:
    """The rows of a log folder as a stream; at most ``max_files`` files a batch, so that a backlog is taken in steps."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def watch(stream: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call back with every batch of new rows; runs until all there is has been seen."""
    return stream.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replicate(stream: DataFrame, store: LogStore, checkpoint: str, member: str | None = None, resolve: bool = False) -> StreamingQuery:
    """Apply a stream of log rows to another log, as one member takes from another.

    Each batch advances the highwater of ``member`` together with its rows, which is what acknowledges them; a repeated
    batch adds nothing.  With ``resolve`` rows no newer than what stands are dropped on arrival, so the
    replica has the same state but not the same history.  A store with too many pending rows is merged first.
    """

    def step(rows: DataFrame, _: int) -> None:
        if store.mergeable():
            store.merge()
        store.append(rows, member, resolve)

    return watch(stream, step, checkpoint)


def sync(stream: DataFrame, store: LogStore, cursors: str, checkpoint: str, member: str = "replica", **window: int) -> StreamingQuery:
    """Filter, shift and commit a stream's rows to another log, and keep the cursors of everything taken below ``cursors``.

    The target gives its own transactions and versions, and drops what isn't newer than what it has, so a
    batch applied again changes nothing.
    """

    def step(rows: DataFrame, batch: int) -> None:
        if store.mergeable():
            store.merge()
        store.commit(window_shift(rows, **window).select("prefix", "key", "value", "ts_id", "tombstoned", "seq"))
        cursor(rows, member).write.mode("overwrite").parquet(f"{cursors}/{batch}")

    return watch(stream, step, checkpoint)


def read_cursors(spark: SparkSession, cursors: str, member: str = "replica", from_member: str | None = None, to_member: str | None = None) -> DataFrame:
    """How far each member's sync is; of members from ``from_member`` (inclusive) to ``to_member`` (exclusive) where given."""
    got = [f"{cursors}/{n}" for n in shared.names(spark, cursors)]
    rows = spark.read.parquet(*got)
    if from_member is not None:
        rows = rows.where(F.col(member) >= from_member)
    if to_member is not None:
        rows = rows.where(F.col(member) < to_member)
    return rows.groupBy(member).agg(*[F.max(c).alias(c) for c in ("tx_id", "max_ts_id", "max_version")])


def reset_cursors(spark: SparkSession, cursors: str, checkpoint: str) -> None:
    """Forget how far a sync is: the next run takes everything again, which changes nothing that stands."""
    shared.remove(spark, cursors)
    shared.remove(spark, checkpoint)


def apply_changes(stream: DataFrame, table: DeleteVectorTable, checkpoint: str) -> StreamingQuery:
    """Rebuild a table's current state from a stream of changes."""
    return watch(stream, lambda rows, batch: table.apply(rows, f"stream-{batch}"), checkpoint)


def drop_repeats(stream: DataFrame, index: IdentifierIndex, checkpoint: str) -> StreamingQuery:
    """Take a stream of messages into an index of identifiers; ``index.kept()`` tells the copies kept."""
    return watch(stream, lambda rows, batch: index.offer(rows, f"stream-{batch}"), checkpoint)


class DifferentialState:
    """Counts per key and period, kept as versioned state below ``root``, one version per batch.

    Batches come in the order of delivery; transactions in them come in any order.  ``messages/<v>`` holds the
    messages that version v made known or took back, ``tops/<v>`` the event times it brought per
    transaction, ``deltas/<v>`` the signed deltas it caused: all of them are only added to.  A message delivered
    again counts once; a batch that was taken in before is skipped.  Only groups that a batch touches are judged anew.
    """

    def __init__(self, spark: SparkSession, root: str, identity: Sequence[str], by: Sequence[str], keys: dict[str, Column], tx: str, event_time: str, cutoff: str):
        self.spark, self.root, self.identity, self.by, self.keys = spark, root.rstrip("/"), list(identity), list(by), keys
        self.tx, self.event_time, self.cutoff = tx, event_time, cutoff

    def _versions(self) -> list[int]:
        return sorted(int(n) for n in shared.names(self.spark, f"{self.root}/done") if n.isdigit())

    def _past(self, what: str, like: DataFrame) -> DataFrame:
        """What earlier versions hold; nothing, with the columns of ``like``, before the first."""
        paths = [f"{self.root}/{what}/{v}" for v in self._versions()]
        return self.spark.read.schema(like.schema).parquet(*paths) if paths else like.limit(0)

    def apply(self, batch: DataFrame, version: int) -> None:
        """Take in a batch whose rows carry the columns of ``identity``, ``by``, ``tx``, ``event_time``, ``cutoff`` and those of ``keys``."""
        if version in self._versions():
            return
        ids = [f"__i{i}" for i, _ in enumerate(self.identity)]
        groups = [f"__g{i}" for i, _ in enumerate(self.by)]
        held = {**{f"__i{i}": F.col(c) for i, c in enumerate(self.identity)}, **{f"__g{i}": F.col(c) for i, c in enumerate(self.by)}}
        held |= {"__tx": F.col(self.tx), "__t": F.col(self.event_time), "__cut": F.col(self.cutoff).cast("bigint"), **self.keys}
        timed = batch.where(F.col(self.event_time) > 0).select(*[e.alias(c) for c, e in held.items()])
        rest = [c for c in held if c not in ids]
        first = timed.groupBy(*ids).agg(F.min(F.struct(*rest)).alias("__r")).select(*ids, "__r.*")
        first = first.withColumns({"__counts": F.lit(True), "__version": F.lit(version).cast("bigint")})
        past = self._past("messages", first)
        # A message is told at most twice: when it becomes known and when it is taken back.
        known = past.groupBy(*ids).agg(F.max_by(F.struct(*rest, "__counts"), "__version").alias("__r")).select(*ids, "__r.*")
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ids]
        new = first.drop("__counts", "__version").alias("a").join(past.select(*ids).alias("b"), same, "left_anti")
        tops = timed.groupBy(*groups, "__tx").agg(F.max("__t").alias("__t"))
        tops.write.mode("overwrite").parquet(f"{self.root}/tops/{version}")
        tops = self.spark.read.schema(tops.schema).parquet(f"{self.root}/tops/{version}")
        touched = tops.select(*groups).distinct()
        line = self._past("tops", tops).join(touched, groups, "left_semi").unionByName(tops)
        frontier = diff.event_frontier(line, groups, "__tx", "__t")
        counted = known.where("__counts").drop("__counts").join(touched, groups, "left_semi")
        judged = counted.withColumn("__was", F.lit(True)).unionByName(new.withColumn("__was", F.lit(False))).join(frontier, [*groups, "__tx"], "left")
        late = F.coalesce(F.element_at("frontier", 1) - F.col("__t") > F.col("__cut"), F.lit(False))
        told = judged.where(~F.col("__was") | late).select(*held, (~late).alias("__counts"), F.lit(version).cast("bigint").alias("__version"), "__was")
        told = shared.materialize(told, "told")
        told.drop("__was").write.mode("overwrite").parquet(f"{self.root}/messages/{version}")
        sign = F.when(F.col("__was"), -1).when(F.col("__counts"), 1).otherwise(0).cast("bigint")
        names = list(self.keys)
        change = shared.materialize(diff.changes_of(told, {k: F.col(k) for k in names}, F.lit(version).cast("bigint"), {"n": sign}).where("n <> 0"), "changes")
        before = self._past("deltas", diff.signed_deltas(change, names, ["n"]))
        before = before.alias("s").join(change.select(*names).alias("c"), [F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")) for k in names], "left_semi")
        stood = diff.fold(before, names, ["n"]).select(*names, F.lit(-1).cast("bigint").alias("version"), "n")
        deltas = diff.signed_deltas(stood.unionByName(change), names, ["n"]).where(F.col("version") == version)
        deltas.write.mode("overwrite").parquet(f"{self.root}/deltas/{version}")
        shared.write_text(self.spark, f"{self.root}/done/{version}", json.dumps({"version": version}))

    def state(self) -> DataFrame | None:
        """The counts as they stand, or None before the first batch."""
        return diff.fold(self.deltas(), list(self.keys), ["n"]) if self._versions() else None

    def deltas(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/deltas/{v}" for v in self._versions()])

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return watch(stream, self.apply, checkpoint)
