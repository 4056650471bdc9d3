"""Change feeds: log rows beyond a transaction, cut only between transactions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.keys import prefix_is
from feedloom.operators.resolve import lww


def take_since(log: DataFrame, since: int, limit: int = 0) -> DataFrame:
    """Rows with tx_id > ``since``, tombstones and superseded ones included.

    With a limit, rows go on to the end of the transaction in which the limit is reached; 0 or less
    means no limit.  The cut is found by a top-k of the rows' order, never by ordering them all.
    """
    rows = log.where(F.col("tx_id") > F.lit(since))
    if limit <= 0:
        return rows
    first = rows.select("tx_id", "seq").orderBy("tx_id", "seq").limit(limit)
    return rows.where(F.col("tx_id") <= first.agg(F.max("tx_id")).scalar())


def take_prefix_since(log: DataFrame, prefix: Any, since: int, limit: int = 0) -> DataFrame:
    """The same for the rows of one prefix, which must be given; an empty one takes the rows without prefix too."""
    if prefix is None:
        raise ValueError("a prefix is needed")
    return take_since(log.where(prefix_is(F.col("prefix"), prefix)), since, limit)


def take_each(log: DataFrame, partition: Sequence[str], offsets: DataFrame | None, limit: int) -> DataFrame:
    """The limited take of every partition at once, each from its own offset (``tx_id`` in ``offsets``; none: the start)."""
    rows = log
    if offsets is not None:
        done = offsets.select(*partition, F.col("tx_id").alias("__done"))
        rows = rows.join(done, list(partition), "left").where(F.col("__done").isNull() | (F.col("tx_id") > F.col("__done"))).drop("__done")
    if limit <= 0:
        return rows
    nth = F.row_number().over(Window.partitionBy(*partition).orderBy("tx_id", "seq"))
    stop = rows.select(*partition, "tx_id", "seq").withColumn("__n", nth).where(F.col("__n") <= limit).groupBy(*partition).agg(F.max("tx_id").alias("__stop"))
    return rows.join(stop, list(partition)).where(F.col("tx_id") <= F.col("__stop")).drop("__stop")


def take_until_rejected(log: DataFrame, since: int, rejected: Column) -> DataFrame:
    """Rows of the transactions before the first one with a rejected row."""
    rows = log.where(F.col("tx_id") > F.lit(since))
    first = rows.where(rejected).agg(F.min("tx_id")).scalar()
    return rows.where(first.isNull() | (F.col("tx_id") < first))


def take_until_accepted(log: DataFrame, since: int, stop: Column) -> DataFrame:
    """Rows up to the end of the transaction that holds the first row at which the consumer had enough."""
    rows = log.where(F.col("tx_id") > F.lit(since))
    first = rows.where(stop).agg(F.min("tx_id")).scalar()
    return rows.where(first.isNull() | (F.col("tx_id") <= first))


def took_to_end(log: DataFrame, taken: DataFrame) -> DataFrame:
    """One row: last_tx of the take, and whether it reached the log's end (an empty log is at its end)."""
    end = log.agg(F.max("tx_id")).scalar()
    last = taken.agg(F.max("tx_id").alias("last_tx"))
    return last.select("last_tx", F.coalesce(F.col("last_tx") == end, end.isNull()).alias("to_end"))


def snapshot_at(log: DataFrame, tx_id: int | Column) -> DataFrame:
    """The state as of a transaction: later ones don't exist yet."""
    return lww(log.where(F.col("tx_id") <= (tx_id if isinstance(tx_id, Column) else F.lit(tx_id))))


def resume(log: DataFrame, cursors: DataFrame, member: str = "replica") -> DataFrame:
    """Rows of every member beyond its cursor (``tx_id``); a member without one starts at -1."""
    at = cursors.groupBy(member).agg(F.max("tx_id").alias("__at"))
    return log.join(at, member, "left").where(F.col("tx_id") > F.coalesce("__at", F.lit(-1))).drop("__at")


def cursors_after(taken: DataFrame, cursors: DataFrame, member: str = "replica") -> DataFrame:
    """The cursors once the taken rows are done with: the larger transaction per member."""
    return taken.select(member, "tx_id").unionByName(cursors.select(member, "tx_id")).groupBy(member).agg(F.max("tx_id").alias("tx_id"))


def available(log: DataFrame, offsets: DataFrame, partition: Sequence[str], member: str) -> DataFrame:
    """Per (member, partition) that has news: its offset ``took`` and the partition's ``highest`` transaction."""
    top = log.groupBy(*partition).agg(F.max("tx_id").alias("highest"))
    took = offsets.groupBy(member, *partition).agg(F.max("tx_id").alias("took"))
    return took.join(top, list(partition)).where(F.col("highest") > F.col("took")).select(member, *partition, "took", "highest")


def data_rows(log: DataFrame) -> DataFrame:
    """The log without its markers; a log without ``row_type`` has none."""
    return log.where(F.col("row_type").isin("primary", "snappy_primary")) if "row_type" in log.columns else log


def marks(log: DataFrame) -> DataFrame:
    """The highwaters interleaved in a feed: tx_id, member, mark.  Such a row holds the member as its key and
    the mark, in digits, as its value."""
    rows = log.where(F.col("row_type") == "highwater")
    return rows.select("tx_id", F.decode(F.col("key"), "UTF-8").alias("member"), F.decode(F.col("value"), "UTF-8").cast("bigint").alias("mark"))
