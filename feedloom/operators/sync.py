"""Carrying one log over to another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.prefix_scan import runs
from feedloom.operators.resolve import key_of


def window_shift(rows: DataFrame, from_ts: int = 0, to_ts: int = 0, from_version: int = 0, to_version: int = 0, shift_ms: int = 0) -> DataFrame:
    """Rows strictly inside the bounds on timestamp and version (0 or less: unbounded), their timestamps shifted, tombstones too."""
    for column, low, high in (("ts_id", from_ts, to_ts), ("version", from_version, to_version)):
        if low > 0:
            rows = rows.where(F.col(column) > low)
        if high > 0:
            rows = rows.where(F.col(column) < high)
    return rows.withColumn("ts_id", F.col("ts_id") + F.lit(shift_ms))


def cursor(taken: DataFrame, member: str = "replica") -> DataFrame:
    """Per member: largest tx_id, timestamp and version of everything taken, whatever the filter left."""
    return taken.groupBy(member).agg(F.max("tx_id").alias("tx_id"), F.max("ts_id").alias("max_ts_id"), F.max("version").alias("max_version"))


def prefix_batches(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What a receiver commits at once: neighbours in the log with one prefix; run, prefix, rows, first and last tx_id."""
    slim = rows.select(*by, "tx_id", "seq", key_of(rows, ("prefix",))[0].alias("prefix"))
    told = runs(slim, by, ["tx_id", "seq"], "prefix")
    return told.groupBy(*by, "run").agg(F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("n"), F.min("tx_id").alias("first_tx"), F.max("tx_id").alias("last_tx"))


def stripe_of(name: Column, stripes: int) -> Column:
    """The stripe that syncs a partition, by a hash that is the same everywhere."""
    return F.pmod(F.xxhash64(name), F.lit(stripes))
