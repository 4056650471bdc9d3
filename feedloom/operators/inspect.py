"""Looking into a log, and holding it against what was expected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.keys import free_name
from feedloom.operators.prefix_scan import runs


def chunk_power(size: Column, least: int = 0) -> Column:
    """The power of two that holds a size: 0 for 0, else the least p >= ``least`` with 2**p >= size, by whole numbers."""
    bits = F.length(F.bin(size - 1)) - F.when(size == 1, 1).otherwise(0)
    return F.when(size == 0, 0).otherwise(F.greatest(F.lit(least), bits)).cast("int")


def size_histogram(rows: DataFrame, size: Column, least: int = 0) -> DataFrame:
    """power, n, total of sizes by power of two; rows without a size are left out."""
    sized = rows.select(size.cast("bigint").alias("s")).where(F.col("s").isNotNull())
    return sized.groupBy(chunk_power(F.col("s"), least).alias("power")).agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("total"))


def log_runs(rows: DataFrame, by: Sequence[str], kind: str, size: Column, leap: Column | None = None) -> DataFrame:
    """The log's runs of rows of one kind: where each begins, rows and bytes.  ``leap`` rows always begin a run."""
    (leaps,) = free_name(rows, "leap")
    slim = rows.select(*by, "tx_id", "seq", F.col(kind).alias(kind), size.alias("__bytes"), (leap if leap is not None else F.lit(False)).alias(leaps))
    told = runs(slim, by, ["tx_id", "seq"], kind, F.col(leaps))
    # A run is of one kind, so any of its rows tells it.
    return told.groupBy(*by, "run").agg(F.max(kind).alias(kind), F.min("tx_id").alias("start_tx"), F.count(F.lit(1)).alias("n"), F.sum("__bytes").alias("bytes"))


def partition_totals(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per partition: rows, tombstones, keys, first and last transaction."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(F.col("tombstoned"), F.lit(False))).alias("tombstones"),
        F.min("tx_id").alias("first_tx"),
        F.max("tx_id").alias("last_tx"),
    )


def by_name(rows: DataFrame, column: str, text: str, exact: bool = False) -> DataFrame:
    """Rows whose name is ``text``, or holds it."""
    return rows.where(F.col(column) == text) if exact else rows.where(F.col(column).contains(text))


def snapshot_verify(actual: DataFrame, expected: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys on which a state and an expected map disagree: missing, extra or differs."""
    a, e = actual.select(*keys, value).alias("a"), expected.select(*keys, value).alias("e")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"e.{k}"))
    here, there = F.lit(True).alias("__here"), F.lit(True).alias("__there")
    a, e = a.select("*", here).alias("a"), e.select("*", there).alias("e")
    told = F.when(F.col("a.__here").isNull(), "missing").when(F.col("e.__there").isNull(), "extra").when(~F.col(f"a.{value}").eqNullSafe(F.col(f"e.{value}")), "differs")
    return a.join(e, on, "full_outer").select(*[F.coalesce(f"a.{k}", f"e.{k}").alias(k) for k in keys], told.alias("outcome")).where(F.col("outcome").isNotNull())
