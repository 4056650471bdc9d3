"""Logs made up for soak tests and benchmarks, the same for the same seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def random_log(spark: SparkSession, rows: int, keys: int, prefixes: int = 4, hot: float = 0.0, tombstones: float = 0.3, seed: int = 1, per_tx: int = 8) -> DataFrame:
    """Puts and deletes in random order of event time.  ``hot`` is the share of rows on one key."""

    def pick(what: str, n: int):
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.col("id")), F.lit(n).cast("bigint"))

    part = lambda what, share: pick(what, 1_000_000) < int(share * 1_000_000)
    key = F.when(part("hot", hot), F.lit(0)).otherwise(pick("key", keys))
    dead = part("dead", tombstones)
    return spark.range(rows).select(
        F.call_function("div", F.col("id"), F.lit(per_tx).cast("bigint")).alias("tx_id"),
        F.col("id").alias("seq"),
        F.concat(F.lit("p"), (key % prefixes).cast("string")).alias("prefix"),
        F.concat(F.lit("k"), F.lpad(key.cast("string"), 9, "0")).alias("key"),
        F.when(~dead, F.hex(pick("value", 1 << 40))).alias("value"),
        (pick("time", 10 * rows + 1) + 1).alias("ts_id"),
        dead.alias("tombstoned"),
        (F.col("id") + 1).alias("version"),
    )
