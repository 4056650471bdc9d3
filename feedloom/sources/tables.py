"""The given tables, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.keys import fingerprint, norm_prefix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed with one spelling of the absent prefix."""
    return table(spark, sf_dir, "feed_rows").withColumn("prefix", norm_prefix("prefix"))


#: What names a message of the feed.
MESSAGE = ("partition_name", "tx_id", "prefix", "row_key", "value_version")


def messages(rows: DataFrame, *carried: str) -> DataFrame:
    """Each message of the feed once: partition_name, tx_id, ``delivery_id`` and ``carried`` of its first delivered copy.

    Messages are told apart by their partition, transaction and 128 bits over the rest of their name, so that no
    long keys are shuffled; two messages of one transaction fall together with a chance of n*n / 2**129.
    """
    rest = [F.col(c) for c in MESSAGE[2:]]
    first = [F.min_by(F.col(c), F.col("delivery_id")).alias(c) for c in carried]
    one = rows.groupBy("partition_name", "tx_id", fingerprint(rest, 3).alias("__hi"), fingerprint(rest, 5).alias("__lo"))
    return one.agg(F.min("delivery_id").alias("delivery_id"), *first).drop("__hi", "__lo")
