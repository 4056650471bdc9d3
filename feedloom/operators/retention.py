"""What a compaction keeps, drops and counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.resolve import with_newest
from feedloom.schema import KEY, PRIMARY_TYPES


@dataclass(frozen=True)
class Cutoffs:
    """Rows below a cut-off go; 0 is no cut-off."""

    tombstone_ts: int = 0
    tombstone_version: int = 0
    ttl_ts: int = 0
    ttl_version: int = 0
    disposal_version: int = 0


@dataclass(frozen=True)
class Ages:
    """Ages and intervals in milliseconds; an age of 0 switches a rule off."""

    tombstone_ts: int = 0
    tombstone_ts_interval: int = 0
    tombstone_version: int = 0
    tombstone_version_interval: int = 0
    ttl_ts: int = 0
    ttl_ts_interval: int = 0
    ttl_version: int = 0
    ttl_version_interval: int = 0

    def cutoffs(self, now_ms: int, disposal_version: int = 0, checking: bool = False, id_bits: int = 12, epoch_ms: int = 0) -> Cutoffs:
        """The cut-offs at ``now_ms``: for checking, an age counts with its interval, so that compacting starts late
        and then goes all the way.  Versions are time-ordered ids with ``id_bits`` below the millisecond."""

        def at(age: int, interval: int) -> int:
            return now_ms - age - (interval if checking else 0) if age > 0 else 0

        def as_id(ms: int) -> int:
            return (ms - epoch_ms) << id_bits if ms > epoch_ms else 0

        return Cutoffs(
            at(self.tombstone_ts, self.tombstone_ts_interval),
            as_id(at(self.tombstone_version, self.tombstone_version_interval)),
            at(self.ttl_ts, self.ttl_ts_interval),
            as_id(at(self.ttl_version, self.ttl_version_interval)),
            disposal_version,
        )


def _below(column: str, cut: int) -> Column:
    return F.coalesce(F.col(column) < F.lit(cut), F.lit(False)) if cut > 0 else F.lit(False)


def classify(log: DataFrame, cut: Cutoffs, keys: Sequence[str] = KEY) -> DataFrame:
    """Every log row with ``fate``, by the first rule that fits: clobber, tombstone, ttl, disposal, else keep.

    A row is clobbered if its key has a strictly newer one, so exact repeats survive.  Markers of the
    log (row types highwater and end_of_merge) are kept and system rows dropped, if there is a
    ``row_type``.
    """
    fate = (
        F.when(F.struct("ts_id", "version") < F.col("__top"), "clobber")
        .when(F.coalesce(F.col("tombstoned"), F.lit(False)) & (_below("ts_id", cut.tombstone_ts) | _below("version", cut.tombstone_version)), "tombstone")
        .when(_below("ts_id", cut.ttl_ts) | _below("version", cut.ttl_version), "ttl")
        .when(_below("version", cut.disposal_version), "disposal")
        .otherwise("keep")
    )
    if "row_type" not in log.columns:
        return with_newest(log, keys, "__top").withColumn("fate", fate).drop("__top")
    rows = with_newest(log.where(F.col("row_type").isin(*PRIMARY_TYPES)), keys, "__top").withColumn("fate", fate).drop("__top")
    marks = log.where(~F.col("row_type").isin(*PRIMARY_TYPES))
    return rows.unionByName(marks.withColumn("fate", F.when(F.col("row_type") == "system", "system").otherwise("keep")))


def compact(log: DataFrame, cut: Cutoffs, keys: Sequence[str] = KEY) -> DataFrame:
    """The rows that a compaction writes on."""
    return classify(log, cut, keys).where(F.col("fate") == "keep").drop("fate")


def stats_of(fates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per fate, and the oldest timestamp and version of kept live and tombstoned rows (null if none), per ``by``."""
    kept = F.col("fate") == "keep"
    dead = F.coalesce(F.col("tombstoned"), F.lit(False))
    counts = [F.count_if(F.col("fate") == f).alias(f"{f}s") for f in ("clobber", "tombstone", "ttl", "disposal", "keep")]
    oldest = [
        F.min(F.when(kept & (dead if gone else ~dead), F.col(c))).alias(f"oldest_{'tombstoned_' if gone else ''}{c}") for gone in (False, True) for c in ("ts_id", "version")
    ]
    return fates.groupBy(*by).agg(*counts, *oldest)


def purge_stats(log: DataFrame, cut: Cutoffs, keys: Sequence[str] = KEY, by: Sequence[str] = ()) -> DataFrame:
    """What a compaction by ``cut`` would count (see ``stats_of``)."""
    return stats_of(classify(log, cut, keys), by)


def should_compact(log: DataFrame, check: Cutoffs, factor: int = 2, keys: Sequence[str] = KEY, whole_division: bool = True) -> DataFrame:
    """One row: ``needed``, whether anything lies below a checking cut-off or clobbered rows are more than ``factor`` times the keys.

    ``whole_division`` rounds that quotient down, as the source of these rules does.
    """
    dead = F.coalesce(F.col("tombstoned"), F.lit(False))
    old = (dead & (_below("ts_id", check.tombstone_ts) | _below("version", check.tombstone_version))) | (
        ~dead & (_below("ts_id", check.ttl_ts) | _below("version", check.ttl_version) | _below("version", check.disposal_version))
    )
    rows = classify(log, Cutoffs(), keys)
    told = rows.agg(
        F.coalesce(F.bool_or(old & (F.col("fate") == "keep")), F.lit(False)).alias("old"),
        F.count_if(F.col("fate") == "clobber").alias("clobbers"),
        F.count_if(F.col("fate") == "keep").alias("held"),
    )
    ratio = F.call_function("div", F.col("clobbers") + 1, F.col("held") + 1) if whole_division else (F.col("clobbers") + 1) / (F.col("held") + 1)
    return told.select("clobbers", "held", (F.col("old") | (ratio > factor)).alias("needed"))


def compact_partitions(log: DataFrame, properties: DataFrame, now_ms: int, keys: Sequence[str] = ("partition_name", *KEY)) -> DataFrame:
    """The fates of the rows of many partitions, each by its own properties.

    ``properties`` has partition_name, tombstone_age_ms, ttl_age_ms (0 or null: off) and disposal_version
    (null: none).  Partitions without properties only lose clobbered rows.
    """
    props = properties.select("partition_name", "tombstone_age_ms", "ttl_age_ms", "disposal_version").dropDuplicates(["partition_name"])
    rows = with_newest(log, keys, "__top").join(props, "partition_name", "left")
    older = lambda age: F.coalesce((F.col(age) > 0) & (F.col("ts_id") < F.lit(now_ms) - F.col(age)), F.lit(False))
    fate = (
        F.when(F.struct("ts_id", "version") < F.col("__top"), "clobber")
        .when(F.coalesce(F.col("tombstoned"), F.lit(False)) & older("tombstone_age_ms"), "tombstone")
        .when(older("ttl_age_ms"), "ttl")
        .when(F.coalesce(F.col("version") < F.col("disposal_version"), F.lit(False)), "disposal")
        .otherwise("keep")
    )
    return rows.withColumn("fate", fate).drop("__top", "tombstone_age_ms", "ttl_age_ms", "disposal_version")
