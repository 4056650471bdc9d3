"""Point, slice, range and filtered reads, in key order: prefix first, then key.

All take the resolved state (see ``resolve.lww``) unless they say otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.keys import prefix_is
from feedloom.operators.resolve import key_of, live, lww


@dataclass(frozen=True)
class KeyRange:
    """From (inclusive) and to (exclusive) over (prefix, key).  A bound holds only if its key is given."""

    from_prefix: Any = None
    from_key: Any = None
    to_prefix: Any = None
    to_key: Any = None

    def check(self) -> None:
        if self.from_key is not None and self.to_key is not None:
            empty = b"" if isinstance(self.from_key, bytes) else ""
            if (self.from_prefix or empty, self.from_key) > (self.to_prefix or empty, self.to_key):
                raise ValueError("the range begins after its end")

    def holds(self, prefix: Column, key: Column) -> Column:
        """The bounds spelled out over the bare columns, so that both reach the files as filters."""
        self.check()
        empty = b"" if isinstance(self.from_key if self.from_key is not None else self.to_key, bytes) else ""
        absent = prefix.isNull() | (prefix == F.lit(empty))
        cond = F.lit(True)
        if self.from_key is not None:
            at = (prefix == F.lit(self.from_prefix)) if self.from_prefix else absent
            cond = cond & ((prefix > F.lit(self.from_prefix or empty)) | (at & (key >= F.lit(self.from_key))))
        if self.to_key is not None:
            if self.to_prefix:
                cond = cond & (prefix.isNull() | (prefix < F.lit(self.to_prefix)) | ((prefix == F.lit(self.to_prefix)) & (key < F.lit(self.to_key))))
            else:
                cond = cond & absent & (key < F.lit(self.to_key))
        return cond


def in_key_order(rows: DataFrame, *first: str) -> DataFrame:
    """Rows by ``first``, then prefix (an absent one as an empty one), then key."""
    return rows.orderBy(*first, *key_of(rows, ("prefix", "key")))


def _requested(log: DataFrame, prefix: Any, keys: Sequence[Any] | DataFrame) -> DataFrame:
    """Asked keys with their place.  A list is at most what its caller holds; a DataFrame has ``pos`` and ``key``."""
    if isinstance(keys, DataFrame):
        return keys.select("pos", "key")
    kind = log.schema["key"].dataType.simpleString()
    return log.sparkSession.createDataFrame([(i, k) for i, k in enumerate(keys)], f"pos int, key {kind}")


def _found(log: DataFrame, prefix: Any, asked: DataFrame) -> DataFrame:
    """The standing rows of the asked keys: the log is cut down to them before it is resolved."""
    mine = log.where(prefix_is(F.col("prefix"), prefix))
    return lww(mine.join(asked.select("key").distinct(), "key", "left_semi"))


def get_raw(log: DataFrame, prefix: Any, keys: Sequence[Any] | DataFrame) -> DataFrame:
    """pos, key, value, ts_id, version, tombstoned for every asked key, in request order; nulls for a key never written."""
    asked = _requested(log, prefix, keys)
    rows = _found(log, prefix, asked).select("key", "value", "ts_id", "version", "tombstoned")
    return asked.join(rows, "key", "left").select("pos", "key", "value", "ts_id", "version", "tombstoned").orderBy("pos")


def multi_get(log: DataFrame, prefix: Any, keys: Sequence[Any] | DataFrame) -> DataFrame:
    """pos, key, value, ts_id, version; a missing or deleted key gives (null, -1, -1)."""
    raw = get_raw(log, prefix, keys)
    there = F.col("ts_id").isNotNull() & ~F.coalesce(F.col("tombstoned"), F.lit(False))
    return raw.select(
        "pos", "key", F.when(there, F.col("value")).alias("value"), F.when(there, F.col("ts_id")).otherwise(-1).alias("ts_id"), F.when(there, F.col("version")).otherwise(-1).alias("version")
    )


def contains_keys(log: DataFrame, prefix: Any, keys: Sequence[Any] | DataFrame) -> DataFrame:
    """pos, key, contained, ts_id, version; contained means written and not deleted."""
    raw = get_raw(log, prefix, keys)
    there = F.col("ts_id").isNotNull() & ~F.coalesce(F.col("tombstoned"), F.lit(False))
    return raw.select("pos", "key", there.alias("contained"), F.coalesce("ts_id", F.lit(-1)).alias("ts_id"), F.coalesce("version", F.lit(-1)).alias("version"))


def timestamped_get(log: DataFrame, prefix: Any, key: Any) -> DataFrame:
    """value, ts_id, version of one key; no row if it is missing or deleted."""
    rows = log.where(prefix_is(F.col("prefix"), prefix) & (F.col("key") == F.lit(key)))
    return live(lww(rows)).select("value", "ts_id", "version")


def value_slice(value: Column, offset: Column, length: Column) -> Column:
    """The slice of a value: all of it for offset 0 and enough length (an empty value too), else null at or beyond its end.

    Negative offsets and lengths give null.
    """
    size = F.length(value)
    part = F.substring(value, offset.cast("int") + 1, F.least(length, size - offset).cast("int"))
    return F.when((offset == 0) & (length >= size), value).when((offset >= 0) & (offset < size) & (length >= 0), part)


def get_offset(log: DataFrame, prefix: Any, asks: DataFrame) -> DataFrame:
    """pos, key, slice, ts_id, version for asks of (pos, key, offset, length); a missing or deleted key gives (null, -1, -1)."""
    rows = live(_found(log, prefix, asks)).select("key", "value", "ts_id", "version")
    return asks.join(rows, "key", "left").select(
        "pos", "key", value_slice(F.col("value"), F.col("offset"), F.col("length")).alias("slice"), F.coalesce("ts_id", F.lit(-1)).alias("ts_id"), F.coalesce("version", F.lit(-1)).alias("version")
    )


def scan(state: DataFrame, key_range: KeyRange | None = None, hydrate: bool = True) -> DataFrame:
    """Live rows in key order, of one range or all; without values if not ``hydrate``."""
    rows = live(state)
    if key_range is not None:
        rows = rows.where(key_range.holds(F.col("prefix"), F.col("key")))
    if not hydrate:
        rows = rows.select(*[c for c in rows.columns if c != "value"])
    return in_key_order(rows)


def range_scan(log: DataFrame, key_range: KeyRange, hydrate: bool = True) -> DataFrame:
    """The live rows of a range of an unresolved log.  The range is cut out before resolving, which a key's rows
    all share; tombstones only after it."""
    return scan(lww(log.where(key_range.holds(F.col("prefix"), F.col("key")))), None, hydrate)


def multi_range_scan(state: DataFrame, ranges: Sequence[KeyRange]) -> DataFrame:
    """Live rows with ``range_id``, by range and then key; a row in several ranges comes several times.

    The ranges are part of the plan: one pass over the rows, no join.
    """
    hits = F.array_compact(F.array(*[F.when(r.holds(F.col("prefix"), F.col("key")), F.lit(i)) for i, r in enumerate(ranges)])) if ranges else F.array().cast("array<int>")
    rows = live(state)
    return in_key_order(rows.select(F.explode(hits).alias("range_id"), *rows.columns), "range_id")


def scan_filtered(state: DataFrame, keep: Column | Callable[[DataFrame], DataFrame], key_range: KeyRange | None = None) -> DataFrame:
    """Live rows that a filter keeps.  A Column is pushed to the files; a function may drop, change or multiply rows
    (``mapInArrow`` inside it for Python code)."""
    rows = live(state)
    if key_range is not None:
        rows = rows.where(key_range.holds(F.col("prefix"), F.col("key")))
    return rows.where(keep) if isinstance(keep, Column) else keep(rows)


def above_disposal(state: DataFrame, disposal_version: int | Column | None) -> DataFrame:
    """Resolved rows not hidden by a disposal: version at or above it.  Null hides nothing."""
    if disposal_version is None:
        return state
    cut = disposal_version if isinstance(disposal_version, Column) else F.lit(disposal_version)
    return state.where(cut.isNull() | (F.col("version") >= cut))


def exact_count(log: DataFrame) -> DataFrame:
    """One row: the live keys."""
    return live(lww(log)).agg(F.count(F.lit(1)).alias("n"))


def approximate_count(base: DataFrame, delta: DataFrame) -> DataFrame:
    """One row: keys of the stored rows plus keys of the pending ones, deleted and doubled ones included."""
    b = lww(base).agg(F.count(F.lit(1)).alias("n"))
    d = lww(delta).agg(F.count(F.lit(1)).alias("n"))
    return b.unionByName(d).agg(F.sum("n").alias("n"))


def replica_count(counts: DataFrame) -> DataFrame:
    """One row: the largest of several replicas' counts ``n``, what an approximate count over replicas is; 0 without any."""
    return counts.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))


def delta_count(base: DataFrame, delta: DataFrame) -> DataFrame:
    """One row: live stored keys corrected by what each pending key does: +1, 0 or -1."""
    b, d = lww(base), lww(delta)
    rows = b.withColumn("__side", F.lit(0)).unionByName(d.withColumn("__side", F.lit(1)))
    was = F.max(F.when(F.col("__side") == 0, ~F.col("tombstoned")))
    per = rows.groupBy(*key_of(rows)).agg(was.alias("was"), F.max_by("tombstoned", F.struct("ts_id", "version", -F.col("tx_id"))).alias("gone"))
    now = ~F.col("gone")
    step = F.when(now & ~F.coalesce("was", F.lit(False)), 1).when(~now & F.coalesce("was", F.lit(False)), -1).otherwise(0)
    return per.agg((F.sum(F.coalesce("was", F.lit(False)).cast("bigint")) + F.sum(step)).alias("n"))
