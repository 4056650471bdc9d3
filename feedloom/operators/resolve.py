"""Last write wins: which row of a key stands, and how updates change what stood.

Order: the larger timestamp, then the larger version.  On a tie the earlier transaction
stands, and within one transaction the later row.  Tombstones take part like any row; filter
them only after resolving, or deleted values come back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.keys import free_name
from feedloom.schema import KEY


def _empty_of(df: DataFrame, col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(b"") if df.schema[col].dataType.typeName() == "binary" else F.lit(""))


def key_of(df: DataFrame, keys: Sequence[str] = KEY) -> list[Column]:
    """The key columns to group by: an absent prefix equals an empty one; other columns stay as they are."""
    return [_empty_of(df, k) if k == "prefix" else F.col(k) for k in keys]


def lww(log: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """One row per key, the one that stands.

    A rank of 1 is cut off before the shuffle as well, so a hot key sends one row per task.
    Null timestamps and versions lose against any other; null keys are a key.
    """
    (rank,) = free_name(log, "rank")
    order = [F.desc_nulls_last("ts_id"), F.desc_nulls_last("version")]
    order += [o for c, o in (("tx_id", F.asc_nulls_last("tx_id")), ("seq", F.desc_nulls_last("seq"))) if c in log.columns]
    return log.withColumn(rank, F.row_number().over(Window.partitionBy(*key_of(log, keys)).orderBy(*order))).where(F.col(rank) == 1).drop(rank)


def with_newest(log: DataFrame, keys: Sequence[str] = KEY, name: str = "newest") -> DataFrame:
    """Every row with the largest (ts_id, version) of its key as a struct ``name``.

    The maxima are pre-aggregated before the shuffle and joined back, so that a key with very many
    rows is a skewed join, which Spark splits, and not one window in one task.
    """
    held = free_name(log, *(f"k{i}" for i, _ in enumerate(keys)))
    marked = log.withColumns(dict(zip(held, key_of(log, keys))))
    tops = marked.groupBy(*[F.col(h).alias(f"{h}_") for h in held]).agg(F.max(F.struct("ts_id", "version")).alias(name))
    on = F.lit(True)
    for h in held:
        on = on & F.col(h).eqNullSafe(F.col(f"{h}_"))
    return marked.join(tops, on).drop(*held, *[f"{h}_" for h in held])


def live(rows: DataFrame) -> DataFrame:
    """Rows that aren't tombstones; a null flag counts as false."""
    return rows.where(~F.coalesce(F.col("tombstoned"), F.lit(False)))


def overlay(base: DataFrame, delta: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Stored rows with unmerged ones laid over them; per key the newer stands, the stored one on a tie."""
    return lww(base.unionByName(delta), keys)


def update_batch(updates: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """A batch of updates with one row per key: the largest timestamp, of equal ones the last put."""
    (rank,) = free_name(updates, "rank")
    order = Window.partitionBy(*key_of(updates, keys)).orderBy(F.desc_nulls_last("ts_id"), F.desc_nulls_last("seq"))
    return updates.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)


def _newer(new: str, old: str) -> Column:
    """Strictly newer; whatever ties stays as it was."""
    n, o = (F.struct(f"{a}.ts_id", f"{a}.version") for a in (new, old))
    return n > o


def _same_key(df: DataFrame, a: str, b: str, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        if k == "prefix":
            e = F.lit(b"") if df.schema[k].dataType.typeName() == "binary" else F.lit("")
            cond = cond & (F.coalesce(F.col(f"{a}.{k}"), e) == F.coalesce(F.col(f"{b}.{k}"), e))
        else:
            cond = cond & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return cond


def merge_modes(current: DataFrame, updates: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """What each update does to an index that holds ``current``: the update with ``mode``.

    ``added`` for a key not there, ``clobbered`` for a strictly newer one, else ``ignored``.  Both sides
    are resolved first, so a key has one mode.
    """
    cur, upd = lww(current, keys).alias("c"), lww(updates, keys).alias("u")
    joined = upd.join(cur, _same_key(current, "u", "c", keys), "left")
    mode = F.when(F.col("c.ts_id").isNull(), "added").when(_newer("u", "c"), "clobbered").otherwise("ignored")
    return joined.select("u.*", mode.alias("mode"))


def commit_changes(current: DataFrame, updates: DataFrame, keys: Sequence[str] = KEY, force: bool = False) -> DataFrame:
    """The change feed of a commit: applied rows with ``change`` and what they replaced.

    ``apply`` for a key not there before, ``clobber`` for one overwritten, ``remove`` where the applied
    row is a tombstone over a live row.  Updates that aren't newer are dropped unless ``force``.
    """
    cur, upd = lww(current, keys).alias("c"), lww(updates, keys).alias("u")
    joined = upd.join(cur, _same_key(current, "u", "c", keys), "left")
    fresh = F.col("c.ts_id").isNull()
    if not force:
        joined = joined.where(fresh | _newer("u", "c"))
    change = F.when(fresh, "apply").when(F.col("u.tombstoned") & ~F.col("c.tombstoned"), "remove").otherwise("clobber")
    return joined.select("u.*", change.alias("change"), F.col("c.ts_id").alias("old_ts_id"), F.col("c.tombstoned").alias("old_tombstoned"))


def merge_delta(base: DataFrame, delta: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """The base log after a merge: its own rows, and of the delta only the newest row of each key, under its own transaction."""
    return base.unionByName(lww(delta, keys))


def merge_indexes(deltas: Sequence[DataFrame], keys: Sequence[str] = KEY) -> DataFrame:
    """Any number of overlapping deltas as one."""
    out = deltas[0]
    for d in deltas[1:]:
        out = out.unionByName(d)
    return lww(out, keys)
