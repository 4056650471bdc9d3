"""Aggregates by event time, corrected by signed deltas when late records arrive.

The feed comes in versions: slices of the order of delivery, whatever order its transactions are
in.  A message counts from the version it comes with.  When a smaller transaction with a later event
time is delivered after it, the message may turn out to lie behind the cut-off; the version that
tells so takes it back.  Every change of an aggregate is told downstream as a retraction of the
old value (sign -1) and an assertion of the new one (sign +1), both carrying the version of the state
that made them.  Folding the signed rows up to a version gives the aggregates as they stood
then; folding all gives the corrected ones.  Deltas of one stage are the input of the next, so a
rollup of a rollup is corrected in the same way.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.keys import free_name
from feedloom.operators.prefix_scan import prefix_scan

HOUR_MS = 3_600_000


def version_of(sequence: Column, low: int, high: int, versions: int) -> Column:
    """The version 1..``versions`` of a delivery: equal slices of the range of its sequence numbers."""
    width = max(1, -(-(high - low + 1) // versions))
    return F.least(F.call_function("div", sequence - F.lit(low), F.lit(width).cast("bigint")) + 1, F.lit(versions).cast("bigint"))


def event_frontier(log: DataFrame, by: Sequence[str], tx: str, event_time: str, version: str | None = None, versions: int = 1) -> DataFrame:
    """One row per (``by``, ``tx``): ``frontier``, the largest event time of all smaller transactions as of each version.

    An array of ``versions`` entries; entry v leaves out what was delivered after version v.  The log is
    reduced to transactions before anything is ordered, and all versions are scanned at once.  The entry
    is null where no smaller transaction has an event time.
    """
    come = F.col(version) if version else F.lit(1)
    upto = {f"__f{v}": F.max(F.when(come <= v, F.col(event_time))) for v in range(1, versions + 1)}
    per_tx = log.groupBy(*by, tx).agg(*[e.alias(c) for c, e in upto.items()])
    seen = prefix_scan(per_tx, by, [tx], {c: (F.col(c), "max") for c in upto})
    return seen.select(*by, tx, F.array(*upto).alias("frontier"))


def classify_late(
    messages: DataFrame, log: DataFrame, by: Sequence[str], tx: str, event_time: str, cutoff: str, version: str | None = None, versions: int = 1
) -> DataFrame:
    """``messages`` with ``frontier`` (the last version's), ``lateness`` (no_event_time, on_time, late or too_late) and ``signs``.

    ``signs`` tells what the versions make of a message: (version, +1) where it is counted and (version, -1)
    where it is taken back, the first version in which it lies more than ``cutoff`` behind the frontier
    of its transaction.  A message behind it from the start has neither.  ``too_late`` are those whose signs add up to 0.
    A null cut-off never drops a row; an event time that is null or not above zero is no_event_time and never counts;
    a null group or transaction has no frontier and counts as on_time.  Columns of ``messages`` of these names
    are replaced; all others stay.
    """
    names = ("frontier", "lateness", "signs")
    frontier = event_frontier(log.where(F.col(event_time) > 0), by, tx, event_time, version, versions)
    (came,) = free_name(messages, "came")
    out = messages.drop(*names).withColumn(came, (F.col(version) if version else F.lit(1)).cast("bigint"))
    out = out.join(frontier, [*by, tx], "left")
    last = F.element_at("frontier", -1)
    gone = F.lit(None).cast("bigint")
    for v in range(versions, 0, -1):  # the first version wins, so it is asked last
        behind = F.coalesce(F.element_at("frontier", v) - F.col(event_time) > F.col(cutoff), F.lit(False))
        gone = F.when(behind & (F.lit(v) >= F.col(came)), F.lit(v).cast("bigint")).otherwise(gone)
    told, taken = F.struct(F.col(came).alias("version"), F.lit(1).alias("sign")), F.struct(gone.alias("version"), F.lit(-1).alias("sign"))
    none = F.array().cast("array<struct<version:bigint,sign:int>>")
    signs = F.when(~F.coalesce(F.col(event_time) > 0, F.lit(False)) | F.coalesce(gone == F.col(came), F.lit(False)), none).when(gone.isNull(), F.array(told)).otherwise(F.array(told, taken))
    out = out.withColumn("signs", signs)
    net = F.aggregate("signs", F.lit(0), lambda a, s: a + s["sign"])
    lateness = (
        F.when(~F.coalesce(F.col(event_time) > 0, F.lit(False)), "no_event_time").when(net == 0, "too_late").when(last > F.col(event_time), "late").otherwise("on_time")
    )
    return out.withColumn("lateness", lateness).withColumn("frontier", last).drop(came)


def changes_of(rows: DataFrame, keys: Mapping[str, Column], version: Column, measures: Mapping[str, Column]) -> DataFrame:
    """Net change of each measure per key and version, pre-aggregated before the shuffle."""
    named = [e.alias(k) for k, e in keys.items()]
    return rows.groupBy(*named, version.alias("version")).agg(*[F.sum(e).alias(m) for m, e in measures.items()])


def signed_deltas(changes: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Turn net changes per (keys, version) into retractions and assertions.

    The state of a key after version v is the sum of its changes up to v.  Each version that
    changes it emits the old state with sign -1 (unless there was none) and the new one with
    sign +1.  A change of zero in every measure emits nothing.  A key's rows are at most one per
    version, so the window is bounded by the number of versions, not by the rows behind them.
    """
    moved = F.lit(False)
    for m in measures:
        moved = moved | (F.coalesce(F.col(m), F.lit(0)) != 0)
    upto = Window.partitionBy(*keys).orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    first, after = free_name(changes, "first", "after")
    nth = Window.partitionBy(*keys).orderBy("version")
    told = changes.where(moved).withColumns(
        {first: F.row_number().over(nth), after: F.struct(*[F.sum(F.coalesce(F.col(m), F.lit(0))).over(upto).alias(m) for m in measures])}
    )
    old = F.struct(F.lit(-1).alias("sign"), *[(F.col(f"{after}.{m}") - F.coalesce(F.col(m), F.lit(0))).alias(m) for m in measures])
    new = F.struct(F.lit(1).alias("sign"), *[F.col(f"{after}.{m}").alias(m) for m in measures])
    both = F.when(F.col(first) == 1, F.array(new)).otherwise(F.array(old, new))
    return told.select(*keys, "version", F.explode(both).alias("__d")).select(*keys, "version", "__d.sign", *[f"__d.{m}" for m in measures])


def roll_up(deltas: DataFrame, keys: Mapping[str, Column], measures: Sequence[str]) -> DataFrame:
    """Carry deltas downstream: the signed deltas of the coarser aggregate."""
    signed = {m: F.col("sign") * F.col(m) for m in measures}
    return signed_deltas(changes_of(deltas, keys, F.col("version"), signed), list(keys), measures)


def fold(deltas: DataFrame, keys: Sequence[str], measures: Sequence[str], as_of: int | None = None) -> DataFrame:
    """The aggregates that the deltas add up to, at a version or after all of them.

    A key whose measures have all come down to nothing is left out.
    """
    d = deltas if as_of is None else deltas.where(F.col("version") <= as_of)
    total = d.groupBy(*keys).agg(*[F.sum(F.col("sign") * F.col(m)).alias(m) for m in measures])
    alive = F.lit(False)
    for m in measures:
        alive = alive | (F.col(m) != 0)
    return total.where(alive)


def late_corrected(
    messages: DataFrame,
    log: DataFrame,
    by: Sequence[str],
    tx: str,
    event_time: str,
    cutoff: str,
    version: str,
    versions: int,
    period_ms: int = HOUR_MS,
    keep: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(``classify_late``'s messages, signed deltas of ``n`` per ``keep`` columns and ``period_start``).

    ``version`` (1..``versions``) is a column of both inputs: when a row was delivered.  ``messages`` has each
    message once, as first delivered; the log may hold repeats, which change no frontier.
    """
    told = classify_late(messages, log, by, tx, event_time, cutoff, version, versions)
    signed = told.select(*dict.fromkeys([*keep, event_time]), F.explode("signs").alias("__s"))
    start = F.col(event_time) - F.pmod(F.col(event_time), F.lit(period_ms))
    keys = {**{k: F.col(k) for k in keep}, "period_start": start}
    changes = changes_of(signed, keys, F.col("__s.version"), {"n": F.col("__s.sign").cast("bigint")})
    return told, signed_deltas(changes, list(keys), ["n"])
