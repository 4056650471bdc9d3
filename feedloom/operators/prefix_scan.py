"""Running sums, maxima and run numbers over ordered groups of any size.

A plain window puts a whole group into one task.  Here rows are range-split over
(group, order) into blocks of bounded bytes, once, and each block is scanned where it lies
by numpy over Arrow batches.  Only the block's first and last row are looked at again: they tell
what each block's first group carries on from the blocks before.  That is at most two rows
a block, and the rows themselves are not moved a second time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.keys import free_name
from feedloom.sources.shared import blocks_for, materialize

_AGG = {"max": F.max, "min": F.min, "sum": F.sum}
#: Blocks up to which what they carry is broadcast: one row a block.
_MOST_SENT = 100_000
_FIRST, _LAST = 1, 2


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; null equals null, NaN equals NaN."""
    a, b = column[1:], column[:-1]
    out = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    if pa.types.is_floating(column.type):
        out = out & ~pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False).to_numpy(zero_copy_only=False)
    return out


class _Before:
    """Compares each row of some columns with the row before it, across batches."""

    def __init__(self) -> None:
        self.last: list[pa.Array] | None = None

    def differs(self, columns: list[pa.Array], n: int) -> np.ndarray:
        out = np.zeros(n, bool)
        if self.last is None:
            out[0] = True
        for i, c in enumerate(columns):
            if self.last is None:
                out[1:] |= _changes(c)
            else:
                out |= _changes(pa.concat_arrays([self.last[i], c]))
        self.last = [c[-1:] for c in columns]
        return out


def _running(v: np.ndarray, ok: np.ndarray, begins: np.ndarray, how: str) -> tuple[np.ndarray, np.ndarray]:
    """The aggregate of each row and those before it in its group, and whether there is any."""
    n = len(v)
    start = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    count = np.cumsum(ok)
    has = count - (count[start] - ok[start]) > 0
    if how == "sum":
        v = np.where(ok, v, 0)
        if v.dtype.kind == "f":  # no differences of long sums, which would lose digits
            return np.concatenate([np.cumsum(part) for part in np.split(v, np.flatnonzero(begins)) if len(part)]), has
        total = np.cumsum(v)
        return total - (total[start] - v[start]), has
    flip = how == "min"
    if flip:
        v = -v if v.dtype.kind == "f" else ~v
    # Ranks are small numbers, so that one maximum over (group, rank) starts anew with every group.
    known, at = np.unique(v[ok], return_inverse=True)
    rank = np.zeros(n, np.int64)
    rank[ok] = at + 1
    group = np.cumsum(begins) * (len(known) + 1)
    rank = np.maximum.accumulate(group + rank) - group
    best = known[np.maximum(rank - 1, 0)] if len(known) else np.zeros(n, v.dtype)
    if flip:
        best = -best if best.dtype.kind == "f" else ~best
    return best, has


def _merge(how: str, a, b):
    return a + b if how == "sum" else max(a, b) if how == "max" else min(a, b)


def _scan_local(by: list[str], hows: list[tuple[str, str]]) -> Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]:
    """Per batch, the aggregates ``how`` of column ``v`` over all earlier rows of the group within the block."""

    def begin() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        before, held = _Before(), [None] * len(hows)

        def step(b: pa.RecordBatch) -> list[pa.Array]:
            begins = before.differs([b.column(c) for c in by], b.num_rows)
            goes_on = int(np.argmax(begins)) if begins.any() else b.num_rows  # rows of the group of the batch before
            out = []
            for i, (name, how) in enumerate(hows):
                column = b.column(name)
                ok = ~column.is_null().to_numpy(zero_copy_only=False)
                incl, has = _running(column.fill_null(0).to_numpy(zero_copy_only=False), ok, begins, how)
                if held[i] is not None and goes_on:
                    old = incl.dtype.type(held[i])
                    seen = np.where(has[:goes_on], incl[:goes_on], old if how != "sum" else 0)
                    incl[:goes_on] = old + seen if how == "sum" else np.maximum(old, seen) if how == "max" else np.minimum(old, seen)
                    has[:goes_on] = True
                value, there = np.roll(incl, 1), np.roll(has, 1)
                value[0], there[0] = (held[i], True) if held[i] is not None and goes_on else (0, False)
                there &= ~begins
                out.append(pa.array(value, mask=~there, type=column.type))
                held[i] = incl[-1].item() if has[-1] else None
            return out

        return step

    return begin


def _runs_local(by: list[str], value: str, breaks: str) -> Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]:
    """Per batch, how often the value changed since the group's first row in the block."""

    def begin() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        group, kind, held = _Before(), _Before(), [0]

        def step(b: pa.RecordBatch) -> list[pa.Array]:
            begins = group.differs([b.column(c) for c in by], b.num_rows)
            turns = kind.differs([b.column(value)], b.num_rows) | b.column(breaks).to_numpy(zero_copy_only=False)
            n = np.cumsum(turns & ~begins)
            start = np.maximum.accumulate(np.where(begins, np.arange(len(n)), -1))
            out = np.where(start < 0, n + held[0], n - n[np.maximum(start, 0)])
            held[0] = int(out[-1])
            return [pa.array(out, pa.int64())]

        return step

    return begin


def _scanned(df: DataFrame, by: Sequence[str], order: Sequence[str], made: Sequence[tuple[str, T.DataType]], edge: str, block: str, begin, blocks: int | None) -> tuple[DataFrame, int]:
    """``df`` range-split and sorted, with the columns of a local scan, the block and which row is its first or last."""
    n = blocks or blocks_for(df)
    rows = df.repartitionByRange(n, *by, *order) if [*by, *order] else df.repartition(1)
    rows = rows.withColumn(block, F.spark_partition_id()).sortWithinPartitions(*by, *order)
    schema = T.StructType([*rows.schema.fields, *[T.StructField(name, kind) for name, kind in made], T.StructField(edge, T.IntegerType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, waiting = begin(), None

        def told(cols: list[pa.Array], names: list[str], last: bool) -> pa.RecordBatch:
            marks = cols[-1]
            if last:
                marks = marks.copy()
                marks[-1] |= _LAST
            return pa.RecordBatch.from_arrays([*cols[:-1], pa.array(marks, pa.int32())], names)

        for b in batches:
            if not b.num_rows:
                continue
            marks = np.zeros(b.num_rows, np.int32)
            if waiting is not None:
                yield told(*waiting, last=False)
            else:
                marks[0] = _FIRST
            waiting = [*b.columns, *step(b), marks], [*b.schema.names, *[name for name, _ in made], edge]
        if waiting is not None:
            yield told(*waiting, last=True)

    return materialize(rows.mapInArrow(scan, schema), "scan"), n


def _with_carry(rows: DataFrame, carry: DataFrame, by: Sequence[str], block: str, n: int) -> DataFrame:
    """Each row with what its block's first group brings along; other groups of the block bring nothing."""
    renamed = {c: f"{c}__of" for c in (*by, block)}
    carry = carry.withColumnsRenamed(renamed)
    on = F.col(block) == F.col(renamed[block])
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(renamed[c]))
    return rows.join(F.broadcast(carry) if n <= _MOST_SENT else carry, on, "left").drop(*renamed.values())


def prefix_scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    running: Mapping[str, tuple[Column, str]],
    blocks: int | None = None,
) -> DataFrame:
    """``df`` with a column per entry of ``running``: the aggregate over all earlier rows of the group.

    ``running`` maps a new column to (bigint or double expression, "max" | "min" | "sum").  Earlier means
    smaller in ``order``, nulls first; ``order`` should be total within a group, as rows that
    tie come in any order.  The first row of a group gets null, and nulls count for nothing.  Null group values
    form a group of their own.  A column of a name in ``running`` is replaced.  An empty input gives an empty result.
    ``blocks`` is for plans that multiply rows, whose size can't be told beforehand.
    """
    by = list(by)
    block, edge = free_name(df, "block", "edge")
    fixed = dict(zip(running, free_name(df, *(f"v{i}" for i, _ in enumerate(running)))))
    local = {k: f"{v}x" for k, v in fixed.items()}
    rows = df.withColumns({fixed[k]: e for k, (e, _) in running.items()})
    rows = rows.withColumns({c: F.col(c).cast("double" if isinstance(rows.schema[c].dataType, T.FractionalType) else "bigint") for c in fixed.values()})
    made = [(local[k], rows.schema[fixed[k]].dataType) for k in running]
    rows, n = _scanned(rows, by, order, made, edge, block, _scan_local(by, [(fixed[k], how) for k, (_, how) in running.items()]), blocks)

    def total(k: str, how: str) -> Column:
        x, v = F.col(local[k]), F.col(fixed[k])
        return F.coalesce(x + v, x, v) if how == "sum" else F.greatest(x, v) if how == "max" else F.least(x, v)

    ends = rows.where(F.col(edge) > 0)
    lasts = ends.where(F.col(edge) >= _LAST).select(*by, block, F.lit(1).alias(edge), *[total(k, how).alias(local[k]) for k, (_, how) in running.items()])
    firsts = ends.where(F.col(edge) % 2 == _FIRST).select(*by, block, F.lit(0).alias(edge), *[F.lit(None).cast(kind).alias(c) for c, kind in made])
    # At most two rows a block, however large a group is.
    before = Window.partitionBy(*by).orderBy(block, edge).rowsBetween(Window.unboundedPreceding, -1)
    carry = lasts.unionByName(firsts).withColumns({f"{local[k]}c": _AGG[how](local[k]).over(before) for k, (_, how) in running.items()}).where(F.col(edge) == 0)
    out = _with_carry(rows, carry.select(*by, block, *[f"{c}c" for c in local.values()]), by, block, n)

    def joined(k: str, how: str) -> Column:
        x, c = F.col(local[k]), F.col(f"{local[k]}c")
        return F.coalesce(x + c, x, c) if how == "sum" else F.greatest(x, c) if how == "max" else F.least(x, c)

    kept = [c for c in df.columns if c not in running]
    return out.select(*[F.col(f"`{c}`") for c in kept], *[joined(k, how).alias(k) for k, (_, how) in running.items()])


def runs(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, breaks: Column | None = None, blocks: int | None = None) -> DataFrame:
    """``rows`` with ``run``: neighbours in ``order`` with equal ``value`` share a number (0, 1, ... per ``by``).

    ``breaks`` starts a new run where it is true.  Null equals null.  One scan, so a log of any
    length is numbered without ordering it in one task.
    """
    by = list(by)
    block, edge, turn, local, seen = free_name(rows, "block", "edge", "turn", "local", "seen")
    marked = rows.withColumn(turn, F.coalesce(breaks, F.lit(False)) if breaks is not None else F.lit(False))
    told, n = _scanned(marked, by, order, [(local, T.LongType())], edge, block, _runs_local(by, value, turn), blocks)
    ends = told.where(F.col(edge) > 0)
    # Per block: its first group's first value, its last group's last value and changes, in the order of the blocks.
    firsts = ends.where(F.col(edge) % 2 == _FIRST).select(*by, block, F.lit(0).alias(edge), F.col(value).alias(seen), turn, F.lit(0).cast("bigint").alias(local))
    lasts = ends.where(F.col(edge) >= _LAST).select(*by, block, F.lit(1).alias(edge), F.col(value).alias(seen), F.lit(False).alias(turn), local)
    line = Window.partitionBy(*by).orderBy(block, edge)
    prior = F.lag(F.struct(seen)).over(line)
    # A block's last row follows its own first row, whose changes it counts already; a first row meets another block's last.
    step = F.when(F.col(edge) == 1, F.col(local)).when(prior.isNull(), 0).otherwise((F.col(turn) | ~prior[seen].eqNullSafe(F.col(seen))).cast("bigint"))
    counted = lasts.unionByName(firsts).withColumn(f"{seen}s", step)
    carry = counted.withColumn(f"{seen}c", F.sum(f"{seen}s").over(line.rowsBetween(Window.unboundedPreceding, 0))).where(F.col(edge) == 0)
    out = _with_carry(told, carry.select(*by, block, f"{seen}c"), by, block, n)
    kept = [c for c in rows.columns if c != "run"]
    return out.select(*[F.col(f"`{c}`") for c in kept], (F.col(local) + F.coalesce(f"{seen}c", F.lit(0))).alias("run"))
