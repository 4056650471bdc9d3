"""Results per key when a few keys hold most rows, by dense accumulator arrays.

Rows are never moved by key.  Each input split encodes its keys by a dictionary and adds
into dense arrays (numpy bincount and scatter-maximum), then hands out one array block per
block of keys.  The blocks are added up in two rounds, so a hot key costs as many array
cells as there are splits, however many rows it has.  There are as many blocks as leave a bounded
share of the table's bytes to each, and so of its keys, which can't be more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.sources.shared import blocks_for

_SEP = "\x00"
#: Keys that one row of arrays holds at most.
CHUNK = 1 << 16


class _Arrays:
    """Dense arrays over the keys met so far: row counts and maxima."""

    def __init__(self, maxima: int):
        self.code: dict[tuple, int] = {}
        self.n = np.zeros(0, np.int64)
        self.top = [np.zeros(0, np.int64) for _ in range(maxima)]
        self.has = [np.zeros(0, bool) for _ in range(maxima)]

    def codes(self, keys: list[tuple]) -> np.ndarray:
        code = self.code
        out = np.fromiter((code.setdefault(k, len(code)) for k in keys), np.int64, len(keys))
        if (more := len(code) - len(self.n)) > 0:
            more = max(more, len(self.n))
            self.n = np.pad(self.n, (0, more))
            self.top = [np.pad(t, (0, more)) for t in self.top]
            self.has = [np.pad(h, (0, more)) for h in self.has]
        return out

    def add(self, at: np.ndarray, n: np.ndarray, tops: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Add an array of partial results; ``at`` holds each code once."""
        self.n[at] += n
        for top, has, (value, ok) in zip(self.top, self.has, tops):
            at_ok, value = at[ok], value[ok]
            top[at_ok] = np.where(has[at_ok], np.maximum(top[at_ok], value), value)
            has[at_ok] = True

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        """All keys held, as rows of at most CHUNK of them."""
        keys = list(self.code)
        for lo in range(0, len(keys), CHUNK):
            at = slice(lo, min(lo + CHUNK, len(keys)))
            yield _row(block, 0, keys[at], self.n[at], [(t[at], h[at]) for t, h in zip(self.top, self.has)])

    def blocks(self, blocks: int, share: int) -> Iterator[pa.RecordBatch]:
        keys = list(self.code)
        if not keys:
            return
        where = np.fromiter((zlib.crc32(_SEP.join("\x01" if p is None else p for p in k).encode("utf-8", "surrogatepass")) % blocks for k in keys), np.int64, len(keys))
        order = np.argsort(where, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
            for cut in np.split(part, range(CHUNK, len(part), CHUNK)):
                yield _row(int(where[part[0]]), share, [keys[i] for i in cut], self.n[cut], [(t[cut], h[cut]) for t, h in zip(self.top, self.has)])


def _row(block: int, share: int, keys: list[tuple], n: np.ndarray, tops: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    cols = {"block": pa.array([block], pa.int64()), "share": pa.array([share], pa.int64()), "n": pa.array([n], pa.list_(pa.int64()))}
    for i in range(len(keys[0])):
        cols[f"k{i}"] = pa.array([[k[i] for k in keys]], pa.list_(pa.string()))
    for i, (t, h) in enumerate(tops):
        cols[f"m{i}"] = pa.array([[int(v) if ok else None for v, ok in zip(t, h)]], pa.list_(pa.int64()))
    return pa.RecordBatch.from_pydict(cols)


def _schema(keys: int, maxima: int) -> str:
    return ", ".join(["block bigint, share bigint, n array<bigint>", *[f"k{i} array<string>" for i in range(keys)], *[f"m{i} array<bigint>" for i in range(maxima)]])


def _encode(columns: list[pa.Array]) -> tuple[list[tuple], np.ndarray]:
    """The distinct keys of a batch, and for each row the place of its key among them."""
    code = np.zeros(len(columns[0]), np.int64)
    parts = []
    for c in columns:
        d = c.dictionary_encode(null_encoding="encode")
        at = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        parts.append((d.dictionary.to_pylist(), at))
        # Counted anew after each column, so that codes stay below the number of rows.
        _, first, code = np.unique(code * (int(at.max()) + 1) + at, return_index=True, return_inverse=True)
    return list(zip(*[[words[i] for i in at[first]] for words, at in parts])), code


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(zero_copy_only=False), ~column.is_null().to_numpy(zero_copy_only=False)


def dense_group_totals(rows: DataFrame, keys: Sequence[str], maxima: Sequence[str], fan_in: int = 64, flush_at: int = 1 << 20, per_block: int = 8 << 20) -> DataFrame:
    """Per key: ``n``, the rows, and the largest value of each column in ``maxima`` (as ``max_<column>``).

    A key of the name ``n`` makes the count ``_n``.  Keys are strings; null is a key value of its own.  Maxima are over bigints, null where a key
    has no value.  A split whose dictionary reaches ``flush_at`` keys hands its arrays out and starts
    anew, so memory doesn't grow with the number of keys.  A block of keys has about ``per_block`` bytes of the
    table's keys or less.  An empty input gives no rows.
    """
    blocks, nk, nm = blocks_for(rows, per_block), len(keys), len(maxima)
    slim = rows.select(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(m).cast("bigint").alias(f"m{i}") for i, m in enumerate(maxima)], F.spark_partition_id().alias("split"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, share = _Arrays(nm), 0
        for b in batches:
            if not b.num_rows:
                continue
            share = b.column(nk + nm)[0].as_py() % fan_in
            found, at = _encode([b.column(i) for i in range(nk)])
            tops = []
            for value, ok in (_values(b.column(nk + i)) for i in range(nm)):
                best = np.full(len(found), np.iinfo(np.int64).min)
                np.maximum.at(best, at[ok], value[ok])
                tops.append((best, np.bincount(at[ok], minlength=len(found)) > 0))
            sums.add(sums.codes(found), np.bincount(at, minlength=len(found)), tops)
            if len(sums.code) >= flush_at:
                yield from sums.blocks(blocks, share)
                sums = _Arrays(nm)
        yield from sums.blocks(blocks, share)

    def reduce(key: tuple, table: pa.Table) -> pa.Table:
        sums = _Arrays(nm)
        for r in table.to_batches():
            n = r.column("n").flatten().to_numpy(zero_copy_only=False)
            ks = [r.column(f"k{i}").flatten().to_pylist() for i in range(nk)]
            # A row of arrays holds a key once; several rows may hold it again.
            ends = np.cumsum([len(x) for x in r.column("n")]).tolist()
            tops = [_values(r.column(f"m{i}").flatten()) for i in range(nm)]
            codes = sums.codes(list(zip(*ks)))
            for lo, hi in zip([0, *ends], ends):
                sums.add(codes[lo:hi], n[lo:hi], [(v[lo:hi], ok[lo:hi]) for v, ok in tops])
        return pa.Table.from_batches(list(sums.rows(key[0].as_py())))

    schema = _schema(nk, nm)
    part = slim.mapInArrow(split, schema)
    part = part.groupBy("block", "share").applyInArrow(reduce, schema)
    part = part.groupBy("block").applyInArrow(reduce, schema)
    zipped = F.arrays_zip(*[F.col(f"k{i}") for i in range(nk)], F.col("n"), *[F.col(f"m{i}") for i in range(nm)])
    return part.select(F.explode(zipped).alias("z")).select(
        *[F.col(f"z.k{i}").alias(k) for i, k in enumerate(keys)], F.col("z.n").alias("_n" if "n" in keys else "n"), *[F.col(f"z.m{i}").alias(f"max_{m}") for i, m in enumerate(maxima)]
    )
