"""Exactly one copy of every message, by a persisted index of identifiers.

An identifier is 128 bits over the identifying columns.  The index is a set of immutable
runs; a run holds, per hash prefix, one sorted array of identifiers and beside it the
sequence number of the copy kept.  A batch is first reduced to one row per identifier, then
each hash prefix is binary-searched in the runs; what is found nowhere is novel and
becomes a run of its own.  Runs are merged into one when there are more than ``merge_at``.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.keys import fingerprint
from feedloom.sources import shared
from feedloom.sources.manifests import Manifests

_RUN = "bucket bigint, ids binary, kept array<bigint>"


def _pack(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Identifiers as 16-byte strings whose byte order is their order."""
    out = np.empty((len(hi), 2), ">u8")
    out[:, 0], out[:, 1] = hi.view("u8"), lo.view("u8")
    return out.view("S16").ravel()


def _sorted_unique(ids: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted identifiers, each once, with the smallest sequence number."""
    at = np.lexsort((kept, ids))
    ids, kept = ids[at], kept[at]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    return ids[first], kept[first]


def _holds(run: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of ``ids`` the sorted run holds, by binary search."""
    if not len(run):
        return np.zeros(len(ids), bool)
    at = np.searchsorted(run, ids)
    return run[np.minimum(at, len(run) - 1)] == ids


def _run_row(bucket: int, ids: np.ndarray, kept: np.ndarray) -> pa.Table:
    return pa.table(
        {"bucket": pa.array([bucket], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "kept": pa.array([kept.astype("i8")], pa.list_(pa.int64()))}
    )


_EMPTY = pa.table({"bucket": pa.array([], pa.int64()), "ids": pa.array([], pa.binary()), "kept": pa.array([], pa.list_(pa.int64()))})


def _runs_of(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for ids, kept in zip(table["ids"].to_pylist(), table["kept"]):
        yield np.frombuffer(ids, "S16"), kept.values.to_numpy(zero_copy_only=False)


def _novel(key: tuple, batch: pa.Table, runs: pa.Table) -> pa.Table:
    if not batch.num_rows:
        return _EMPTY
    hi, lo, seq = (batch[c].to_numpy() for c in ("hi", "lo", "seq"))
    ids, kept = _sorted_unique(_pack(hi, lo), seq)
    new = np.ones(len(ids), bool)
    for run, _ in _runs_of(runs):
        new &= ~_holds(run, ids)
    return _run_row(key[0].as_py(), ids[new], kept[new]) if new.any() else _EMPTY


def _merge_to(by: int):
    """Merges the runs' arrays of a bucket into one, or into 2**``by`` arrays by the next bits of the identifiers."""

    def merge(key: tuple, runs: pa.Table) -> pa.Table:
        parts = list(_runs_of(runs))
        ids, kept = _sorted_unique(np.concatenate([i for i, _ in parts]), np.concatenate([k for _, k in parts]))
        bucket = key[0].as_py()
        if not by:
            return _run_row(bucket, ids, kept)
        bits = runs["bits"][0].as_py() + by
        tops = np.ascontiguousarray(ids).view(">u8").reshape(-1, 2)[:, 0].astype(np.uint64) >> np.uint64(64 - bits)
        cuts = np.flatnonzero(np.diff(tops)) + 1
        ends = [0, *cuts.tolist(), len(ids)]
        return pa.concat_tables([_run_row(int(tops[lo]), ids[lo:hi], kept[lo:hi]) for lo, hi in zip(ends, ends[1:]) if lo < hi])

    return merge


class IdentifierIndex:
    """A persisted index of identifiers below ``root``.

    ``bits`` is the length of the hash prefix; an array holds the identifiers of one prefix and is all that a task
    needs at once.  A merge lengthens the prefix when arrays have grown beyond ``per_array`` on average,
    so they stay short however the table grows.  Runs lie in folders of neighbouring prefixes (``shelf``), and a batch opens only those
    of its own identifiers.  Two identifiers of n fall on the same 128 bits with a chance of about n*n / 2**129.
    """

    #: Shelves of a run at most, as powers of two: folders, and numbers on the driver.
    SHELF_BITS = 8

    def __init__(self, spark: SparkSession, root: str, identity: Sequence[Column], sequence: str, bits: int = 4, merge_at: int = 4, per_array: int = 1 << 15):
        self.spark, self.root, self.identity = spark, root.rstrip("/"), list(identity)
        self.sequence, self.bits, self.merge_at, self.per_array = sequence, bits, merge_at, per_array
        self.manifests = Manifests(spark, self.root, {"runs": [], "bits": bits})

    @staticmethod
    def bits_for(rows: int, per_array: int = 1 << 15) -> int:
        """Hash prefix bits that leave about ``per_array`` identifiers to an array."""
        return max(4, math.ceil(math.log2(max(rows, 1) / per_array))) if rows > per_array else 4

    def _shelf_bits(self, bits: int) -> int:
        """A shelf has 256 arrays or more, so that small indexes aren't cut into many files."""
        return min(self.SHELF_BITS, max(0, bits - 8))

    def _read(self, now: dict, touched: Sequence[int] | None = None) -> DataFrame:
        if not now["runs"]:
            return self.spark.createDataFrame([], _RUN)
        shelved = self._shelf_bits(now["bits"]) > 0
        out = None
        for r in now["runs"]:
            run = self.spark.read.schema(_RUN + ", shelf int" if shelved else _RUN).parquet(f"{self.root}/{r}")
            if shelved and touched is not None:
                run = run.where(F.col("shelf").isin(list(touched)))
            out = run.select("bucket", "ids", "kept") if out is None else out.unionByName(run.select("bucket", "ids", "kept"))
        return out

    def _write(self, arrays: DataFrame, bits: int, name: str) -> None:
        if not (cut := self._shelf_bits(bits)):
            arrays.write.mode("overwrite").parquet(f"{self.root}/{name}")
            return
        shelved = arrays.withColumn("shelf", F.shiftright("bucket", bits - cut).cast("int"))
        shelved.sortWithinPartitions("shelf").write.mode("overwrite").partitionBy("shelf").parquet(f"{self.root}/{name}")

    def offer(self, batch: DataFrame, batch_id: str) -> None:
        """Take in a batch.  One that was taken in under this id before is skipped.

        Batches should come in the order of ``sequence``: a copy is kept if its identifier was in
        no earlier batch, and of several in one batch the one with the smallest ``sequence``.
        Rows without a sequence number are passed over.  Null identifying values equal each other.
        """
        if self.manifests.version_of(batch_id) is not None:
            return
        now = self.manifests.newest()
        bits = now["bits"]
        hi, lo = fingerprint(self.identity, 3), fingerprint(self.identity, 5)
        one = batch.where(F.col(self.sequence).isNotNull()).select(hi.alias("hi"), lo.alias("lo"), F.col(self.sequence).cast("bigint").alias("seq"))
        one = one.groupBy("hi", "lo").agg(F.min("seq").alias("seq")).withColumn("bucket", F.shiftrightunsigned("hi", 64 - bits))
        touched = None
        if now["runs"] and (cut := self._shelf_bits(bits)):
            one = shared.materialize(one, "offered")
            touched = [r[0] for r in one.select(F.shiftright("bucket", bits - cut)).distinct().collect()]  # at most 2**SHELF_BITS
        run = f"run-{now['version'] + 1}-{uuid.uuid4().hex[:16]}"
        novel = one.groupBy("bucket").cogroup(self._read(now, touched).groupBy("bucket")).applyInArrow(_novel, _RUN)
        self._write(novel, bits, run)
        self.manifests.commit(now, {"runs": [*now["runs"], run]}, batch_id)
        if len(now["runs"]) + 1 > self.merge_at:
            self.merge()

    def merge(self) -> None:
        """Make one run of all, with longer prefixes if arrays have grown too long; the old ones stay until ``vacuum``."""
        now = self.manifests.newest()
        if len(now["runs"]) < 2:
            return
        runs = self._read(now)
        held = runs.agg(F.sum(F.size("kept").cast("bigint"))).first()[0] or 0
        by = max(0, self.bits_for(held, self.per_array) - now["bits"])
        run, bits = f"run-{now['version'] + 1}-{uuid.uuid4().hex[:16]}", now["bits"] + by
        merged = runs.withColumn("bits", F.lit(now["bits"])).groupBy("bucket").applyInArrow(_merge_to(by), _RUN)
        self._write(merged, bits, run)
        self.manifests.commit(now, {"runs": [run], "bits": bits})

    def vacuum(self) -> None:
        """Remove runs that the manifest no longer names."""
        keep = set(self.manifests.newest()["runs"])
        for n in shared.names(self.spark, self.root):
            if n.startswith("run-") and n not in keep:
                shared.remove(self.spark, f"{self.root}/{n}")

    def kept(self) -> DataFrame:
        """The sequence numbers of all copies kept so far."""
        return self._read(self.manifests.newest()).select(F.explode("kept").alias(self.sequence))


def offer_in_order(index: IdentifierIndex, rows: DataFrame, batches: int) -> None:
    """Offer a whole table as ``batches`` slices of its sequence range, lowest first."""
    seq = index.sequence
    low, high = rows.agg(F.min(seq), F.max(seq)).first()
    if low is None:
        return
    width = max(1, math.ceil((high - low + 1) / batches))
    for b in range(batches):
        start = low + b * width
        if start <= high:
            index.offer(rows.where((F.col(seq) >= start) & (F.col(seq) < start + width)), f"{start}+{width}")
