"""A partition's log as Parquet files, with commits, compaction and a manifest.

Layout below ``root``: ``data/<tx>-<uuid>`` for each commit, ``base/<uuid>`` for compacted rows, and
``manifest/<n>``, written last and by one writer only, naming the base and the commits on top of it.  A
reader takes the newest manifest; a commit that died before its manifest is not there.  A writer that
finds its number taken looks again at what the other one did, and tries anew.

A commit's manifest entry tells its range of transactions, and the base lies in folders by how far its
transactions lie behind the last one, in powers of two (``leap``): whoever asks for what came after
a transaction opens neither older commits nor older folders.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.operators import retention
from feedloom.operators.resolve import commit_changes, key_of, lww, merge_delta, update_batch
from feedloom.schema import LOG
from feedloom.sources import shared
from feedloom.sources.manifests import Conflict, Manifests

#: Parquet codec by row type.
CODECS = {"primary": "zstd", "snappy_primary": "snappy"}
#: How often a writer starts again behind others before it gives up.
TRIES = 20


class OverCapacity(RuntimeError):
    """Twice as many rows as a merge is due at are pending."""


class LogStore:
    """The log of one partition, for any number of writers and readers."""

    def __init__(self, spark: SparkSession, root: str, row_type: str = "primary", merge_after: int = 1_000_000, log_only: bool = False):
        if row_type not in CODECS:
            raise ValueError(f"no such row type: {row_type}")
        self.spark, self.root, self.row_type = spark, root.rstrip("/"), row_type
        self.merge_after, self.log_only = merge_after, log_only
        empty = {"base": None, "base_last": -1, "commits": [], "last_tx": -1, "last_id": 0, "stats": {}, "merged": {}, "highwaters": {}}
        self.manifests = Manifests(spark, self.root, empty)

    # --- manifest ---

    def manifest(self) -> dict[str, Any]:
        """The newest manifest whose checksum holds, and ``pending``, the rows that wait for a merge."""
        now = self.manifests.newest()
        return now | {"pending": sum(c["n"] for c in now["commits"])}

    def _again(self, step: Callable[[dict[str, Any]], Any]) -> Any:
        """Run ``step`` on the newest manifest until no other writer came between."""
        for _ in range(TRIES):
            try:
                return step(self.manifest())
            except Conflict:
                continue
        raise Conflict(f"{TRIES} tries lost against other writers of {self.root}")

    def _commit_manifest(self, now: dict[str, Any], changes: dict[str, Any]) -> None:
        now = {k: v for k, v in now.items() if k != "pending"}
        self.manifests.commit(now, changes)

    def _next_id(self, now: dict[str, Any]) -> int:
        """A fresh id, above all before it: milliseconds and 12 bits below."""
        return max(int(time.time() * 1000) << 12, now["last_id"] + 1)

    def _read(self, paths: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def _read_base(self, now: dict[str, Any], since: int | None = None) -> DataFrame:
        if not now["base"]:
            return self._read([])
        rows = self.spark.read.schema(T.StructType([*LOG.fields, T.StructField("leap", T.IntegerType())])).parquet(f"{self.root}/{now['base']}")
        if since is not None:
            rows = rows.where(F.col("leap") <= F.lit(max(0, now["base_last"] - since - 1).bit_length()))
        return rows.select(*LOG.names)

    def _read_commits(self, commits: Sequence[dict[str, Any]]) -> DataFrame:
        return self._read([f"{self.root}/{c['path']}" for c in commits])

    # --- reading ---

    def base(self) -> DataFrame:
        return self._read_base(self.manifest())

    def delta(self) -> DataFrame:
        return self._read_commits(self.manifest()["commits"])

    def log(self, since: int | None = None) -> DataFrame:
        """All rows, base and pending; with ``since``, at least all rows of later transactions, from few files."""
        now = self.manifest()
        commits = [c for c in now["commits"] if since is None or c["hi"] > since]
        if since is not None and now["base_last"] <= since:
            return self._read_commits(commits)
        base = self._read_base(now, since)
        return base.unionByName(self._read_commits(commits)) if commits else base

    def rows(self, since: int | None = None) -> DataFrame:
        """The log without its markers."""
        return self.log(since).where(F.col("row_type").isin(*CODECS))

    def state(self) -> DataFrame:
        """The resolved rows.  A log-only partition answers no reads once its rows are merged."""
        if self.log_only:
            return lww(self.delta().where(F.col("row_type").isin(*CODECS)))
        return lww(self.rows())

    def highwater(self, member: str) -> int:
        """The last transaction applied from a member; -1 if there is none."""
        return self.manifest()["highwaters"].get(member, -1)

    def clear_highwater(self, member: str) -> None:
        self._again(lambda now: self._commit_manifest(now, {"highwaters": {m: t for m, t in now["highwaters"].items() if m != member}}))

    def _standing(self, batch: DataFrame) -> DataFrame:
        """The log's rows of the batch's keys: only those are resolved for a commit."""
        log = self.rows()
        prefix, key = key_of(log)
        asked = batch.select(key_of(batch)[0].alias("__p"), F.col("key").alias("__k")).distinct()
        return log.join(asked, (prefix == F.col("__p")) & key.eqNullSafe(F.col("__k")), "left_semi")

    # --- writing ---

    def _store(self, rows: DataFrame, tx: int) -> dict[str, Any] | None:
        """Write rows to a folder of their own; its manifest entry, or None if there are no rows."""
        path = f"data/{tx}-{uuid.uuid4().hex}"
        rows.select(*LOG.names).write.option("compression", CODECS[self.row_type]).parquet(f"{self.root}/{path}")
        n, lo, hi = self._read([f"{self.root}/{path}"]).agg(F.count(F.lit(1)), F.min("tx_id"), F.max("tx_id")).first()
        return {"path": path, "n": n, "lo": lo, "hi": hi} if n else None

    def _add(self, now: dict[str, Any], entry: dict[str, Any] | None, tx: int, highwaters: dict[str, int] | None = None) -> None:
        marks = now["highwaters"] | {m: max(t, now["highwaters"].get(m, -1)) for m, t in (highwaters or {}).items()}
        if entry or marks != now["highwaters"]:
            commits = [*now["commits"], entry] if entry else now["commits"]
            self._commit_manifest(now, {"commits": commits, "last_tx": max(now["last_tx"], entry["hi"] if entry else -1), "last_id": tx, "highwaters": marks})

    def _room(self, now: dict[str, Any]) -> None:
        if now["pending"] >= 2 * self.merge_after:
            raise OverCapacity("too many rows wait for a merge")

    def commit(self, updates: DataFrame, prefix: bytes | None = None, force: bool = False, now_ms: int | None = None) -> DataFrame:
        """Append a batch of (key, value, ts_id, tombstoned) under one transaction; returns its change feed.

        A timestamp that is null or not above 0 becomes the clock's, every row gets one fresh version, and
        rows no newer than what stands are dropped unless ``force``.  Of several rows for a key the
        later (by ``seq``, else in the order they come in) with the largest timestamp is kept.  A null key raises.  At twice ``merge_after`` pending
        rows a commit is refused; merge first.
        """

        def step(now: dict[str, Any]) -> DataFrame:
            self._room(now)
            tx = self._next_id(now)
            clock = now_ms if now_ms is not None else int(time.time() * 1000)
            numbered = updates.select(
                F.lit(tx).alias("tx_id"),
                (F.col("seq") if "seq" in updates.columns else F.monotonically_increasing_id()).alias("seq"),
                (F.col("prefix") if "prefix" in updates.columns else F.lit(prefix)).cast("binary").alias("prefix"),
                F.when(F.col("key").isNull(), F.raise_error(F.lit("a key is needed")).cast("binary")).otherwise(F.col("key").cast("binary")).alias("key"),
                F.col("value").cast("binary").alias("value"),
                F.when(F.col("ts_id") > 0, F.col("ts_id")).otherwise(F.lit(clock)).cast("bigint").alias("ts_id"),
                F.coalesce(F.col("tombstoned"), F.lit(False)).alias("tombstoned"),
                F.lit(tx).alias("version"),
                F.lit(self.row_type).alias("row_type"),
            )
            batch = shared.materialize(update_batch(numbered), "batch")
            changes = shared.materialize(commit_changes(self._standing(batch), batch, force=force), "changes")
            self._add(now, self._store(changes, tx), tx)
            return changes

        return self._again(step)

    def append(self, rows: DataFrame, member: str | None = None, resolve: bool = False) -> int:
        """Append rows that already carry transaction ids, as a replica does; returns how many were new.

        Rows of a transaction that are here already (same ``tx_id`` and ``seq``) are passed over, so that a
        repeated batch adds nothing; with ``resolve`` so are rows no newer than what stands for their key.  ``member``
        advances its highwater with the rows, in one step.  Refused at twice ``merge_after`` pending rows.
        """
        rows = shared.materialize(rows.select(*LOG.names), "arrived")

        def step(now: dict[str, Any]) -> int:
            self._room(now)
            low, high = rows.agg(F.min("tx_id"), F.max("tx_id")).first()
            if low is None:
                return 0
            new = rows.dropDuplicates(["tx_id", "seq"]).join(self.log(since=low - 1).where(F.col("tx_id") <= high).select("tx_id", "seq"), ["tx_id", "seq"], "left_anti")
            if resolve:
                held = new.where(F.col("row_type").isin(*CODECS))
                kept = commit_changes(self._standing(held), held).select("tx_id", "seq")
                new = new.join(kept, ["tx_id", "seq"], "left_semi").unionByName(new.where(~F.col("row_type").isin(*CODECS)))
            tx = self._next_id(now)
            entry = self._store(new, tx)
            self._add(now, entry, tx, {member: high} if member is not None else None)
            return entry["n"] if entry else 0

        return self._again(step)

    # --- maintenance ---

    def mergeable(self) -> bool:
        return self.manifest()["pending"] > self.merge_after

    def _rebase(self, rows: DataFrame, now: dict[str, Any], changes: dict[str, Any]) -> None:
        """Write a new base and move the manifest to it; commits made meanwhile stay on top of it.

        Rows lie by leap, and within it by key, so that both ranges of keys and late transactions are found without reading all.
        """
        last, n = now["last_tx"], shared.blocks_for(rows)
        behind = F.greatest(F.lit(last) - F.col("tx_id"), F.lit(0))
        leap = F.when(behind == 0, 0).otherwise(F.length(F.bin(behind))).cast("int")
        laid = rows.select(*LOG.names).withColumn("leap", leap).repartitionByRange(n, "leap", "prefix", "key").sortWithinPartitions("leap", "prefix", "key", "tx_id")
        base = f"base/{uuid.uuid4().hex}"
        laid.write.partitionBy("leap").option("compression", CODECS[self.row_type]).parquet(f"{self.root}/{base}")
        done = {c["path"] for c in now["commits"]}

        def step(later: dict[str, Any]) -> None:
            if later["base"] != now["base"]:
                raise RuntimeError("another writer compacted this log meanwhile; its base stands")
            rest = [c for c in later["commits"] if c["path"] not in done]
            held = shared.has_files(self.spark, f"{self.root}/{base}")
            self._commit_manifest(later, {"base": base if held else None, "base_last": last if held else -1, "commits": rest, **changes})

        self._again(step)

    def _bytes(self, now: dict[str, Any]) -> int:
        return sum(shared.sizes(self.spark, f"{self.root}/{p}") for p in [*([now["base"]] if now["base"] else []), *[c["path"] for c in now["commits"]]])

    def merge(self) -> None:
        """Move pending rows into the base; of each key's pending rows only the newest is kept, under its transaction.

        The manifest's ``merged`` tells what the merge ended with: the highest transaction, and how many rows it took in.
        """
        now = self.manifest()
        if now["commits"]:
            merged = merge_delta(self._read_base(now), self._read_commits(now["commits"]))
            self._rebase(merged, now, {"merged": {"highest_tx": now["last_tx"], "rows": now["pending"]}})

    def compact(self, cut: retention.Cutoffs = retention.Cutoffs(), row_type: str | None = None) -> dict[str, Any]:
        """Write on only what the cut-offs keep, as another row type if given; returns the counts of what went and why,
        and the bytes before and after."""
        now = self.manifest()
        if row_type is not None and row_type not in CODECS:
            raise ValueError(f"no such row type: {row_type}")
        base = self._read_base(now)
        log = base.unionByName(self._read_commits(now["commits"])) if now["commits"] else base
        fates = shared.materialize(retention.classify(log, cut), "fates")
        stats = retention.stats_of(fates.where(F.col("row_type").isin(*CODECS))).first().asDict()
        kept = fates.where(F.col("fate") == "keep").drop("fate")
        if row_type is not None:
            self.row_type = row_type
            kept = kept.withColumn("row_type", F.when(F.col("row_type").isin(*CODECS), F.lit(row_type)).otherwise(F.col("row_type")))
        stats["bytes_before"] = self._bytes(now)
        self._rebase(kept, now, {"stats": stats})
        stats["bytes_after"] = self._bytes(self.manifest())
        return stats

    def validate(self) -> list[str]:
        """What is wrong with the files that the manifest names: missing or unreadable ones, in words."""
        now, wrong = self.manifest(), []
        for part in ([now["base"]] if now["base"] else []) + [c["path"] for c in now["commits"]]:
            path = f"{self.root}/{part}"
            if not shared.exists(self.spark, path):
                wrong.append(f"{part} is missing")
                continue
            try:
                self._read([path]).agg(F.max("tx_id")).collect()
            except Exception as e:  # whatever the reader makes of it
                wrong.append(f"{part} can't be read: {type(e).__name__}")
        return wrong

    def repair(self) -> int:
        """Go back to the longest run of commits whose files can be read, as loading a torn log does; returns how many were dropped."""
        now, bad = self.manifest(), " ".join(self.validate())
        good = []
        for c in now["commits"]:
            if f"{c['path']} " in bad + " ":
                break
            good.append(c)
        dropped = len(now["commits"]) - len(good)
        if dropped:
            self._commit_manifest(now, {"commits": good, "last_tx": max([now["base_last"], *[c["hi"] for c in good]])})
        return dropped

    def vacuum(self, keep: int = 1) -> None:
        """Remove files that none of the last ``keep`` manifests names."""
        versions = self.manifests.numbers()
        named: set[str] = set()
        for v in versions[-keep:]:
            body = self.manifests.state(v)
            named |= {c["path"] for c in body["commits"]} | ({body["base"]} if body["base"] else set())
        for folder in ("data", "base"):
            for n in shared.names(self.spark, f"{self.root}/{folder}"):
                if f"{folder}/{n}" not in named:
                    shared.remove(self.spark, f"{self.root}/{folder}/{n}")
        for v in versions[:-keep]:
            shared.remove(self.spark, f"{self.root}/manifest/{v}")

    def destroy(self) -> None:
        shared.remove(self.spark, self.root)


def with_order(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``seq``, their place within the transaction by ``order``."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("tx_id").orderBy(*order)).cast("bigint"))
