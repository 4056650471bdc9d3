"""What is synced where, and how far it is: small settings kept as files."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from feedloom.sources import shared


class SyncConfigs:
    """Settings by (sender, from partition, to partition) below ``root``."""

    #: Bounds of 0 or less are none.
    DEFAULTS = {"enabled": True, "from_ts": 0, "to_ts": 0, "from_version": 0, "to_version": 0, "shift_ms": 0}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, sender: str, source: str, target: str) -> str:
        return f"{self.root}/{sender}/{json.dumps([source, target]).encode().hex()}"

    def put(self, sender: str, source: str, target: str, **settings: Any) -> None:
        if unknown := set(settings) - set(self.DEFAULTS):
            raise ValueError(f"no such settings: {sorted(unknown)}")
        shared.write_text(self.spark, self._path(sender, source, target), json.dumps(self.DEFAULTS | settings))

    def get(self, sender: str, source: str, target: str) -> dict[str, Any] | None:
        path = self._path(sender, source, target)
        return json.loads(shared.read_text(self.spark, path)) if shared.exists(self.spark, path) else None

    def all(self, sender: str) -> dict[tuple[str, str], dict[str, Any]]:
        out = {}
        for n in shared.names(self.spark, f"{self.root}/{sender}"):
            source, target = json.loads(bytes.fromhex(n))
            out[source, target] = self.get(sender, source, target)
        return out

    def remove(self, sender: str, source: str, target: str) -> None:
        shared.remove(self.spark, self._path(sender, source, target))


class StreamTotals(StreamingQueryListener):
    """Rows taken in by every streaming query, by its name or id; add it by ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        name = event.progress.name or str(event.progress.id)
        self.rows[name] = self.rows.get(name, 0) + event.progress.numInputRows
        self.batches[name] = self.batches.get(name, 0) + 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
