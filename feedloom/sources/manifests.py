"""Numbered states of a folder: each is a small file that is created once, so that of two writers one loses and knows it.

``manifest/<n>`` holds state n.  ``batch/<id>`` tells which state a batch was to make; the batch
counts as done only if that state names it, so a marker left by a failed attempt means nothing.
"""

from __future__ import annotations

import json
import zlib
from typing import Any

from pyspark.sql import SparkSession

from feedloom.sources import shared


class Conflict(RuntimeError):
    """Another writer made the next state first."""


class Manifests:
    """The states below ``root``.  A damaged one is passed over; state 0 is ``empty``."""

    def __init__(self, spark: SparkSession, root: str, empty: dict[str, Any]):
        self.spark, self.root, self.empty = spark, root.rstrip("/"), empty

    def numbers(self) -> list[int]:
        return sorted(int(n) for n in shared.names(self.spark, f"{self.root}/manifest") if n.isdigit())

    def _state(self, n: int) -> dict[str, Any] | None:
        try:
            told = json.loads(shared.read_text(self.spark, f"{self.root}/manifest/{n}"))
            return told["body"] if zlib.crc32(json.dumps(told["body"], sort_keys=True).encode()) == told["crc32"] else None
        except (ValueError, KeyError, TypeError):
            return None

    def newest(self) -> dict[str, Any]:
        for n in reversed(self.numbers()):
            if (body := self._state(n)) is not None:
                return body
        return {"version": 0, **self.empty}

    def state(self, n: int) -> dict[str, Any] | None:
        """State ``n``, or None if it is gone or damaged."""
        return self._state(n) if n in self.numbers() else None

    def _marker(self, batch: str) -> str:
        return f"{self.root}/batch/{batch.encode().hex()}"

    def version_of(self, batch: str) -> int | None:
        """The version that a batch made, or None if it made none."""
        marker = self._marker(batch)
        if not shared.exists(self.spark, marker):
            return None
        n = int(shared.read_text(self.spark, marker))
        body = self.state(n)
        return n if body is not None and body.get("batch") == batch else None

    def commit(self, before: dict[str, Any], changes: dict[str, Any], batch: str | None = None) -> dict[str, Any]:
        """Make the state after ``before``; raises Conflict if that number is taken."""
        body = {**before, **changes, "version": max([before["version"], *self.numbers()[-1:]] if self._damaged(before) else [before["version"]]) + 1, "batch": batch}
        if batch is not None:
            shared.write_text(self.spark, self._marker(batch), str(body["version"]))
        crc = zlib.crc32(json.dumps(body, sort_keys=True).encode())
        try:
            shared.create_text(self.spark, f"{self.root}/manifest/{body['version']}", json.dumps({"body": body, "crc32": crc}))
        except FileExistsError as e:
            raise Conflict(f"state {body['version']} of {self.root} is taken") from e
        return body

    def _damaged(self, before: dict[str, Any]) -> bool:
        """Whether all states after ``before`` are damaged: the next one goes behind them."""
        later = [n for n in self.numbers() if n > before["version"]]
        return bool(later) and all(self._state(n) is None for n in later)
