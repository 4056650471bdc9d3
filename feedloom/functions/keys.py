"""Keys: a nullable prefix and a key; an absent prefix and an empty one are the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def norm_prefix(prefix: Column | str, binary: bool = False) -> Column:
    """The prefix with null spelled as empty."""
    c = F.col(prefix) if isinstance(prefix, str) else prefix
    return F.coalesce(c, F.lit(b"") if binary else F.lit(""))


def prefix_is(prefix: Column, wanted: bytes | str | None) -> Column:
    """The rows of one prefix, absent and empty being one; over the bare column, so that it reaches the files."""
    return (prefix == F.lit(wanted)) if wanted else prefix.isNull() | (F.length(prefix) == 0)


def prefix_upper(prefix: bytes) -> bytes | None:
    """The smallest byte string above all strings that start with ``prefix``.

    None if there is none (an empty prefix, or one of FF bytes only).
    """
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def prefix_upper_text(prefix: str) -> str | None:
    """``prefix_upper`` by code points; surrogates are skipped."""
    points = [ord(c) for c in prefix]
    while points and points[-1] == 0x10FFFF:
        points.pop()
    if not points:
        return None
    last = points[-1] + 1
    points[-1] = 0xE000 if 0xD800 <= last <= 0xDFFF else last
    return "".join(map(chr, points))


def fingerprint(cols: Sequence[Column], salt: int) -> Column:
    """64 bits over the values of ``cols``; null and empty differ."""
    marked = [x for c in cols for x in (F.isnull(c).cast("int"), c)]
    return F.xxhash64(F.lit(salt), *marked)


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names built from ``wanted`` that clash with none of ``df`` (case ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        name = f"__{w}"
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
