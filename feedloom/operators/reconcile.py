"""Differences between two copies of a data set, found by hierarchical checksums.

Keys are spread over a range of 64-bit tokens.  Every row is reduced to checksums where it
lies; they are summed up over the finest token ranges, and a level up holds the sums of its
parts.  From the top, only ranges whose sums differ are split further, and only rows in the
finest differing ranges are fetched and compared, field by field.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.keys import fingerprint
from feedloom.sources.shared import materialize


def latest_rows(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """One row per key: the one largest by ``newest``; equal ones fall back on the other fields' order.

    Nulls count as smallest, so the choice is the same on every run.
    """
    parts = [*newest, *[f for f in fields if f not in newest]]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*[F.col(p) for p in parts])).alias("__b"))
    return best.select(*keys, *[F.col(f"__b.{f}").alias(f) for f in fields])


def _differs() -> Column:
    return ~(F.col("l1").eqNullSafe(F.col("r1")) & F.col("l2").eqNullSafe(F.col("r2")) & F.col("ln").eqNullSafe(F.col("rn")))


def row_checksums(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """``token`` (64 bits of the key's hash), ``side``, ``c1`` and ``c2`` of the newest row of every key and side.

    Only hashes and the columns of ``newest`` are shuffled, never a row.  Where several rows of a key tie as the newest
    and differ, the checksums can't know which one counts: such a key's checksums are made to differ from
    the other side's, so that its rows are looked at.
    """
    key, image = [F.col(c) for c in keys], [F.col(c) for c in [*keys, *fields]]
    marked = rows.select(fingerprint(key, 11).alias("token"), fingerprint(key, 13).alias("h"), "side", *newest, fingerprint(image, 23).alias("c1"), fingerprint(image, 47).alias("c2"))
    top = F.max(F.struct(*newest, "c1", "c2")).alias("hi")
    low = F.max(F.struct(*newest, F.bitwise_not("c1").alias("c1"), F.bitwise_not("c2").alias("c2"))).alias("lo")
    one = marked.groupBy("token", "h", "side").agg(top, low)
    sure = (F.col("hi.c1") == F.bitwise_not("lo.c1")) & (F.col("hi.c2") == F.bitwise_not("lo.c2"))
    odd = [F.xxhash64("token", "h", "side", F.lit(i)) for i in (1, 2)]
    return one.select("token", "side", F.when(sure, F.col("hi.c1")).otherwise(odd[0]).alias("c1"), F.when(sure, F.col("hi.c2")).otherwise(odd[1]).alias("c2"))


def differing_ranges(sums: DataFrame, leaf_bits: int, step_bits: int) -> DataFrame:
    """The finest ranges (the first ``leaf_bits`` of the token, as ``leaf``) whose checksums differ, reached from the top down.

    The sums are exclusive-ors of two 64-bit checksums beside the count, made in one pass with partial
    aggregation; each level is made from the one below it and kept, so that every row is summed once.
    """
    pick = lambda s, c: F.when(F.col("side") == s, F.col(c))
    level = sums.groupBy(F.shiftrightunsigned("token", 64 - leaf_bits).alias("at")).agg(
        *[F.call_function("bit_xor", pick(s, c)).alias(f"{'lr'[s]}{i}") for s in (0, 1) for i, c in ((1, "c1"), (2, "c2"))],
        F.count(pick(0, "c1")).alias("ln"),
        F.count(pick(1, "c1")).alias("rn"),
    )
    levels = [materialize(level, "leaves")]
    left = leaf_bits
    while left > step_bits:
        xor = [F.expr(f"bit_xor({c})").alias(c) for c in ("l1", "l2", "r1", "r2")]
        level = levels[-1].groupBy(F.shiftright("at", step_bits).alias("at")).agg(*xor, F.sum("ln").alias("ln"), F.sum("rn").alias("rn"))
        levels.append(materialize(level, "sums"))
        left -= step_bits
    open_at = levels[-1].where(_differs()).select("at")
    for level in reversed(levels[:-1]):
        below = level.withColumn("up", F.shiftright("at", step_bits)).join(open_at.withColumnRenamed("at", "up"), "up", "left_semi")
        open_at = below.where(_differs()).select("at")
    return open_at.withColumnRenamed("at", "leaf")


def compare_copies(
    first: DataFrame,
    second: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str],
    newest: Sequence[str],
    rows_per_leaf: int = 64,
    step_bits: int = 4,
) -> DataFrame:
    """One row per key and difference: ``only_first``, ``only_second`` or a differing field's name.

    Of several rows of a copy for a key the newest counts, of equally new ones the largest in the other fields.
    Values are compared exactly: null equals null and nothing else.  Null key values match each other.  If either copy
    is empty every key of the other is reported; two empty copies give no rows.  Columns beyond keys and fields
    are ignored, whatever they are called; ``newest`` names some of the fields.  Only rows in ranges whose checksums
    differ are moved.  Differences stay unseen if the checksums of a whole range agree by chance, 2**-128 each.
    """
    k = [f"k{i}" for i, _ in enumerate(keys)]
    f = [f"f{i}" for i, _ in enumerate(fields)]
    new = [f[list(fields).index(c)] for c in newest]

    def bare(df: DataFrame, side: int) -> DataFrame:
        return df.select(*[F.col(c).alias(n) for c, n in zip([*keys, *fields], [*k, *f])], F.lit(side).alias("side"))

    both = bare(first, 0).unionByName(bare(second, 1))
    sums = materialize(row_checksums(both, k, f, new), "checksums")
    leaf_bits = min(48, max(step_bits, math.ceil(math.log2(max(sums.count() / rows_per_leaf, 1)))))
    open_at = differing_ranges(sums, leaf_bits, step_bits)
    leaf = both.withColumn("leaf", F.shiftrightunsigned(fingerprint([F.col(c) for c in k], 11), 64 - leaf_bits)).join(open_at, "leaf", "left_semi")
    one = latest_rows(leaf, [*k, "side"], f, new)
    row = F.struct(*f)
    pair = one.groupBy(*k).agg(F.max(F.when(F.col("side") == 0, row)).alias("l"), F.max(F.when(F.col("side") == 1, row)).alias("r"))
    unlike = [F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(name)) for c, name in zip(f, fields)]
    found = (
        F.when(F.col("r").isNull(), F.array(F.lit("only_first")))
        .when(F.col("l").isNull(), F.array(F.lit("only_second")))
        .otherwise(F.array_compact(F.array(*unlike)))
    )
    return pair.select(*[F.col(n).alias(c) for n, c in zip(k, keys)], F.explode(found).alias("difference"))
