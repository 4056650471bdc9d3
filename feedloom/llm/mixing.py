"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.prefix_scan import prefix_scan
from feedloom.sources.shared import materialize


def supplies(items: DataFrame, targets: DataFrame, source: str, size: str, share: str, repeats: str) -> DataFrame:
    """One row per source with a target: ``weight`` among the sources that have items, ``supply`` of one round, ``most`` it can give."""
    have = items.groupBy(F.col(source).alias("s")).agg(F.sum(size).alias("supply"), F.count(F.lit(1)).alias("items"))
    t = targets.where(F.col(source).isNotNull() & (F.col(share) > 0)).groupBy(source).agg(F.max(share).alias("share"), F.max(F.coalesce(F.col(repeats), F.lit(1))).alias("repeats"))
    t = t.join(have, F.col(source) == F.col("s"), "left").drop("s").fillna(0, ["supply", "items"])
    usable = (F.col("supply") > 0) & (F.col("repeats") > 0)
    total = t.where(usable).agg(F.sum("share").alias("all")).first()[0] or 1.0
    return t.select(
        source, "share", "repeats", "items", "supply", F.when(usable, F.col("share") / F.lit(float(total))).alias("weight"), (F.col("supply") * F.col("repeats")).alias("most")
    )


def mix(
    items: DataFrame, targets: DataFrame, item: str, source: str, size: str, share: str = "target_share", repeats: str = "max_repeats", budget: int | None = None, seed: int = 17
) -> DataFrame:
    """The draws: item, source, ``draw`` (1, 2, ...), size, ``virtual_finish``, in no order.

    Each source is shuffled by a hash, anew for every draw round, and an item's virtual finish time is
    the size its source has given up to it divided by the source's weight.  All sources are
    merged by that time and cut where the total would pass ``budget``.  Without a budget the largest
    one is taken at which no source runs out, so that all shares meet their targets; with a
    larger one, sources that run out after ``repeats`` rounds fall short.  Weights are taken
    among the sources that have items.  Items without a target, without a size or of size 0 stay
    out; an empty table of either kind gives no rows.
    """
    items = items.where(F.col(size) > 0).select(F.col(item).alias("id"), F.col(source).alias("src"), F.col(size).cast("bigint").alias("n"))
    have = supplies(items.select(F.col("src").alias(source), F.col("n").alias(size)), targets, source, size, share, repeats)
    have = materialize(have.where(F.col("weight").isNotNull()), "supplies")
    reach = have.agg(F.min(F.col("most") / F.col("weight"))).first()[0]
    total = int(budget if budget is not None else (reach or 0))
    # Rounds a source can be asked for: those its share of the budget needs, one more for the last item.
    need = F.least(F.col("repeats").cast("bigint"), F.ceil(F.lit(float(total)) * F.col("weight") / F.col("supply")) + 1)
    rounds = have.select(F.col(source).alias("src"), "weight", need.alias("rounds"))
    draws = items.join(F.broadcast(rounds) if have.count() <= 10_000 else rounds, "src")
    draws = draws.select("id", "src", "n", "weight", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rounds"))).alias("draw"))
    draws = draws.withColumn("mixed", F.xxhash64(F.lit(seed), "draw", "id"))
    given = prefix_scan(draws, ["src"], ["draw", "mixed", "id"], {"before": (F.col("n"), "sum")})
    timed = given.withColumn("virtual_finish", (F.coalesce("before", F.lit(0)) + F.col("n")) / F.col("weight"))
    line = prefix_scan(timed.select("id", "src", "n", "draw", "virtual_finish"), [], ["virtual_finish", "src", "draw", "id"], {"so_far": (F.col("n"), "sum")})
    kept = line.where(F.coalesce("so_far", F.lit(0)) + F.col("n") <= total)
    return kept.select(F.col("id").alias(item), F.col("src").alias(source), "draw", F.col("n").alias(size), "virtual_finish")


def shares(draws: DataFrame, targets: DataFrame, source: str, size: str, share: str = "target_share") -> DataFrame:
    """Per source with a target: target and actual share of the total size, draws, and the most often one item was used."""
    got = draws.groupBy(F.col(source).alias("s")).agg(F.sum(size).alias("tokens"), F.count(F.lit(1)).alias("draws"), F.max("draw").alias("rounds"))
    t = targets.where(F.col(source).isNotNull()).groupBy(source).agg(F.max(share).alias(share))
    t = t.join(got, F.col(source) == F.col("s"), "left").drop("s").fillna(0, ["tokens", "draws", "rounds"])
    # One row per target: a window over all of them is as small as that table.
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return t.select(source, share, (F.col("tokens") / F.nullif(total, F.lit(0))).alias("actual_share"), "tokens", "draws", "rounds")
