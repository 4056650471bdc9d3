"""Queries p7 to p9 over the texts of ``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.mixing import mix, shares
from feedloom.llm.packing import pack
from feedloom.llm.residue import find_residue
from feedloom.llm.tokens import token_count
from feedloom.sources.shared import materialize, spread
from feedloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Tokenizing and learning can't be said in SQL: those queries are tested in tests/llm.  What packing and mixing
#: promise can, and is checked on their own output.
SQL: dict[str, str] = {}


def query(f=None, sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep(f) if f else keep


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size in tokens, counted once."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return materialize(docs.select("doc_id", "source", token_count(F.col("text")).alias("n_tokens")), "sizes")


# --- 7: filling fixed-capacity containers ---------------------------------------------


def _packed(spark: SparkSession, sf_dir: str, sizes: DataFrame | None = None) -> DataFrame:
    return pack(sizes if sizes is not None else _sizes(spark, sf_dir), table(spark, sf_dir, "pack_limits"), "doc_id", "n_tokens", "pack_name", "capacity_tokens")


@query
def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every text goes."""
    return _packed(spark, sf_dir)


@query
def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pack: containers used, the fewest that the tokens could need, and the share filled."""
    held = _packed(spark, sf_dir).groupBy("pack_name", "container_id").agg(F.sum("tokens").alias("used"))
    limits = table(spark, sf_dir, "pack_limits")
    per = held.groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return per.join(limits, "pack_name").select(
        "pack_name", "capacity_tokens", "containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("fewest"), "tokens", "fullest", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled")
    )


@query(
    sql="""SELECT pack_name, cast(0 AS bigint) AS overfull, cast(0 AS bigint) AS wrongly_cut, cast(0 AS bigint) AS gaps, (SELECT count(*) FROM documents WHERE text <> '') AS documents
FROM pack_limits"""
)
def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What packing promises, counted on its output: containers above their capacity, texts cut that would have fit, texts whose
    pieces don't make them up without gap or overlap, and texts packed."""
    sizes = _sizes(spark, sf_dir)
    packed = materialize(_packed(spark, sf_dir, sizes), "packed")
    limits = table(spark, sf_dir, "pack_limits").select("pack_name", "capacity_tokens").distinct()
    held = packed.groupBy("pack_name", "container_id").agg(F.sum("tokens").alias("used")).join(limits, "pack_name")
    full = held.groupBy("pack_name").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("overfull"))
    whole = packed.groupBy("pack_name", "doc_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("sum"), F.max(F.col("first_token") + F.col("tokens")).alias("end"), F.countDistinct("first_token").alias("starts"), F.min("first_token").alias("first")
    )
    whole = whole.join(limits, "pack_name").join(sizes.select("doc_id", "n_tokens"), "doc_id")
    gap = (F.col("sum") != F.col("n_tokens")) | (F.col("end") != F.col("n_tokens")) | (F.col("starts") != F.col("pieces")) | (F.col("first") != 0)
    told = whole.groupBy("pack_name").agg(
        F.count_if((F.col("n_tokens") <= F.col("capacity_tokens")) & (F.col("pieces") > 1)).alias("wrongly_cut"), F.count_if(gap).alias("gaps"), F.count(F.lit(1)).alias("documents")
    )
    return full.join(told, "pack_name").select("pack_name", "overfull", "wrongly_cut", "gaps", "documents")


# --- 8: mixing sources to target weights ------------------------------------------------


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "doc_id", "source", "n_tokens")


@query
def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draw: which document, the how-manieth time, and when it comes."""
    return _mixed(spark, sf_dir)


@query
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of all tokens each source was to have and has."""
    return shares(_mixed(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "source", "n_tokens")


@query(
    sql="""SELECT source, cast(0 AS bigint) AS over_repeats, cast(0 AS bigint) AS drawn_twice, cast(0 AS bigint) AS elsewhere, cast(0 AS bigint) AS out_of_turn, true AS on_target
FROM (SELECT DISTINCT source FROM mix_targets WHERE source IS NOT NULL AND target_share > 0) WHERE source IN (SELECT source FROM documents WHERE text <> '')"""
)
def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What mixing promises, counted on its output per source: draws beyond what may be repeated, draws of one text in one round
    twice, draws of texts of another source, texts drawn again before all were drawn once, and whether the source's
    share is off its target by no more than two of the largest texts."""
    sizes = _sizes(spark, sf_dir)
    targets = table(spark, sf_dir, "mix_targets").where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most"))
    have = sizes.where("n_tokens > 0").groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.max("n_tokens").alias("largest"))
    known = targets.join(have, "source")
    weights = known.withColumn("all", known.agg(F.sum("share")).scalar())
    draws = materialize(mix(sizes, table(spark, sf_dir, "mix_targets"), "doc_id", "source", "n_tokens"), "draws")
    one = draws.groupBy("source", "doc_id", "draw").agg(F.count(F.lit(1)).alias("times"), F.max("n_tokens").alias("n"))
    one = one.join(sizes.select("doc_id", F.col("source").alias("own")), "doc_id")
    per = one.groupBy("source", "draw").agg(F.count(F.lit(1)).alias("drawn"), F.sum("n").alias("tokens"), F.count_if(F.col("times") > 1).alias("twice"), F.count_if(~F.col("own").eqNullSafe(F.col("source"))).alias("elsewhere"))
    last = per.groupBy("source").agg(F.max("draw").alias("last"))
    per = per.join(last, "source").join(weights, "source")
    told = per.groupBy("source").agg(
        F.sum(F.when(F.col("draw") > F.col("most"), F.col("drawn")).otherwise(0)).alias("over_repeats"), F.sum("twice").alias("drawn_twice"), F.sum("elsewhere").alias("elsewhere"),
        F.sum(F.when((F.col("draw") < F.col("last")), F.col("texts") - F.col("drawn")).otherwise(0)).alias("out_of_turn"), F.sum("tokens").alias("tokens"), F.max("largest").alias("largest"), F.max(F.col("share") / F.col("all")).alias("weight"),
    )
    total = draws.agg(F.sum("n_tokens")).scalar()
    widest = sizes.agg(F.max("n_tokens")).scalar()
    off = F.abs(F.col("tokens") - F.col("weight") * total) <= 2 * widest
    return told.select("source", "over_repeats", "drawn_twice", "elsewhere", "out_of_turn", off.alias("on_target"))


# --- 9: template residue and error pages -------------------------------------------------


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_residue(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without residue."""
    docs = table(spark, sf_dir, "documents")
    found = find_residue(docs.select("doc_id", "text"))
    return docs.select("doc_id", "lang", "source", "n_chars").join(found, "doc_id", "left_anti")
