"""Queries p1 to p6: each runs its operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.delete_vectors import DeleteVectorTable
from feedloom.operators.dense_groups import dense_group_totals
from feedloom.operators.differential import fold, late_corrected, roll_up, version_of
from feedloom.operators.identifier_index import IdentifierIndex, offer_in_order
from feedloom.operators.incremental import CaptureJob, covers_from_takes, gaps, within
from feedloom.operators.reconcile import compare_copies
from feedloom.functions.keys import norm_prefix
from feedloom.sources.shared import materialize, scratch
from feedloom.sources.tables import MESSAGE, feed, messages, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# --- 1: late and out-of-order events -------------------------------------------------


#: The feed is taken in this many versions, equal slices of its order of delivery.
VERSIONS = 4


def _late(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = feed(spark, sf_dir).select(*MESSAGE, "delivery_id", "partition_version", "value_timestamp")
    low, high = rows.agg(F.min("delivery_id"), F.max("delivery_id")).first()
    came = version_of(F.col("delivery_id"), low or 0, high or 0, VERSIONS)
    log = rows.select("partition_name", "partition_version", "tx_id", "value_timestamp", came.alias("version"))
    info = table(spark, sf_dir, "partition_info").groupBy("partition_name").agg(F.max("late_cutoff_ms").alias("late_cutoff_ms"))
    told = messages(rows, "partition_version", "value_timestamp").withColumn("version", came).join(info, "partition_name", "left")
    return late_corrected(told, log, ["partition_name", "partition_version"], "tx_id", "value_timestamp", "late_cutoff_ms", "version", VERSIONS, keep=["partition_name"])


_LATE_SQL = f"""
WITH b AS (SELECT min(delivery_id) AS lo, greatest(1, (max(delivery_id) - min(delivery_id) + {VERSIONS}) // {VERSIONS}) AS width FROM feed_rows),
f AS (SELECT feed_rows.*, coalesce(prefix, '') AS p, (delivery_id - lo) // width + 1 AS v FROM feed_rows, b),
m AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY partition_name, tx_id, p, row_key, value_version ORDER BY delivery_id) = 1),
t AS (SELECT partition_name, partition_version, tx_id, u, max(CASE WHEN v <= u THEN value_timestamp END) AS top FROM f, range(1, {VERSIONS + 1}) r(u) WHERE value_timestamp > 0 GROUP BY ALL),
h AS (SELECT partition_name, partition_version, tx_id, u, max(top) OVER (PARTITION BY partition_name, partition_version, u ORDER BY tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS frontier FROM t),
g AS (SELECT m.delivery_id, min(h.u) AS gone FROM m JOIN h USING (partition_name, partition_version, tx_id) JOIN partition_info i USING (partition_name)
  WHERE m.value_timestamp > 0 AND h.u >= m.v AND h.frontier - m.value_timestamp > i.late_cutoff_ms GROUP BY 1),
c AS (SELECT m.*, g.gone, value_timestamp - value_timestamp % 3600000 AS period_start FROM m LEFT JOIN g USING (delivery_id) WHERE value_timestamp > 0),
k AS (SELECT partition_name, period_start, v AS version, 1 AS sign FROM c WHERE gone IS NULL OR gone > v UNION ALL SELECT partition_name, period_start, gone, -1 FROM c WHERE gone > v),
n AS (SELECT partition_name, period_start, version, cast(sum(sign) AS bigint) AS dn FROM k GROUP BY ALL HAVING sum(sign) <> 0)
"""


@query(_LATE_SQL + "SELECT delivery_id FROM c WHERE gone IS NOT NULL")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages whose signs add up to nothing: never counted, or counted and taken back in a later version."""
    return _late(spark, sf_dir)[0].where(F.col("lateness") == "too_late").select("delivery_id")


@query(_LATE_SQL + "SELECT partition_name, period_start, cast(sum(dn) AS bigint) AS n FROM n GROUP BY ALL HAVING sum(dn) <> 0")
def p1_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold(_late(spark, sf_dir)[1], ["partition_name", "period_start"], ["n"])


@query(
    _LATE_SQL
    + """, s AS (SELECT partition_name, period_start, version, dn, cast(sum(dn) OVER w AS bigint) AS after, row_number() OVER w AS i FROM n WINDOW w AS (PARTITION BY partition_name, period_start ORDER BY version))
SELECT partition_name, period_start, version, 1 AS sign, after AS n FROM s
UNION ALL SELECT partition_name, period_start, version, -1, after - dn FROM s WHERE i > 1"""
)
def p1_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each version tells: old counts with sign -1, new ones with sign +1."""
    return _late(spark, sf_dir)[1]


@query(
    _LATE_SQL
    + """, d AS (SELECT i.ring_name, n.period_start // 86400000 AS day, cast(sum(dn) AS bigint) AS n FROM n JOIN (SELECT DISTINCT partition_name, ring_name FROM partition_info) i USING (partition_name) GROUP BY ALL)
SELECT * FROM d WHERE n <> 0"""
)
def p1_ring_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly deltas carried on to counts per ring and day."""
    rings = table(spark, sf_dir, "partition_info").select("partition_name", "ring_name").distinct()
    hourly = _late(spark, sf_dir)[1].join(rings, "partition_name")
    day = F.call_function("div", F.col("period_start"), F.lit(86_400_000).cast("bigint"))
    return fold(roll_up(hourly, {"ring_name": F.col("ring_name"), "day": day}, ["n"]), ["ring_name", "day"], ["n"])


# --- 2: a stream of inserts, updates and deletes ---------------------------------------


#: The feed is applied in this many slices of its order of delivery.
SLICES = 4


def _slices(rows: DataFrame, parts: int) -> list[DataFrame]:
    """The feed as it was delivered, in ``parts`` slices; none if it is empty."""
    low, high = rows.agg(F.min("delivery_id"), F.max("delivery_id")).first()
    if low is None:
        return []
    width = max(1, -(-(high - low + 1) // parts))
    d = F.col("delivery_id")
    return [rows.where((d >= start) & (d < start + width)) for start in range(low, high + 1, width)]


def _state(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """The standing rows of the feed, applied slice by slice through the index of those before."""
    key = {"partition_name": F.col("partition_name"), "prefix": norm_prefix("prefix"), "row_key": F.col("row_key")}
    t = DeleteVectorTable(spark, scratch(spark, "state"), key, ["value_timestamp", "value_version"], ["tx_id", "delivery_id"])
    rows = table(spark, sf_dir, "feed_rows").select(*dict.fromkeys([*columns, "partition_name", "prefix", "row_key", "value_timestamp", "value_version", "tx_id", "delivery_id"]))
    for i, part in enumerate(_slices(rows, SLICES) or [rows]):
        t.apply(part, f"slice-{i}")
    return t.read(columns)


_STATE_SQL = """
WITH s AS (SELECT * REPLACE (coalesce(prefix, '') AS prefix) FROM feed_rows
QUALIFY row_number() OVER (PARTITION BY partition_name, coalesce(prefix, ''), row_key ORDER BY value_timestamp DESC, value_version DESC, tx_id, delivery_id) = 1)
"""


@query(_STATE_SQL + "SELECT partition_name, prefix, row_key, tx_id FROM s WHERE NOT value_tombstoned")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _state(spark, sf_dir, ["partition_name", "prefix", "row_key", "tx_id", "value_tombstoned"])
    return rows.where(~F.coalesce("value_tombstoned", F.lit(False))).select("partition_name", norm_prefix("prefix").alias("prefix"), "row_key", "tx_id")


@query(_STATE_SQL + "SELECT partition_name, prefix, row_key, row_value, value_timestamp, value_tombstoned, value_version, tx_id, delivery_id FROM s")
def p2_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standing row of every key, tombstones included."""
    cols = ["partition_name", "prefix", "row_key", "row_value", "value_timestamp", "value_tombstoned", "value_version", "tx_id", "delivery_id"]
    return _state(spark, sf_dir, cols).withColumn("prefix", norm_prefix("prefix"))


# --- 3: differences between two copies ---------------------------------------------------

_FIELDS = ["row_value", "value_timestamp", "value_tombstoned", "value_version"]


@query(
    """
WITH m AS (SELECT r.* REPLACE (coalesce(prefix, '') AS prefix), ring_member = first_member AS f, ring_member = second_member AS s
  FROM member_rows r JOIN partition_info i USING (partition_name)),
o AS (SELECT partition_name, prefix, row_key, row_value, value_timestamp, value_tombstoned, value_version, f, s FROM m WHERE f OR s
  QUALIFY row_number() OVER (PARTITION BY partition_name, prefix, row_key, f ORDER BY value_timestamp DESC, value_version DESC, row_value DESC NULLS LAST, value_tombstoned DESC) = 1),
a AS (SELECT * FROM o WHERE f), b AS (SELECT * FROM o WHERE s),
j AS (SELECT coalesce(a.partition_name, b.partition_name) AS partition_name, coalesce(a.prefix, b.prefix) AS prefix, coalesce(a.row_key, b.row_key) AS row_key,
  CASE WHEN b.row_key IS NULL THEN ['only_first'] WHEN a.row_key IS NULL THEN ['only_second'] ELSE list_filter([
    CASE WHEN a.row_value IS DISTINCT FROM b.row_value THEN 'row_value' END, CASE WHEN a.value_timestamp IS DISTINCT FROM b.value_timestamp THEN 'value_timestamp' END,
    CASE WHEN a.value_tombstoned IS DISTINCT FROM b.value_tombstoned THEN 'value_tombstoned' END, CASE WHEN a.value_version IS DISTINCT FROM b.value_version THEN 'value_version' END], lambda x: x IS NOT NULL) END AS d
  FROM a FULL JOIN b ON a.partition_name = b.partition_name AND a.prefix = b.prefix AND a.row_key = b.row_key)
SELECT partition_name, prefix, row_key, unnest(d) AS difference FROM j"""
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "member_rows").withColumn("prefix", norm_prefix("prefix"))
    info = table(spark, sf_dir, "partition_info").select("partition_name", "first_member", "second_member").distinct()
    placed = rows.join(info, "partition_name")
    first = placed.where(F.col("ring_member") == F.col("first_member"))
    second = placed.where(F.col("ring_member") == F.col("second_member"))
    return compare_copies(first, second, ["partition_name", "prefix", "row_key"], _FIELDS, ["value_timestamp", "value_version"])


# --- 4: messages delivered more than once ------------------------------------------------

_COPIES_SQL = "SELECT {} FROM (SELECT *, row_number() OVER (PARTITION BY partition_name, tx_id, coalesce(prefix, ''), row_key, value_version ORDER BY delivery_id) AS i FROM feed_rows) WHERE i {} 1"


def _kept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = feed(spark, sf_dir)
    identity = [F.col(c) for c in ("partition_name", "tx_id", "prefix", "row_key", "value_version")]
    bits = IdentifierIndex.bits_for(table(spark, sf_dir, "feed_rows").count())
    index = IdentifierIndex(spark, scratch(spark, "identifiers"), identity, "delivery_id", bits, merge_at=3)
    offer_in_order(index, rows, batches=4)
    return rows, index.kept()


@query(_COPIES_SQL.format("delivery_id", ">"))
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, kept = _kept(spark, sf_dir)
    return rows.select("delivery_id").join(kept, "delivery_id", "left_anti")


@query(_COPIES_SQL.format("partition_name, coalesce(prefix, '') AS prefix, row_key, tx_id, value_version, delivery_id", "="))
def p4_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies kept."""
    rows, kept = _kept(spark, sf_dir)
    return rows.select("partition_name", "prefix", "row_key", "tx_id", "value_version", "delivery_id").join(kept, "delivery_id", "left_semi")


# --- 5: a few keys holding most records --------------------------------------------------


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_group_totals(feed(spark, sf_dir), ["partition_name", "prefix"], ["tx_id"])


@query("SELECT partition_name, coalesce(prefix, '') AS prefix FROM feed_rows GROUP BY 1, 2 HAVING 50 * count(*) >= (SELECT count(*) FROM feed_rows)")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = materialize(_pairs(spark, sf_dir), "pairs")
    total = pairs.agg(F.sum("n")).first()[0] or 0
    return pairs.where(F.col("n") * 50 >= total).select("partition_name", "prefix")


@query("SELECT partition_name, coalesce(prefix, '') AS prefix, count(*) AS n, max(tx_id) AS max_tx_id FROM feed_rows GROUP BY 1, 2")
def p5_pair_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


# --- 6: only new or changed records ------------------------------------------------------

_TAKER = ["ring_member", "partition_name", "partition_version"]


def _given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every taker must still be given, in two runs: one over the first half of the deliveries, one over what came
    since.  The second run breaks off after its plan is written, as in a crash, and a new job takes the plan up."""
    takes = table(spark, sf_dir, "row_takes")
    success = F.lower(F.trim("outcome")) == "tookfrom"
    openings = materialize(gaps(takes, covers_from_takes(takes, table(spark, sf_dir, "highwaters"), success), _TAKER, "remote_tx_id", "highwater_tx_id"), "gaps")

    def untaken(rows: DataFrame) -> DataFrame:
        return within(rows, openings, _TAKER, _TAKER[1:], "tx_id")

    rows = table(spark, sf_dir, "feed_rows").select("delivery_id", *_TAKER[1:], "tx_id")
    root = scratch(spark, "takes")
    halves = _slices(rows, 2)
    if not halves:
        return untaken(rows)
    CaptureJob(spark, root, _TAKER[1:], "delivery_id", _TAKER, "tx_id").run(halves[0], untaken)
    CaptureJob(spark, root, _TAKER[1:], "delivery_id", _TAKER, "tx_id").plan(rows)
    job = CaptureJob(spark, root, _TAKER[1:], "delivery_id", _TAKER, "tx_id")
    job.run(rows, untaken)
    return job.sink().select(*_TAKER, "tx_id")


_PENDING_SQL = """
WITH g AS (SELECT take_id, max(highwater_tx_id) AS hw FROM highwaters WHERE take_id IS NOT NULL GROUP BY 1),
c AS (SELECT DISTINCT ring_member, partition_name, partition_version, remote_tx_id, hw FROM row_takes JOIN g USING (take_id) WHERE lower(trim(outcome)) = 'tookfrom' AND hw > remote_tx_id),
r AS (SELECT ring_member, partition_name, partition_version, remote_tx_id, max(hw) OVER (PARTITION BY ring_member, partition_name, partition_version ORDER BY remote_tx_id) AS reach FROM c),
x AS (SELECT DISTINCT partition_name, partition_version, tx_id FROM feed_rows),
p AS (SELECT DISTINCT t.ring_member, x.* FROM (SELECT DISTINCT ring_member, partition_name, partition_version FROM row_takes) t JOIN x USING (partition_name, partition_version)),
q AS (SELECT p.*, (SELECT max(reach) FROM r WHERE r.ring_member = p.ring_member AND r.partition_name = p.partition_name AND r.partition_version = p.partition_version AND r.remote_tx_id < p.tx_id) AS reach FROM p)
"""


@query(_PENDING_SQL + "SELECT ring_member, partition_name, partition_version, tx_id FROM q WHERE reach IS NULL OR reach < tx_id")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _given(spark, sf_dir)


@query(_PENDING_SQL + "SELECT ring_member, partition_name, partition_version, count(*) AS pending, min(tx_id) AS first_tx_id FROM q WHERE reach IS NULL OR reach < tx_id GROUP BY ALL")
def p6_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each taker still has to take."""
    return _given(spark, sf_dir).groupBy(*_TAKER).agg(F.count(F.lit(1)).alias("pending"), F.min("tx_id").alias("first_tx_id"))
