"""Queries over the log read from ``events`` (and catalog tables), one per operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.functions.keys import norm_prefix, prefix_upper_text
from feedloom.operators import catalog, changes, consistency, inspect, reads, resolve, retention, sync
from feedloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# --- The log ``w``: events in scrambled commit order, so that late rows meet newer ones. ---


def w(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    seq = F.expr("(event_id * 7919) % 100003")
    return e.select(
        F.expr("(event_id * 7919) % 100003 div 40").alias("tx_id"),
        seq.alias("seq"),
        F.col("event_type").alias("prefix"),
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit("-"), (F.col("event_id") % 4).cast("string")).alias("key"),
        F.when(F.col("event_id") % 7 != 0, F.col("props")).alias("value"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_id"),
        (F.col("event_id") % 7 == 0).alias("tombstoned"),
        (seq + 1).alias("version"),
        (F.col("event_id") % 3).alias("replica"),
    )


_W = """
WITH w AS (SELECT ((event_id * 7919) % 100003) // 40 AS tx_id, (event_id * 7919) % 100003 AS seq, event_type AS prefix,
  concat('u', lpad(cast(user_id AS varchar), 6, '0'), '-', cast(event_id % 4 AS varchar)) AS key,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE props END AS value, epoch_us(ts) AS ts_id, (event_id % 7 = 0) AS tombstoned,
  (event_id * 7919) % 100003 + 1 AS version, event_id % 3 AS replica FROM events)"""
_TOP = "QUALIFY row_number() OVER (PARTITION BY prefix, key ORDER BY ts_id DESC, version DESC, tx_id, seq DESC) = 1"
_L = _W + f", l AS (SELECT * FROM w {_TOP})"
_HALF = f"""{_W}, h AS (SELECT max(tx_id) // 2 AS cut FROM w), a AS (SELECT * FROM w WHERE tx_id < (SELECT cut FROM h)), b AS (SELECT * FROM w WHERE tx_id >= (SELECT cut FROM h)),
la AS (SELECT * FROM a {_TOP}), lb AS (SELECT * FROM b {_TOP})"""
_COLS = "tx_id, seq, prefix, key, value, ts_id, tombstoned, version"


def _cols(df: DataFrame) -> DataFrame:
    return df.select("tx_id", "seq", "prefix", "key", "value", "ts_id", "tombstoned", "version")


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The log split at half its highest transaction: what is stored, what comes."""
    log = w(spark, sf_dir)
    cut = log.agg(F.call_function("div", F.max("tx_id"), F.lit(2))).scalar()
    return log.where(F.col("tx_id") < cut), log.where(F.col("tx_id") >= cut)


# --- Resolving ---------------------------------------------------------------------------


@query(_L + f" SELECT {_COLS} FROM l")
def lww_resolve(spark, sf_dir):
    return _cols(resolve.lww(w(spark, sf_dir)))


@query(
    _HALF
    + " SELECT CASE WHEN la.key IS NULL THEN 'added' WHEN (lb.ts_id, lb.version) > (la.ts_id, la.version) THEN 'clobbered' ELSE 'ignored' END AS mode, count(*) AS n FROM lb LEFT JOIN la ON la.prefix = lb.prefix AND la.key = lb.key GROUP BY 1"
)
def index_merge_modes(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    return resolve.merge_modes(a, b).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


@query(
    _HALF
    + """ SELECT lb.prefix, lb.key, lb.ts_id, lb.version, lb.tombstoned, CASE WHEN la.key IS NULL THEN 'apply' WHEN lb.tombstoned AND NOT la.tombstoned THEN 'remove' ELSE 'clobber' END AS change, la.ts_id AS old_ts_id, la.tombstoned AS old_tombstoned
  FROM lb LEFT JOIN la ON la.prefix = lb.prefix AND la.key = lb.key WHERE la.key IS NULL OR lb.ts_id > la.ts_id OR (lb.ts_id = la.ts_id AND lb.version > la.version)"""
)
def commit_changes_feed(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    return resolve.commit_changes(a, b).select("prefix", "key", "ts_id", "version", "tombstoned", "change", "old_ts_id", "old_tombstoned")


@query(_L + f" SELECT {_COLS} FROM l WHERE NOT tombstoned")
def overlay_scan(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    return _cols(resolve.live(resolve.overlay(a, b)))


@query(_HALF + f" SELECT {_COLS} FROM a UNION ALL SELECT {_COLS} FROM lb")
def delta_merge_history(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    return _cols(resolve.merge_delta(a, b))


@query(_W + " SELECT prefix, key, ts_id, version, tombstoned FROM w QUALIFY row_number() OVER (PARTITION BY prefix, key ORDER BY ts_id DESC, seq DESC) = 1")
def update_builder(spark, sf_dir):
    return resolve.update_batch(w(spark, sf_dir)).select("prefix", "key", "ts_id", "version", "tombstoned")


@query(
    """SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY epoch_us(o_orderdate) DESC, o_orderkey DESC) = 1"""
)
def lww_orders(spark, sf_dir):
    """The same with orders as versions of their customer."""
    o = table(spark, sf_dir, "orders")
    log = o.select(F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts_id"), F.col("o_orderkey").alias("version"), *o.columns)
    return resolve.lww(log, ["o_custkey"]).select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT page_id, rev_id, page_title, strlen(text) AS bytes FROM documents QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY epoch_us(rev_at) DESC, rev_id DESC, doc_id) = 1")
def lww_revisions(spark, sf_dir):
    """The same with large values: the revision of each page that stands."""
    d = table(spark, sf_dir, "documents")
    log = d.select("page_id", "rev_id", "page_title", F.octet_length("text").cast("bigint").alias("bytes"), F.unix_micros(F.col("rev_at").cast("timestamp")).alias("ts_id"), F.col("rev_id").alias("version"), F.col("doc_id").alias("tx_id"))
    return resolve.lww(log, ["page_id"]).select("page_id", "rev_id", "page_title", "bytes")


# --- Reads -------------------------------------------------------------------------------

_PREFIX = "click"
_ASKED = [f"u{u:06d}-{i}" for u in (3, 1, 7, 40, 12, 999999) for i in (2, 0, 3, 1)]
_ASKED_SQL = f"{_L}, k AS (SELECT unnest({_ASKED}) AS key, unnest(range({len(_ASKED)})) AS pos), f AS (SELECT k.pos, k.key, l.value, l.ts_id, l.version, l.tombstoned FROM k LEFT JOIN l ON l.key = k.key AND l.prefix = '{_PREFIX}')"


@query(
    _ASKED_SQL
    + " SELECT cast(pos AS int) AS pos, key, CASE WHEN NOT tombstoned THEN value END AS value, CASE WHEN NOT tombstoned THEN ts_id ELSE -1 END AS ts_id, CASE WHEN NOT tombstoned THEN version ELSE -1 END AS version FROM f"
)
def multi_get(spark, sf_dir):
    return reads.multi_get(w(spark, sf_dir), _PREFIX, _ASKED)


@query(_ASKED_SQL + " SELECT cast(pos AS int) AS pos, key, value, ts_id, version, tombstoned FROM f")
def get_raw(spark, sf_dir):
    return reads.get_raw(w(spark, sf_dir), _PREFIX, _ASKED)


@query(_ASKED_SQL + " SELECT cast(pos AS int) AS pos, key, coalesce(NOT tombstoned, false) AS contained, coalesce(ts_id, -1) AS ts_id, coalesce(version, -1) AS version FROM f")
def contains_keys(spark, sf_dir):
    return reads.contains_keys(w(spark, sf_dir), _PREFIX, _ASKED)


@query("SELECT doc_id, CASE WHEN doc_id % 500 = 0 AND length(text) <= 40 THEN text WHEN doc_id % 500 < length(text) THEN substring(text, cast(doc_id % 500 AS int) + 1, 40) END AS slice FROM documents")
def value_slices(spark, sf_dir):
    """A slice of every text, from an offset that some texts don't reach."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", reads.value_slice(F.col("text"), F.col("doc_id") % 500, F.lit(40)).alias("slice"))


@query(_L + " SELECT prefix, key, value, ts_id, version FROM l WHERE NOT tombstoned")
def full_scan(spark, sf_dir):
    return reads.scan(resolve.lww(w(spark, sf_dir))).select("prefix", "key", "value", "ts_id", "version")


_RANGE = reads.KeyRange("click", "u000020", "purchase", "u000010")
_IN_RANGE = "(prefix > 'click' OR (prefix = 'click' AND key >= 'u000020')) AND (prefix < 'purchase' OR (prefix = 'purchase' AND key < 'u000010'))"


@query(_L + f" SELECT prefix, key, value, ts_id, version FROM l WHERE NOT tombstoned AND {_IN_RANGE}")
def range_scan(spark, sf_dir):
    return reads.range_scan(w(spark, sf_dir), _RANGE).select("prefix", "key", "value", "ts_id", "version")


@query(
    _L
    + f" SELECT cast(0 AS int) AS range_id, prefix, key, ts_id FROM l WHERE NOT tombstoned AND {_IN_RANGE} UNION ALL SELECT cast(1 AS int), prefix, key, ts_id FROM l WHERE NOT tombstoned AND (prefix > 'click' OR (prefix = 'click' AND key >= 'u000010')) AND (prefix < 'error' OR (prefix = 'error' AND key < 'u000030'))"
)
def multi_range_scan(spark, sf_dir):
    ranges = [_RANGE, reads.KeyRange("click", "u000010", "error", "u000030")]
    return reads.multi_range_scan(resolve.lww(w(spark, sf_dir)), ranges).select("range_id", "prefix", "key", "ts_id")


@query(_L + " SELECT prefix, key, ts_id, version FROM l WHERE NOT tombstoned")
def scan_keys(spark, sf_dir):
    return reads.scan(resolve.lww(w(spark, sf_dir)), hydrate=False).select("prefix", "key", "ts_id", "version")


@query(_L + """ SELECT prefix, key, value, ts_id FROM l WHERE NOT tombstoned AND value LIKE '%"k": 7%' AND key < 'u000100'""")
def scan_filtered(spark, sf_dir):
    keep = F.col("value").like('%"k": 7%') & (F.col("key") < "u000100")
    return reads.scan_filtered(resolve.lww(w(spark, sf_dir)), keep).select("prefix", "key", "value", "ts_id")


@query(_L + " SELECT prefix, key, ts_id FROM l WHERE NOT tombstoned AND prefix >= 'p' AND prefix < 'q'")
def prefix_scan(spark, sf_dir):
    """All prefixes that begin with p, by the bound above them."""
    bounds = reads.KeyRange("p", "", prefix_upper_text("p"), "")
    return reads.range_scan(w(spark, sf_dir), bounds).select("prefix", "key", "ts_id")


@query(_L + " SELECT count(*) AS n FROM l WHERE NOT tombstoned")
def exact_count(spark, sf_dir):
    return reads.exact_count(w(spark, sf_dir))


@query(_HALF + " SELECT cast((SELECT count(*) FROM la) + (SELECT count(*) FROM lb) AS bigint) AS n")
def approx_count(spark, sf_dir):
    return reads.approximate_count(*halves(spark, sf_dir))


@query(_L + " SELECT count(*) AS n FROM l WHERE NOT tombstoned")
def delta_count(spark, sf_dir):
    """Stored keys corrected by what the pending ones do comes to the exact count."""
    return reads.delta_count(*halves(spark, sf_dir))


@query(_L + " SELECT prefix, key, version FROM l WHERE version >= 15000")
def disposal_filter(spark, sf_dir):
    return reads.above_disposal(resolve.lww(w(spark, sf_dir)), 15000).select("prefix", "key", "version")


# --- Change feeds --------------------------------------------------------------------------


@query(_W + f" SELECT {_COLS} FROM w WHERE tx_id > 1000")
def take_since(spark, sf_dir):
    return _cols(changes.take_since(w(spark, sf_dir), 1000))


@query(_W + f" SELECT {_COLS} FROM w WHERE tx_id > 1000 AND prefix = 'click'")
def take_prefix_since(spark, sf_dir):
    return _cols(changes.take_prefix_since(w(spark, sf_dir), "click", 1000))


@query(_W + f" SELECT {_COLS} FROM w WHERE tx_id > 100 AND tx_id <= (SELECT max(tx_id) FROM (SELECT tx_id FROM w WHERE tx_id > 100 ORDER BY tx_id, seq LIMIT 10))")
def take_limit_tx_aligned(spark, sf_dir):
    """The limit is the feature: whole transactions until ten rows are there."""
    return _cols(changes.take_since(w(spark, sf_dir), 100, 10))


@query(
    """WITH r AS (SELECT partition_name, tx_id, delivery_id, row_number() OVER (PARTITION BY partition_name ORDER BY tx_id, delivery_id) AS i FROM feed_rows)
SELECT partition_name, tx_id, delivery_id FROM r JOIN (SELECT partition_name, max(tx_id) AS stop FROM r WHERE i <= 100 GROUP BY 1) s USING (partition_name) WHERE tx_id <= stop"""
)
def take_limit_each_partition(spark, sf_dir):
    """The same for every partition of the feed at once."""
    rows = table(spark, sf_dir, "feed_rows").select("partition_name", "tx_id", F.col("delivery_id").alias("seq"))
    return changes.take_each(rows, ["partition_name"], None, 100).select("partition_name", "tx_id", F.col("seq").alias("delivery_id"))


@query(_W + f" SELECT {_COLS} FROM w WHERE tx_id > 100 AND tx_id < coalesce((SELECT min(tx_id) FROM w WHERE tx_id > 100 AND key LIKE 'u000050%'), 9223372036854775807)")
def take_reject_stop(spark, sf_dir):
    return _cols(changes.take_until_rejected(w(spark, sf_dir), 100, F.col("key").like("u000050%")))


@query(_W + f" SELECT {_COLS} FROM w WHERE tx_id > 100 AND tx_id <= coalesce((SELECT min(tx_id) FROM w WHERE tx_id > 100 AND key LIKE 'u000050%'), 9223372036854775807)")
def take_accept_stop(spark, sf_dir):
    return _cols(changes.take_until_accepted(w(spark, sf_dir), 100, F.col("key").like("u000050%")))


@query(_W + " SELECT max(tx_id) AS last_tx, max(tx_id) = (SELECT max(tx_id) FROM w) AS to_end FROM w WHERE tx_id > 100 AND tx_id < 1250")
def took_to_end(spark, sf_dir):
    log = w(spark, sf_dir)
    return changes.took_to_end(log, changes.take_since(log, 100).where(F.col("tx_id") < 1250))


@query(_HALF + f" SELECT {_COLS} FROM (SELECT * FROM w WHERE tx_id <= (SELECT cut FROM h) {_TOP}) WHERE NOT tombstoned")
def snapshot_at_tx(spark, sf_dir):
    log = w(spark, sf_dir)
    cut = log.agg(F.call_function("div", F.max("tx_id"), F.lit(2))).scalar()
    return _cols(resolve.live(changes.snapshot_at(log, cut)))


@query(_W + f" SELECT {_COLS}, replica FROM w LEFT JOIN (VALUES (0, 500), (1, 1500)) c(r, done) ON replica = r WHERE tx_id > coalesce(done, -1)")
def cursor_resume(spark, sf_dir):
    cursors = spark.createDataFrame([(0, 500), (1, 1500)], "replica bigint, tx_id bigint")
    return changes.resume(w(spark, sf_dir), cursors).select("tx_id", "seq", "prefix", "key", "value", "ts_id", "tombstoned", "version", "replica")


@query(
    """WITH t AS (SELECT partition_name, partition_version, max(tx_id) AS highest FROM feed_rows GROUP BY 1, 2),
o AS (SELECT ring_member, partition_name, partition_version, max(highwater_tx_id) AS took FROM highwaters GROUP BY 1, 2, 3)
SELECT ring_member, partition_name, partition_version, took, highest FROM o JOIN t USING (partition_name, partition_version) WHERE highest > took"""
)
def available_rows(spark, sf_dir):
    marks = table(spark, sf_dir, "highwaters").withColumnRenamed("highwater_tx_id", "tx_id")
    return changes.available(table(spark, sf_dir, "feed_rows"), marks, ["partition_name", "partition_version"], "ring_member")


# --- Compaction ------------------------------------------------------------------------------

_CUT = retention.Cutoffs(tombstone_version=30000, ttl_version=10000, disposal_version=15000)
_FATES = (
    _W
    + """, t AS (SELECT *, max((ts_id, version)) OVER (PARTITION BY prefix, key) AS top FROM w),
c AS (SELECT *, CASE WHEN (ts_id, version) < top THEN 'clobber' WHEN tombstoned AND version < 30000 THEN 'tombstone' WHEN version < 10000 THEN 'ttl' WHEN version < 15000 THEN 'disposal' ELSE 'keep' END AS fate FROM t)"""
)


@query(_FATES + f" SELECT {_COLS} FROM c WHERE fate = 'keep'")
def compaction_survivors(spark, sf_dir):
    return _cols(retention.compact(w(spark, sf_dir), _CUT))


def _purged(fate: str):
    def run(spark, sf_dir):
        return retention.classify(w(spark, sf_dir), _CUT).where(F.col("fate") == fate).select("prefix", "key", "tx_id", "version")

    return run


for _fate in ("tombstone", "ttl", "disposal"):
    QUERIES[f"{_fate}_purge"] = _purged(_fate)
    SQL[f"{_fate}_purge"] = _FATES + f" SELECT prefix, key, tx_id, version FROM c WHERE fate = '{_fate}'"


@query(
    _FATES
    + """ SELECT count(*) FILTER (fate = 'clobber') AS clobbers, count(*) FILTER (fate = 'tombstone') AS tombstones, count(*) FILTER (fate = 'ttl') AS ttls, count(*) FILTER (fate = 'disposal') AS disposals, count(*) FILTER (fate = 'keep') AS keeps,
  min(ts_id) FILTER (fate = 'keep' AND NOT tombstoned) AS oldest_ts_id, min(version) FILTER (fate = 'keep' AND NOT tombstoned) AS oldest_version,
  min(ts_id) FILTER (fate = 'keep' AND tombstoned) AS oldest_tombstoned_ts_id, min(version) FILTER (fate = 'keep' AND tombstoned) AS oldest_tombstoned_version FROM c"""
)
def compaction_stats(spark, sf_dir):
    return retention.purge_stats(w(spark, sf_dir), _CUT).select(
        *[f"{f}s" for f in ("clobber", "tombstone", "ttl", "disposal", "keep")], "oldest_ts_id", "oldest_version", "oldest_tombstoned_ts_id", "oldest_tombstoned_version"
    )


@query(
    _FATES.replace("version < 30000", "version < 0").replace("version < 10000", "version < 0").replace("version < 15000", "version < 0")
    + """ SELECT count(*) FILTER (fate = 'clobber') AS clobbers, count(*) FILTER (fate = 'keep') AS held,
  coalesce(bool_or(fate = 'keep' AND ((tombstoned AND version < 20) OR (NOT tombstoned AND version < 10))), false) OR (count(*) FILTER (fate = 'clobber') + 1) // (count(*) FILTER (fate = 'keep') + 1) > 2 AS needed FROM c"""
)
def should_compact(spark, sf_dir):
    return retention.should_compact(w(spark, sf_dir), retention.Cutoffs(tombstone_version=20, ttl_version=10))


_NOW = 1_743_400_000_000


@query(
    f"""WITH f AS (SELECT *, coalesce(prefix, '') AS p FROM feed_rows),
t AS (SELECT *, max((value_timestamp, value_version)) OVER (PARTITION BY partition_name, p, row_key) AS top FROM f),
c AS (SELECT t.partition_name, CASE WHEN (value_timestamp, value_version) < top THEN 'clobber' WHEN value_tombstoned AND coalesce(tombstone_age_ms, 0) > 0 AND value_timestamp < {_NOW} - tombstone_age_ms THEN 'tombstone'
  WHEN coalesce(ttl_age_ms, 0) > 0 AND value_timestamp < {_NOW} - ttl_age_ms THEN 'ttl' WHEN coalesce(value_version < disposal_version, false) THEN 'disposal' ELSE 'keep' END AS fate
  FROM t LEFT JOIN partition_info USING (partition_name))
SELECT partition_name, fate, count(*) AS n FROM c GROUP BY ALL"""
)
def partition_fates(spark, sf_dir):
    """What compaction would do to every partition of the feed by its own properties."""
    rows = table(spark, sf_dir, "feed_rows").select(
        "partition_name", norm_prefix("prefix").alias("prefix"), F.col("row_key").alias("key"), F.col("value_timestamp").alias("ts_id"), F.col("value_version").alias("version"), F.col("value_tombstoned").alias("tombstoned")
    )
    told = retention.compact_partitions(rows, table(spark, sf_dir, "partition_info"), _NOW)
    return told.groupBy("partition_name", "fate").agg(F.count(F.lit(1)).alias("n"))


# --- Consistency ----------------------------------------------------------------------------


@query(
    """SELECT level, cast(n AS int) AS neighbours,
  cast(CASE level WHEN 'leader_plus_one' THEN CASE WHEN n > 0 THEN 1 END WHEN 'leader_quorum' THEN (n + 1) // 2 WHEN 'quorum' THEN (n + 1) // 2 WHEN 'leader_all' THEN n WHEN 'write_all_read_one' THEN n ELSE 0 END AS int) AS write_quorum,
  cast(CASE level WHEN 'leader' THEN NULL WHEN 'leader_plus_one' THEN n - 1 WHEN 'leader_quorum' THEN n // 2 WHEN 'quorum' THEN n // 2 WHEN 'write_one_read_all' THEN n ELSE 0 END AS int) AS repair_quorum
FROM (VALUES ('leader'), ('leader_plus_one'), ('leader_quorum'), ('leader_all'), ('quorum'), ('write_all_read_one'), ('write_one_read_all'), ('none')) v(level), range(9) r(n)"""
)
def quorum_table(spark, sf_dir):
    return consistency.quorum_table(spark)


@query(
    """WITH v AS (SELECT unnest(['leader', 'leader_plus_one', 'leader_quorum', 'leader_all', 'quorum', 'write_all_read_one', 'write_one_read_all', 'none']) AS level)
SELECT p.level AS partition_level, c.level, CASE WHEN p.level IN ('write_one_read_all', 'none') THEN true WHEN c.level IN ('leader_all', 'write_all_read_one') THEN true WHEN p.level = c.level THEN true
  WHEN p.level = 'leader' THEN c.level IN ('leader_plus_one', 'leader_quorum') WHEN p.level IN ('leader_plus_one', 'quorum') THEN c.level = 'leader_quorum' ELSE false END AS writes,
  CASE WHEN p.level IN ('leader_all', 'write_all_read_one', 'none') THEN true WHEN c.level IN ('write_one_read_all', 'none') THEN true WHEN p.level = c.level THEN true
  WHEN p.level IN ('leader_plus_one', 'leader_quorum') AND c.level = 'leader' THEN true WHEN p.level = 'leader_quorum' AND c.level = 'quorum' THEN true ELSE false END AS reads
FROM v p, v c"""
)
def consistency_matrix(spark, sf_dir):
    return consistency.support_matrix(spark)


@query(
    """WITH a AS (SELECT partition_name, partition_version, ring_member, max(highwater_tx_id) AS tx_id FROM highwaters GROUP BY ALL),
t AS (SELECT partition_name, partition_version, cast(quantile_disc(tx_id, 0.5) AS bigint) AS tx FROM a GROUP BY ALL)
SELECT partition_name, partition_version, count(*) FILTER (tx_id >= tx) AS acks, count(*) FILTER (tx_id >= tx) >= 2 AS committed FROM a JOIN t USING (partition_name, partition_version) GROUP BY ALL"""
)
def ack_quorum(spark, sf_dir):
    """Which partitions' median transaction two takers or more have acknowledged."""
    keys = ["partition_name", "partition_version"]
    acks = table(spark, sf_dir, "highwaters").groupBy("ring_member", *keys).agg(F.max("highwater_tx_id").alias("tx_id"))
    median = acks.groupBy(*keys).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY tx_id)").cast("bigint").alias("tx"))
    return consistency.acked(acks.join(median, keys), F.col("tx"), 2, keys)


@query(
    _W
    + f", q AS (SELECT * FROM w WHERE replica IN (0, 1) {_TOP}), k AS (SELECT unnest({_ASKED}) AS key, unnest(range({len(_ASKED)})) AS pos) SELECT cast(pos AS int) AS pos, k.key, CASE WHEN NOT tombstoned THEN value END AS value, CASE WHEN NOT tombstoned THEN ts_id ELSE -1 END AS ts_id, CASE WHEN NOT tombstoned THEN version ELSE -1 END AS version FROM k LEFT JOIN q ON q.key = k.key AND q.prefix = '{_PREFIX}'"
)
def quorum_get(spark, sf_dir):
    return consistency.quorum_get(w(spark, sf_dir), [0, 1], _PREFIX, _ASKED)


@query(_W + f", q AS (SELECT * FROM w WHERE replica IN (0, 1) {_TOP}) SELECT prefix, key, value, ts_id, version FROM q WHERE NOT tombstoned")
def quorum_scan(spark, sf_dir):
    return consistency.quorum_scan(w(spark, sf_dir), [0, 1]).select("prefix", "key", "value", "ts_id", "version")


@query(
    _W
    + f""", x AS (SELECT * FROM w WHERE replica = 0 {_TOP}), y AS (SELECT * FROM w WHERE replica = 1 {_TOP})
SELECT coalesce(x.prefix, y.prefix) AS prefix, coalesce(x.key, y.key) AS key, CASE WHEN x.key IS NULL THEN 'missing' WHEN y.key IS NULL THEN 'extra'
  WHEN x.value IS NOT DISTINCT FROM y.value AND x.ts_id = y.ts_id AND x.tombstoned = y.tombstoned AND x.version = y.version THEN 'same' ELSE 'differs' END AS outcome
FROM x FULL JOIN y ON x.prefix = y.prefix AND x.key = y.key"""
)
def replica_diff(spark, sf_dir):
    log = w(spark, sf_dir)
    return consistency.replica_diff(log.where("replica = 0"), log.where("replica = 1"))


@query(
    """WITH r AS (SELECT DISTINCT partition_name, ring_name FROM partition_info), s AS (SELECT ring_name, ring_member, row_number() OVER (PARTITION BY ring_name ORDER BY ring_member) AS place FROM ring_members),
t AS (SELECT partition_name, max(tx_id) AS top FROM feed_rows GROUP BY 1), h AS (SELECT partition_name, ring_member, max(highwater_tx_id) AS tx FROM highwaters GROUP BY 1, 2),
l AS (SELECT r.partition_name, s.place, cast((s.place - 1) // 2 + 1 AS int) AS category, t.top - h.tx AS lag FROM r JOIN s USING (ring_name) JOIN t USING (partition_name) LEFT JOIN h USING (partition_name, ring_member)),
f AS (SELECT *, coalesce(sum(CASE WHEN lag <= 0 OR lag < cast(2000000000 AS bigint) * category THEN 1 ELSE 0 END) OVER (PARTITION BY partition_name ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fast FROM l)
SELECT partition_name, coalesce(max(CASE WHEN fast < 2 THEN category END), 1) AS category FROM f GROUP BY 1"""
)
def slow_takers(spark, sf_dir):
    """How wide each partition must ask until two takers are fast enough."""
    seats = table(spark, sf_dir, "ring_members").withColumn("place", F.row_number().over(Window.partitionBy("ring_name").orderBy("ring_member")))
    parts = table(spark, sf_dir, "partition_info").select("partition_name", "ring_name").distinct()
    top = table(spark, sf_dir, "feed_rows").groupBy("partition_name").agg(F.max("tx_id").alias("top"))
    marks = table(spark, sf_dir, "highwaters").groupBy("partition_name", "ring_member").agg(F.max("highwater_tx_id").alias("tx"))
    lags = parts.join(seats, "ring_name").join(top, "partition_name").join(marks, ["partition_name", "ring_member"], "left")
    lags = lags.select("partition_name", "place", (F.expr("(place - 1) div 2 + 1")).cast("int").alias("category"), (F.col("top") - F.col("tx")).alias("lag"))
    return consistency.slow_category(lags, 2, 2_000_000_000)


@query("SELECT partition_name, level FROM partition_info, (SELECT unnest(['leader', 'quorum', 'write_one_read_all']) AS level) WHERE NOT require_consistency OR level = 'write_one_read_all' OR consistency IN ('leader_all', 'write_all_read_one', 'none') OR consistency = level OR (level = 'leader' AND consistency IN ('leader_plus_one', 'leader_quorum')) OR (level = 'quorum' AND consistency = 'leader_quorum')")
def readable_levels(spark, sf_dir):
    """Which of three levels each partition may be read at."""
    parts = table(spark, sf_dir, "partition_info")
    asks = parts.select("partition_name", F.explode(F.array(F.lit("leader"), F.lit("quorum"), F.lit("write_one_read_all"))).alias("level"))
    return consistency.supported(asks, parts, write=False)


# --- Catalog -----------------------------------------------------------------------------------


@query("SELECT ring_member, partition_name, partition_version, max(highwater_tx_id) AS highwater_tx_id FROM highwaters WHERE highwater_tx_id >= 0 GROUP BY ALL")
def highwater_max(spark, sf_dir):
    return catalog.highwater_max(table(spark, sf_dir, "highwaters"), ["ring_member", "partition_name", "partition_version"], "highwater_tx_id")


@query(
    """WITH h AS (SELECT n_name AS m, min(s_name) AS host FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)
SELECT r_name AS ring_name, n_name AS ring_member, coalesce(host, 'unknownRingHost') AS host FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN h ON m = n_name"""
)
def ring_lookup(spark, sf_dir):
    nation, region, supplier = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    rings = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("ring_name"), F.col("n_name").alias("ring_member"))
    nodes = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("ring_member")).agg(F.min("s_name").alias("host"))
    return catalog.ring_lookup(rings, nodes)


@query("SELECT ring_name, ring_member, coalesce(h, 'unknownRingHost') AS host FROM (SELECT DISTINCT ring_name, ring_member FROM ring_members) JOIN (SELECT ring_member, max(host) AS h FROM ring_members GROUP BY 1) USING (ring_member)")
def ring_members_hosts(spark, sf_dir):
    r = table(spark, sf_dir, "ring_members")
    return catalog.ring_lookup(r, r)


@query(
    "SELECT ring_name, ring_member, CASE WHEN host IS NULL OR port IS NULL THEN 'unknownRingHost' WHEN datacenter IS NULL OR rack IS NULL THEN host || ':' || port ELSE datacenter || ':' || rack || ':' || host || ':' || port END AS host_text FROM ring_members"
)
def ring_host_text(spark, sf_dir):
    r = table(spark, sf_dir, "ring_members")
    return r.select("ring_name", "ring_member", catalog.host_text(F.col("datacenter"), F.col("rack"), F.col("host"), F.col("port")).alias("host_text"))


@query("SELECT DISTINCT ring_name FROM ring_members WHERE ring_member = 'member-02'")
def member_rings(spark, sf_dir):
    return catalog.member_rings(table(spark, sf_dir, "ring_members"), "member-02")


@query("SELECT partition_name FROM partition_info WHERE is_system OR ring_name IN (SELECT ring_name FROM ring_members WHERE ring_member = 'member-03')")
def member_partitions(spark, sf_dir):
    return catalog.partitions_of_member(table(spark, sf_dir, "partition_info"), table(spark, sf_dir, "ring_members"), "member-03").select("partition_name")


@query(
    """WITH h AS (SELECT ring_member, max(host) AS h FROM ring_members GROUP BY 1), s AS (SELECT ring_name, string_agg(ring_member || '=' || coalesce(h, 'unknownRingHost'), ',' ORDER BY ring_member) AS members FROM (SELECT DISTINCT ring_name, ring_member FROM ring_members) JOIN h USING (ring_member) GROUP BY 1)
SELECT partition_name, p.ring_name, members, r.ring_member AS leader, disposal_version IS NOT NULL AS disposed FROM partition_info p LEFT JOIN s USING (ring_name)
LEFT JOIN (SELECT DISTINCT ring_name, ring_member FROM ring_members) r ON r.ring_name = p.ring_name AND r.ring_member = p.first_member"""
)
def partition_routes(spark, sf_dir):
    r = table(spark, sf_dir, "ring_members")
    parts = table(spark, sf_dir, "partition_info")
    told = catalog.route(parts, r, r, parts.select("partition_name", F.col("first_member").alias("leader")))
    return told.withColumn("members", F.array_join(F.transform("members", lambda m: F.concat(m["ring_member"], F.lit("="), m["host"])), ","))


@query("SELECT DISTINCT f.partition_name, f.partition_version FROM feed_rows f JOIN (SELECT partition_name, max(partition_version) AS v FROM feed_rows GROUP BY 1) m USING (partition_name) WHERE f.partition_version <> m.v")
def orphan_versions(spark, sf_dir):
    """Storage versions in the feed that are not their partition's last."""
    stored = table(spark, sf_dir, "feed_rows").select("partition_name", "partition_version").distinct()
    return catalog.orphans(stored, stored.groupBy("partition_name").agg(F.max("partition_version").alias("partition_version")))


# --- Sync -----------------------------------------------------------------------------------------


@query(_W + " SELECT tx_id, seq, prefix, key, ts_id + 5000 AS ts_id, version, tombstoned FROM w WHERE version > 20000 AND version < 80000")
def sync_window_shift(spark, sf_dir):
    return sync.window_shift(w(spark, sf_dir), from_version=20000, to_version=80000, shift_ms=5000).select("tx_id", "seq", "prefix", "key", "ts_id", "version", "tombstoned")


@query(_W + " SELECT replica, max(tx_id) AS tx_id, max(ts_id) AS max_ts_id, max(version) AS max_version FROM w GROUP BY 1")
def sync_cursor(spark, sf_dir):
    return sync.cursor(w(spark, sf_dir))


@query(
    _W
    + """, r AS (SELECT *, CASE WHEN prefix IS DISTINCT FROM lag(prefix) OVER (PARTITION BY replica ORDER BY tx_id, seq) OR lag(seq) OVER (PARTITION BY replica ORDER BY tx_id, seq) IS NULL THEN 1 ELSE 0 END AS b FROM w),
n AS (SELECT *, sum(b) OVER (PARTITION BY replica ORDER BY tx_id, seq) - 1 AS run FROM r)
SELECT replica, cast(run AS bigint) AS run, min(prefix) AS prefix, count(*) AS n, min(tx_id) AS first_tx, max(tx_id) AS last_tx FROM n GROUP BY 1, 2"""
)
def sync_prefix_batches(spark, sf_dir):
    return sync.prefix_batches(w(spark, sf_dir), ["replica"])


# --- Inspection -------------------------------------------------------------------------------------


@query(
    _W
    + """, r AS (SELECT *, CASE WHEN tombstoned IS DISTINCT FROM lag(tombstoned) OVER (PARTITION BY replica ORDER BY tx_id, seq) THEN 1 ELSE 0 END AS b FROM w),
n AS (SELECT *, sum(b) OVER (PARTITION BY replica ORDER BY tx_id, seq) - 1 AS run FROM r)
SELECT replica, cast(run AS bigint) AS run, bool_or(tombstoned) AS tombstoned, min(tx_id) AS start_tx, count(*) AS n, cast(sum(coalesce(strlen(value), 0)) AS bigint) AS bytes FROM n GROUP BY 1, 2"""
)
def log_runs(spark, sf_dir):
    return inspect.log_runs(w(spark, sf_dir), ["replica"], "tombstoned", F.coalesce(F.octet_length("value"), F.lit(0)))


@query("SELECT cast(CASE WHEN strlen(text) = 0 THEN 0 ELSE ceil(log2(strlen(text))) END AS int) AS power, count(*) AS n, cast(sum(strlen(text)) AS bigint) AS total FROM documents GROUP BY 1")
def size_histogram(spark, sf_dir):
    return inspect.size_histogram(table(spark, sf_dir, "documents"), F.octet_length("text"))


@query("SELECT partition_name, count(*) AS n, count(*) FILTER (value_tombstoned) AS tombstones, min(tx_id) AS first_tx, max(tx_id) AS last_tx FROM feed_rows GROUP BY 1")
def partition_totals(spark, sf_dir):
    return inspect.partition_totals(table(spark, sf_dir, "feed_rows").withColumnRenamed("value_tombstoned", "tombstoned"), ["partition_name"])


@query("SELECT partition_name, ring_name FROM partition_info WHERE contains(partition_name, 'audit')")
def partitions_by_name(spark, sf_dir):
    return inspect.by_name(table(spark, sf_dir, "partition_info"), "partition_name", "audit").select("partition_name", "ring_name")


@query(
    _HALF
    + f""", x AS (SELECT prefix, key, value FROM (SELECT * FROM w {_TOP}) WHERE NOT tombstoned), y AS (SELECT prefix, key, value FROM la WHERE NOT tombstoned)
SELECT * FROM (SELECT coalesce(x.prefix, y.prefix) AS prefix, coalesce(x.key, y.key) AS key, CASE WHEN x.key IS NULL THEN 'missing' WHEN y.key IS NULL THEN 'extra' WHEN x.value IS DISTINCT FROM y.value THEN 'differs' END AS outcome
FROM x FULL JOIN y ON x.prefix = y.prefix AND x.key = y.key) WHERE outcome IS NOT NULL"""
)
def snapshot_verify(spark, sf_dir):
    """The state now against the one half way, as if that were what is expected."""
    now = resolve.live(resolve.lww(w(spark, sf_dir)))
    then = resolve.live(resolve.lww(halves(spark, sf_dir)[0]))
    return inspect.snapshot_verify(now, then, ["prefix", "key"], "value")
