"""Queries over logs that the engine writes itself: commits, merges, compaction, replicas, streams, the catalog.

The feed's rows are written through the log store (key: partition and row key), read back, and held
against SQL over the feed alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.client import Engine, StringMap, puts
from feedloom.functions.keys import norm_prefix
from feedloom.operators import catalog, changes, consistency, inspect, reads, resolve, retention, sync
from feedloom.operators.prefix_scan import prefix_scan
from feedloom.schema import LOG
from feedloom.sources import shared
from feedloom.sources.generate import random_log
from feedloom.sources.log_store import LogStore, OverCapacity
from feedloom.sources.sync_configs import SyncConfigs
from feedloom.sources.tables import table
from feedloom.streaming import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: The clock that rows without a timestamp get.
CLOCK = 1_743_400_000_000


def flog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole feed as one text log; prefixes are absent or empty as they were delivered."""
    return table(spark, sf_dir, "feed_rows").select(
        "tx_id", F.col("delivery_id").alias("seq"), "prefix", F.concat_ws("/", "partition_name", "row_key").alias("key"), F.col("row_value").alias("value"),
        F.col("value_timestamp").alias("ts_id"), F.coalesce("value_tombstoned", F.lit(False)).alias("tombstoned"), F.col("value_version").alias("version"),
    )


def halves(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first and the second half of the deliveries."""
    cut = log.agg(F.min("seq") + F.call_function("div", F.max("seq") - F.min("seq") + 2, F.lit(2).cast("bigint"))).scalar()
    return log.where(F.col("seq") < cut), log.where(F.col("seq") >= cut)


def binary(log: DataFrame) -> DataFrame:
    """The same in the store's own types."""
    return log.select(*[F.col(c).cast("binary").alias(c) if c in ("prefix", "key", "value") else F.col(c) for c in log.columns], F.lit("primary").alias("row_type"))


def text(rows: DataFrame, *columns: str) -> DataFrame:
    """Binary columns as text, the absent prefix as ''."""
    told = {"prefix": norm_prefix(F.decode("prefix", "UTF-8")), "key": F.decode("key", "UTF-8"), "value": F.decode("value", "UTF-8")}
    return rows.select(*[told.get(c, F.col(c)).alias(c) for c in columns])


_F = f"""WITH f AS (SELECT tx_id, delivery_id AS seq, coalesce(prefix, '') AS prefix, partition_name || '/' || row_key AS key, row_value AS value, value_timestamp AS ts_id,
  CASE WHEN value_timestamp > 0 THEN value_timestamp ELSE {CLOCK} END AS clocked, coalesce(value_tombstoned, false) AS tombstoned, value_version AS version,
  delivery_id >= lo + (hi - lo + 2) // 2 AS later FROM feed_rows, (SELECT min(delivery_id) AS lo, max(delivery_id) AS hi FROM feed_rows))"""
_LWW = "QUALIFY row_number() OVER (PARTITION BY prefix, key ORDER BY ts_id DESC, version DESC, tx_id, seq DESC) = 1"
_PUT = "QUALIFY row_number() OVER (PARTITION BY prefix, key ORDER BY clocked DESC, seq DESC) = 1"
_TWO = f"{_F}, a AS (SELECT * FROM f WHERE NOT later {_PUT}), b AS (SELECT * FROM f WHERE later {_PUT})"


# --- Reads of a log with absent and with empty prefixes --------------------------------------


@query(
    _F
    + f""", l AS (SELECT * FROM f WHERE prefix = '' {_LWW}), k AS (SELECT key, min(seq) AS pos FROM f GROUP BY 1), x AS (SELECT k.pos, k.key, pos % 4 AS o, pos % 9 AS n, l.value, l.ts_id, l.version FROM k LEFT JOIN l ON l.key = k.key AND NOT l.tombstoned)
SELECT pos, key, CASE WHEN o = 0 AND n >= length(value) THEN value WHEN o < length(value) THEN substring(value, cast(o AS int) + 1, cast(n AS int)) END AS slice, coalesce(ts_id, -1) AS ts_id, coalesce(version, -1) AS version FROM x"""
)
def get_offset(spark, sf_dir):
    """A slice of the value of every key there is, asked without a prefix: whole values, parts, and offsets beyond the end."""
    log = flog(spark, sf_dir)
    asks = log.groupBy("key").agg(F.min("seq").alias("pos")).select("pos", "key", (F.col("pos") % 4).alias("offset"), (F.col("pos") % 9).alias("length"))
    return reads.get_offset(log, None, asks)


@query(_F + f", l AS (SELECT * FROM f {_LWW}) SELECT value, ts_id, version FROM l WHERE prefix = '' AND NOT tombstoned AND key = (SELECT min(key) FROM l WHERE prefix = '' AND NOT tombstoned)")
def timestamped_get(spark, sf_dir):
    """One key's value with its timestamp: the first key that has no prefix."""
    log = flog(spark, sf_dir)
    return reads.timestamped_get(log, None, resolve.live(resolve.lww(log)).where("coalesce(prefix, '') = ''").agg(F.min("key")).first()[0])


@query(_F + f" SELECT count(*) AS n FROM (SELECT * FROM f {_LWW}) WHERE NOT tombstoned")
def feed_delta_count(spark, sf_dir):
    """Stored keys corrected by what pending ones do, where a prefix is absent in one and empty in the other."""
    return reads.delta_count(*halves(flog(spark, sf_dir)))


@query(_F + " SELECT tx_id, seq, key, ts_id FROM f WHERE prefix = '' AND tx_id > (SELECT median(tx_id) FROM f)")
def feed_take_prefix(spark, sf_dir):
    """The later half of the feed's rows without a prefix, however that is spelled."""
    log = flog(spark, sf_dir)
    since = log.agg(F.median("tx_id").cast("bigint")).first()[0]
    return changes.take_prefix_since(log, "", since).select("tx_id", "seq", "key", "ts_id")


@query(
    _F
    + f""", l AS (SELECT * FROM f {_LWW}), r AS (SELECT cast(0 AS int) AS range_id, * FROM l WHERE NOT tombstoned AND (prefix < 'm') UNION ALL SELECT cast(1 AS int), * FROM l WHERE NOT tombstoned AND prefix = '' AND key >= 'b')
SELECT range_id, prefix, key, ts_id, row_number() OVER (ORDER BY range_id, prefix, key) AS place FROM r"""
)
def feed_multi_range(spark, sf_dir):
    """Two ranges that overlap in the rows without prefix, numbered in the order they come."""
    ranges = [reads.KeyRange("", "", "m", ""), reads.KeyRange("", "b", "\x00", "")]
    told = reads.multi_range_scan(resolve.lww(flog(spark, sf_dir)), ranges)
    numbered = shared.materialize(told.select("range_id", norm_prefix("prefix").alias("prefix"), "key", "ts_id", F.monotonically_increasing_id().alias("at")), "ranges")
    placed = prefix_scan(numbered, [], ["at"], {"before": (F.lit(1).cast("bigint"), "sum")})
    return placed.select("range_id", "prefix", "key", "ts_id", (F.coalesce("before", F.lit(0)) + 1).alias("place"))


@query(_F + f" SELECT prefix, key, ts_id, version, tombstoned FROM f {_LWW}")
def two_delta_overlay(spark, sf_dir):
    """Stored rows under an older and a newer set of pending ones."""
    log = flog(spark, sf_dir)
    parts = [log.where(F.col("seq") % 3 == i) for i in range(3)]
    return resolve.merge_indexes(parts).select(norm_prefix("prefix").alias("prefix"), "key", "ts_id", "version", "tombstoned")


@query(
    _F
    + f""", a AS (SELECT * FROM f WHERE NOT later {_LWW}), b AS (SELECT * FROM f WHERE later {_LWW})
SELECT b.prefix, b.key, b.ts_id, CASE WHEN a.key IS NULL THEN 'apply' WHEN b.tombstoned AND NOT a.tombstoned THEN 'remove' ELSE 'clobber' END AS change, a.ts_id AS old_ts_id FROM b LEFT JOIN a ON a.prefix = b.prefix AND a.key = b.key"""
)
def forced_changes(spark, sf_dir):
    """Updates applied whether newer or not."""
    a, b = halves(flog(spark, sf_dir))
    return resolve.commit_changes(a, b, force=True).select(norm_prefix("prefix").alias("prefix"), "key", "ts_id", "change", "old_ts_id")


_MARKED = "SELECT -1 - row_number() OVER () AS tx_id, ring_member AS member, highwater_tx_id AS mark FROM highwaters"


def _with_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed with the takers' marks among its rows, as a log holds them."""
    marks = table(spark, sf_dir, "highwaters").select(
        F.coalesce("highwater_tx_id", F.lit(-1)).alias("tx_id"), F.monotonically_increasing_id().alias("seq"), F.lit(None).cast("binary").alias("prefix"), F.col("ring_member").cast("binary").alias("key"),
        F.col("highwater_tx_id").cast("string").cast("binary").alias("value"), F.lit(1).cast("bigint").alias("ts_id"), F.lit(False).alias("tombstoned"), F.lit(1).cast("bigint").alias("version"), F.lit("highwater").alias("row_type"),
    )
    return binary(flog(spark, sf_dir)).unionByName(marks)


@query(_F + " SELECT tx_id, seq, prefix, key, ts_id FROM f")
def take_all(spark, sf_dir):
    """Every row of a log that holds marks too."""
    return text(changes.data_rows(_with_marks(spark, sf_dir)), "tx_id", "seq", "prefix", "key", "ts_id")


@query("SELECT ring_member AS member, highwater_tx_id AS mark, count(*) AS n FROM highwaters GROUP BY ALL")
def feed_highwaters(spark, sf_dir):
    """The marks interleaved in a feed."""
    return changes.marks(_with_marks(spark, sf_dir)).groupBy("member", "mark").agg(F.count(F.lit(1)).alias("n"))


# --- A log as the store writes it ---------------------------------------------------------------


def _committed(spark: SparkSession, sf_dir: str, **how) -> tuple[LogStore, DataFrame]:
    """A store with the feed committed in two batches, and the change feed of the second."""
    store = LogStore(spark, shared.scratch(spark, "log"), **how)
    first, second = [binary(h) for h in halves(flog(spark, sf_dir))]
    store.commit(first, now_ms=CLOCK)
    return store, store.commit(second, now_ms=CLOCK)


@query(_F + f" SELECT prefix, key, value, clocked AS ts_id, tombstoned FROM f {_PUT}")
def store_state(spark, sf_dir):
    """What stands after two commits, timestamps given where there were none."""
    return text(_committed(spark, sf_dir)[0].state(), "prefix", "key", "value", "ts_id", "tombstoned")


@query(
    _TWO
    + """ SELECT b.prefix, b.key, b.clocked AS ts_id, CASE WHEN a.key IS NULL THEN 'apply' WHEN b.tombstoned AND NOT a.tombstoned THEN 'remove' ELSE 'clobber' END AS change, a.clocked AS old_ts_id
FROM b LEFT JOIN a ON a.prefix = b.prefix AND a.key = b.key WHERE a.key IS NULL OR b.clocked >= a.clocked"""
)
def store_changes(spark, sf_dir):
    """What the second commit tells whoever watches."""
    return text(_committed(spark, sf_dir)[1], "prefix", "key", "ts_id", "change", "old_ts_id")


_OLD = CLOCK - 86_400_000 * 20


@query(_F + f", s AS (SELECT * FROM f {_PUT}) SELECT prefix, key, clocked AS ts_id, tombstoned, 'snappy_primary' AS row_type FROM s WHERE NOT (tombstoned AND clocked < {CLOCK}) AND clocked >= {_OLD}")
def store_compacted(spark, sf_dir):
    """Merged, then compacted to another row type without its deleted and its oldest rows."""
    store, _ = _committed(spark, sf_dir)
    store.merge()
    store.compact(retention.Cutoffs(tombstone_ts=CLOCK, ttl_ts=_OLD), "snappy_primary")
    return text(store.rows(), "prefix", "key", "ts_id", "tombstoned", "row_type")


@query(
    _TWO
    + f""", s AS (SELECT * FROM a UNION ALL SELECT b.* FROM b LEFT JOIN a ON a.prefix = b.prefix AND a.key = b.key WHERE a.key IS NULL OR b.clocked >= a.clocked),
w AS (SELECT *, clocked = max(clocked) OVER k AND (later OR NOT bool_or(later) OVER k) AS stands FROM s WINDOW k AS (PARTITION BY prefix, key)),
g AS (SELECT CASE WHEN NOT stands THEN 'clobber' WHEN tombstoned AND clocked < {CLOCK} THEN 'tombstone' WHEN clocked < {_OLD} THEN 'ttl' ELSE 'keep' END AS fate, * FROM w)
SELECT count(*) FILTER (fate = 'clobber') AS clobbers, count(*) FILTER (fate = 'tombstone') AS tombstones, count(*) FILTER (fate = 'ttl') AS ttls, count(*) FILTER (fate = 'disposal') AS disposals,
  count(*) FILTER (fate = 'keep') AS keeps, min(clocked) FILTER (fate = 'keep' AND NOT tombstoned) AS oldest_ts_id, true AS measured, (SELECT count(*) FROM s) AS pending FROM g"""
)
def store_compaction(spark, sf_dir):
    """What a compaction of pending rows counts, whether bytes before and after are told, and what was pending."""
    store, _ = _committed(spark, sf_dir)
    pending = store.manifest()["pending"]
    told = store.compact(retention.Cutoffs(tombstone_ts=CLOCK, ttl_ts=_OLD))
    row = [told[f"{f}s"] for f in ("clobber", "tombstone", "ttl", "disposal", "keep")] + [told["oldest_ts_id"], min(told["bytes_before"], told["bytes_after"]) > 0, pending]
    return spark.createDataFrame([tuple(row)], "clobbers bigint, tombstones bigint, ttls bigint, disposals bigint, keeps bigint, oldest_ts_id bigint, measured boolean, pending bigint")


def _appended(spark: SparkSession, sf_dir: str, merge: bool) -> LogStore:
    """A store with the feed's rows under their own transactions; the first half merged into the base if asked or if that is due."""
    store = LogStore(spark, shared.scratch(spark, "log"))
    for part in halves(flog(spark, sf_dir)):
        if store.mergeable():
            store.merge()
        store.append(binary(part))
        if merge and not store.manifest()["base"]:
            store.merge()
    return store


@query(_F + f", s AS (SELECT * FROM (SELECT * FROM f WHERE NOT later {_LWW}) UNION ALL SELECT * FROM f WHERE later) SELECT tx_id, seq, prefix, key, ts_id FROM s WHERE tx_id > (SELECT median(tx_id) FROM f)")
def store_take(spark, sf_dir):
    """Rows beyond a transaction out of a log whose first half is merged: only the folders that can hold them are read."""
    since = flog(spark, sf_dir).agg(F.median("tx_id").cast("bigint")).first()[0]
    return text(changes.take_since(_appended(spark, sf_dir, True).rows(since), since), "tx_id", "seq", "prefix", "key", "ts_id")


@query(_F + f" SELECT prefix, key, ts_id, version FROM f WHERE NOT later {_LWW}")
def store_repair(spark, sf_dir):
    """The state that is left when the second batch's files are lost and the log is repaired."""
    store = _appended(spark, sf_dir, False)
    shared.remove(spark, f"{store.root}/{store.manifest()['commits'][-1]['path']}")
    if len(store.validate()) != 1 or store.repair() != 1:
        raise RuntimeError("one commit was lost")
    return text(store.state(), "prefix", "key", "ts_id", "version")


@query(_F + ", n AS (SELECT count(*) FILTER (NOT later) AS first, count(*) AS every FROM f) SELECT first AS pending, true AS mergeable, true AS refused, cast(0 AS bigint) AS pending_after, true AS accepted FROM n")
def store_capacity(spark, sf_dir):
    """A log that is due for a merge, refuses more at twice that, and goes on once it is merged."""
    store = LogStore(spark, shared.scratch(spark, "log"))
    first, second = [binary(h) for h in halves(flog(spark, sf_dir))]
    store.append(first)
    store.merge_after = store.manifest()["pending"] // 2
    told = [store.manifest()["pending"], store.mergeable()]
    try:
        store.append(second)
        told.append(False)
    except OverCapacity:
        told.append(True)
    store.merge()
    told += [store.manifest()["pending"], store.append(second) > 0]
    return spark.createDataFrame([tuple(told)], "pending bigint, mergeable boolean, refused boolean, pending_after bigint, accepted boolean")


# --- Members and streams -----------------------------------------------------------------------------


def _members(spark: SparkSession, sf_dir: str):
    """Three members of a partition; one of them is away when the second half is written."""
    engine = Engine(spark, shared.scratch(spark, "engine"))
    engine.create("feed", consistency="leader_quorum", require_consistency=True)
    held = engine.replicas("feed", ["m1", "m2", "m3"], "m1")
    first, second = [binary(h).drop("row_type").withColumn("ts_id", F.when(F.col("ts_id") > 0, F.col("ts_id")).otherwise(F.lit(CLOCK))) for h in halves(flog(spark, sf_dir))]
    held.commit("leader_all", None, first)
    held.down.add("m3")
    held.commit("leader_quorum", None, second)
    return held


@query(_F + f", s AS (SELECT * FROM f {_PUT}) SELECT prefix, key, value, clocked AS ts_id FROM s WHERE NOT tombstoned")
def replicas_scan(spark, sf_dir):
    """A read by quorum after the leader is gone: one that missed half the writes and one that has them all."""
    held = _members(spark, sf_dir)
    held.down = {"m1"}
    return text(held.scan("leader_quorum"), "prefix", "key", "value", "ts_id")


@query(_F + f", a AS (SELECT * FROM f WHERE NOT later {_PUT}) SELECT prefix, key, clocked AS ts_id, 'm3' AS member, true AS to_end FROM a")
def replicas_take(spark, sf_dir):
    """What the member that was away has to give, from the start."""
    held = _members(spark, sf_dir)
    held.down = {"m1", "m2"}
    take = held.take(["m1", "m3"], {"m1": 7})
    return text(take.rows, "prefix", "key", "ts_id").withColumns({"member": F.lit(take.member), "to_end": F.lit(take.highwaters is not None)})


def _source(spark: SparkSession, sf_dir: str) -> str:
    """The feed as a folder of log files, in two steps."""
    path = shared.scratch(spark, "source")
    for part in halves(flog(spark, sf_dir)):
        binary(part).select(*LOG.names).coalesce(1).write.mode("append").parquet(path)
    return path


@query(_F + f", l AS (SELECT * FROM f {_LWW}) SELECT prefix, key, ts_id, version, (SELECT max(tx_id) FROM f) AS highwater FROM l")
def replicated_state(spark, sf_dir):
    """The state of a replica that took the feed as a stream, and how far it has acknowledged."""
    store = LogStore(spark, shared.scratch(spark, "replica"))
    stream = feeds.log_stream(spark, _source(spark, sf_dir), max_files=1)
    feeds.replicate(stream, store, shared.scratch(spark, "checkpoint"), "m1", resolve=True).awaitTermination()
    return text(store.state(), "prefix", "key", "ts_id", "version").withColumn("highwater", F.lit(store.highwater("m1")).cast("bigint"))


@query(_F + " SELECT prefix, count(*) AS n FROM f GROUP BY 1")
def watched_rows(spark, sf_dir):
    """Rows per prefix as a watcher is told them, batch by batch."""
    out = shared.scratch(spark, "watched")
    stream = feeds.log_stream(spark, _source(spark, sf_dir), max_files=1)
    told = lambda rows, n: text(rows, "prefix").groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/{n}")
    feeds.watch(stream, told, shared.scratch(spark, "checkpoint")).awaitTermination()
    rows = spark.read.parquet(*[f"{out}/{n}" for n in shared.names(spark, out)])
    return rows.groupBy("prefix").agg(F.sum("n").alias("n"))


_SYNC_FROM = 1_700_000_000_000


def _synced(spark: SparkSession, sf_dir: str) -> tuple[LogStore, DataFrame]:
    store, cursors = LogStore(spark, shared.scratch(spark, "target")), shared.scratch(spark, "cursors")
    source = shared.scratch(spark, "source")
    binary(flog(spark, sf_dir)).select(*LOG.names).coalesce(1).write.parquet(source)
    stream = feeds.log_stream(spark, source).withColumn("replica", F.lit("m1"))
    feeds.sync(stream, store, cursors, shared.scratch(spark, "checkpoint"), from_ts=_SYNC_FROM, shift_ms=5000).awaitTermination()
    return store, feeds.read_cursors(spark, cursors, from_member="m1", to_member="m2")


@query(_F + f", s AS (SELECT * FROM f WHERE ts_id > {_SYNC_FROM} {_PUT}) SELECT prefix, key, value, ts_id + 5000 AS ts_id, tombstoned FROM s")
def synced_state(spark, sf_dir):
    """What a sync with a window and a time shift leaves at its target."""
    return text(_synced(spark, sf_dir)[0].state(), "prefix", "key", "value", "ts_id", "tombstoned")


@query("SELECT 'm1' AS replica, max(tx_id) AS tx_id, max(value_timestamp) AS max_ts_id, max(value_version) AS max_version FROM feed_rows")
def synced_cursor(spark, sf_dir):
    """How far that sync is, whatever its window left out."""
    return _synced(spark, sf_dir)[1]


@query("SELECT partition_name, true AS assigned FROM partition_info")
def sync_stripes(spark, sf_dir):
    """Every partition belongs to one of eight stripes, the same on every call."""
    stripe = lambda: sync.stripe_of(F.col("partition_name"), 8)
    return table(spark, sf_dir, "partition_info").select("partition_name", (stripe().between(0, 7) & (stripe() == stripe())).alias("assigned"))


@query("SELECT 'here' AS sender, partition_name AS source, ring_name AS target, coalesce(ttl_age_ms, 0) AS from_ts FROM partition_info WHERE NOT is_system")
def sync_settings(spark, sf_dir):
    """Settings of what is synced where, kept and listed; one setting is removed again."""
    configs = SyncConfigs(spark, shared.scratch(spark, "configs"))
    parts = table(spark, sf_dir, "partition_info").where("NOT is_system").select("partition_name", "ring_name", F.coalesce("ttl_age_ms", F.lit(0))).collect()  # the catalog
    for name, ring, ttl in [*parts, ("gone", "gone", 1)]:
        configs.put("here", name, ring, from_ts=ttl)
    configs.remove("here", "gone", "gone")
    return spark.createDataFrame([("here", s, t, c["from_ts"]) for (s, t), c in configs.all("here").items()], "sender string, source string, target string, from_ts bigint")


# --- The catalog -----------------------------------------------------------------------------------------


@query("SELECT partition_name, row_type, cast(tombstone_age_ms AS bigint) AS tombstone_age_ms, cast(CASE WHEN is_system THEN 2 ELSE 1 END AS bigint) AS partition_version, is_system AS disposed FROM partition_info")
def engine_catalog(spark, sf_dir):
    """The partitions of an engine: created from their properties, the system's abandoned once and marked for disposal."""
    engine = Engine(spark, shared.scratch(spark, "engine"))
    told = {r.partition_name: r for r in table(spark, sf_dir, "partition_info").collect()}  # the catalog
    for name, r in told.items():
        engine.create(name, ring_name=r.ring_name, is_system=r.is_system, row_type=r.row_type, tombstone_age_ms=r.tombstone_age_ms or 0)
        if r.is_system:
            engine.abandon_version(name)
            engine.mark_for_disposal(name)
    rows = [(n, p["row_type"], p["tombstone_age_ms"], p["partition_version"], p["disposal_version"] is not None) for n in engine.names() for p in [engine.properties(n)]]
    return spark.createDataFrame(rows, "partition_name string, row_type string, tombstone_age_ms bigint, partition_version bigint, disposed boolean")


@query(
    """SELECT partition_name, CASE WHEN require_consistency THEN 7 ELSE ttl_age_ms END AS ttl_age_ms, CASE WHEN partition_name = (SELECT min(partition_name) FROM partition_info) THEN greatest(coalesce(disposal_version, 99), 99) ELSE disposal_version END AS disposal_version
FROM partition_info"""
)
def properties_upsert(spark, sf_dir):
    """The catalog after changes, newer and older than what it has, and a disposal."""
    known = table(spark, sf_dir, "partition_info").select("partition_name", "ttl_age_ms", "disposal_version", "require_consistency").withColumns({"ts_id": F.lit(5), "version": F.lit(1)})
    newer = known.where("require_consistency").withColumns({"ttl_age_ms": F.lit(7).cast("bigint"), "ts_id": F.lit(6)})
    older = known.withColumns({"ttl_age_ms": F.lit(8).cast("bigint"), "ts_id": F.lit(4)})
    first = known.agg(F.min("partition_name")).first()[0]
    return catalog.mark_for_disposal(catalog.upsert_properties(known, newer.unionByName(older)), first, 99).select("partition_name", "ttl_age_ms", "disposal_version")


_RINGS_SQL = "WITH r AS (SELECT DISTINCT ring_name, ring_member FROM ring_members), n AS (SELECT *, row_number() OVER (PARTITION BY ring_name ORDER BY ring_member) AS i, count(*) OVER (PARTITION BY ring_name) AS size FROM r)"


def _rings(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    """Members per ring, in order: the catalog's, a few each."""
    rows = table(spark, sf_dir, "ring_members").groupBy("ring_name").agg(F.sort_array(F.collect_set("ring_member")).alias("m"))
    return {r.ring_name: list(r.m) for r in rows.collect()}


@query(_RINGS_SQL + " SELECT ring_name, cast(CASE WHEN i = 2 THEN 1 WHEN i = 1 THEN 2 ELSE i END AS int) AS place, ring_member FROM n WHERE size > 1")
def ring_order(spark, sf_dir):
    """The order in which a ring's members are asked, its second member being the leader."""
    rows = [(r, i + 1, m) for r, members in _rings(spark, sf_dir).items() if len(members) > 1 for i, m in enumerate(consistency.ordered_ring(members, members[1]))]
    return spark.createDataFrame(rows, "ring_name string, place int, ring_member string")


@query(
    _RINGS_SQL
    + """, v AS (SELECT unnest(['leader', 'leader_plus_one', 'leader_quorum', 'leader_all', 'quorum', 'write_all_read_one', 'write_one_read_all', 'none']) AS level)
SELECT DISTINCT ring_name, level, cast(CASE WHEN level = 'quorum' THEN size // 2 + 1 WHEN level = 'write_one_read_all' THEN size ELSE 1 END AS int) AS asked,
  cast(CASE level WHEN 'leader_plus_one' THEN size - 1 WHEN 'leader_quorum' THEN least(size - 1, (size - 1) // 2 + 1) WHEN 'leader_all' THEN least(size - 1, 1) WHEN 'quorum' THEN size // 2 + 1 WHEN 'write_one_read_all' THEN size WHEN 'leader' THEN NULL ELSE 1 END AS int) AS asked_without_leader FROM n, v"""
)
def read_members(spark, sf_dir):
    """How many members of each ring answer a read at each level, with the leader and when it is away."""
    rows = []
    for ring, members in _rings(spark, sf_dir).items():
        for level in consistency.LEVELS:
            away = None if level == "leader" else len(consistency.read_replicas(level, members, members[0], failover=level.startswith("leader"), seed=1))
            rows.append((ring, level, len(consistency.read_replicas(level, members, members[0], seed=1)), away))
    return spark.createDataFrame(rows, "ring_name string, level string, asked int, asked_without_leader int")


@query(
    _RINGS_SQL
    + """, o AS (SELECT unnest([1,2,2,3,3,3,4,4,4,4,5,5,5,5,5,6,6,6,6,6,6,7,7,7,7,7,7,7]) AS others, unnest([1,1,2,1,2,3,1,2,4,3,1,2,4,3,5,1,2,4,3,6,5,1,2,4,3,6,5,7]) AS distance, unnest([1,1,2,1,2,3,1,2,3,4,1,2,3,4,5,1,2,3,4,5,6,1,2,3,4,5,6,7]) AS place)
SELECT a.ring_name, a.ring_member AS root, b.ring_member, cast(1 + (place - 1) // greatest(a.size // 2, 1) AS int) AS category FROM n a JOIN o ON o.others = a.size - 1 JOIN n b ON b.ring_name = a.ring_name AND b.i = (a.i - 1 + distance) % a.size + 1"""
)
def ring_categories(spark, sf_dir):
    """The category in which every member asks every other one of its ring.  The SQL lists the order of asking by ring size."""
    rows = [(r, root, m, c) for r, members in _rings(spark, sf_dir).items() for root in members for m, c in consistency.take_categories(members, root)]
    return spark.createDataFrame(rows, "ring_name string, root string, ring_member string, category int")


@query(
    """WITH m AS (SELECT ring_member, coalesce(max(rack), '') AS rack FROM ring_members GROUP BY 1), i AS (SELECT *, row_number() OVER (PARTITION BY rack ORDER BY ring_member) AS turn FROM m)
SELECT rack, count(*) AS members FROM (SELECT * FROM i ORDER BY turn, rack LIMIT (SELECT (count(*) + 1) // 2 FROM m)) GROUP BY 1"""
)
def built_ring(spark, sf_dir):
    """How a ring of half the members there are spreads over their racks."""
    known = table(spark, sf_dir, "ring_members").groupBy("ring_member").agg(F.max("rack").alias("rack")).collect()  # the catalog
    ring = catalog.build_ring("a ring", [(r.ring_member, r.rack) for r in known], (len(known) + 1) // 2)
    racks = {r.ring_member: r.rack or "" for r in known}
    return spark.createDataFrame([(m, racks[m]) for m in ring], "m string, rack string").groupBy("rack").agg(F.count(F.lit(1)).alias("members"))


@query(
    """WITH s AS (SELECT partition_name, ring_member AS member, coalesce(lower(trim(outcome)), 'none') AS state, take_id AS ts_id FROM row_takes),
l AS (SELECT partition_name, member, max((ts_id, state)) AS top FROM s GROUP BY 1, 2), n AS (SELECT partition_name, member, top[2] AS state FROM l)
SELECT *, count(*) OVER (PARTITION BY partition_name, state) > count(*) OVER (PARTITION BY partition_name) / 2 AS at_quorum FROM n"""
)
def member_states(spark, sf_dir):
    """The last outcome of every member's takes of a partition, and whether more than half of the members share it."""
    rows = table(spark, sf_dir, "row_takes")
    states = rows.select("partition_name", F.col("ring_member").alias("member"), F.coalesce(F.lower(F.trim("outcome")), F.lit("none")).alias("state"), F.col("take_id").alias("ts_id"))
    return consistency.member_state(states)


@query("SELECT max(n) AS n FROM (SELECT ring_member, count(DISTINCT (partition_name, coalesce(prefix, ''), row_key)) AS n FROM member_rows GROUP BY 1)")
def replica_counts(spark, sf_dir):
    """The approximate count over replicas: the largest of the members' key counts."""
    rows = table(spark, sf_dir, "member_rows").select("ring_member", "partition_name", norm_prefix("prefix").alias("prefix"), "row_key").distinct()
    return reads.replica_count(rows.groupBy("ring_member").agg(F.count(F.lit(1)).alias("n")))


@query(
    f"""SELECT partition_name, CASE WHEN ttl_age_ms > 0 THEN {CLOCK} - ttl_age_ms ELSE 0 END AS ttl_cut, CASE WHEN ttl_age_ms > 0 THEN {CLOCK} - ttl_age_ms - ttl_age_ms // 10 ELSE 0 END AS ttl_check,
  CASE WHEN tombstone_age_ms > 0 THEN ({CLOCK} - tombstone_age_ms) * 4096 ELSE 0 END AS tombstone_version_cut FROM partition_info"""
)
def age_cutoffs(spark, sf_dir):
    """From what ages partitions are compacted, and from what they are looked at: an interval of a tenth of the age later."""
    rows = []
    for r in table(spark, sf_dir, "partition_info").collect():  # the catalog
        ttl, dead = r.ttl_age_ms or 0, r.tombstone_age_ms or 0
        ages = retention.Ages(ttl_ts=ttl, ttl_ts_interval=ttl // 10, tombstone_version=dead)
        rows.append((r.partition_name, ages.cutoffs(CLOCK).ttl_ts, ages.cutoffs(CLOCK, checking=True).ttl_ts, ages.cutoffs(CLOCK).tombstone_version))
    return spark.createDataFrame(rows, "partition_name string, ttl_cut bigint, ttl_check bigint, tombstone_version_cut bigint")


@query(
    """SELECT r_name AS partition_name, CASE r_regionkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) END AS live, r_regionkey % 3 <> 2 AS composted, r_regionkey % 3 <> 0 AS there FROM region"""
)
def engine_maintenance(spark, sf_dir):
    """Partitions by region with their nations: some destroyed, some abandoned for a next version, and their files composted."""
    engine = Engine(spark, shared.scratch(spark, "engine"))
    nation = table(spark, sf_dir, "nation").collect()  # 25 rows
    regions = {r.r_regionkey: r.r_name for r in table(spark, sf_dir, "region").collect()}
    for number, name in regions.items():
        mine = [(n.n_name.encode(), b"x") for n in nation if n.n_regionkey == number]
        engine.create(name).commit("none", None, puts(*mine))
        if number % 3 == 0:
            engine.destroy(name)
        elif number % 3 == 1:
            engine.abandon_version(name)
    engine.merge_all()
    gone = {path.partition("/")[0] for path in engine.compost()}
    there = set(engine.names())
    return spark.createDataFrame([(n, engine.partition(n).count() if n in there else 0, n in gone, n in there) for n in regions.values()], "partition_name string, live bigint, composted boolean, there boolean")


@query(_F + f", l AS (SELECT * FROM f {_LWW}) SELECT key, unnest(string_split(key, '/')) AS part FROM l WHERE NOT tombstoned AND ts_id > 0")
def scan_filtered_many(spark, sf_dir):
    """A filter that drops rows and makes several of others."""
    parts = lambda rows: rows.where("ts_id > 0").select("key", F.explode(F.split("key", "/")).alias("part"))
    return reads.scan_filtered(resolve.lww(flog(spark, sf_dir)), parts)


@query(
    _F
    + """, r AS (SELECT *, CASE WHEN tombstoned IS DISTINCT FROM lag(tombstoned) OVER (ORDER BY tx_id, seq) OR seq % 1000 = 0 THEN 1 ELSE 0 END AS b FROM f), n AS (SELECT *, sum(b) OVER (ORDER BY tx_id, seq) AS run FROM r)
SELECT run - min(run) OVER () AS run, tombstoned, start_tx, n FROM (SELECT cast(run AS bigint) AS run, bool_or(tombstoned) AS tombstoned, min(tx_id) AS start_tx, count(*) AS n FROM n GROUP BY 1)"""
)
def feed_runs(spark, sf_dir):
    """The whole feed's runs of puts and of deletes in one line, a new one at every thousandth delivery."""
    told = inspect.log_runs(flog(spark, sf_dir), [], "tombstoned", F.lit(1), F.col("seq") % 1000 == 0)
    return told.select("run", "tombstoned", "start_tx", "n")


@query("SELECT n_name AS key, r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 0")
def string_map(spark, sf_dir):
    """A map of nations to regions, some of them removed again."""
    engine = Engine(spark, shared.scratch(spark, "engine"))
    told = StringMap(engine.create("map", consistency="leader_quorum"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    pairs = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name").collect()  # 25 rows
    told.put_all({r.n_name: r.r_name for r in pairs})
    told.remove(*[r.n_name for r in pairs if r.n_nationkey % 5 == 0])
    return told.all()


@query("SELECT '' AS prefix, '' AS key, '' AS outcome WHERE false")
def filled_and_verified(spark, sf_dir):
    """A log filled with made-up rows, in two commits and a merge, verified against what went in: no key differs."""
    rows = random_log(spark, 20_000, 3_000, hot=0.3)
    store = LogStore(spark, shared.scratch(spark, "filled"))
    store.append(binary(rows.where("seq < 12000")))
    store.merge()
    store.append(binary(rows.where("seq >= 12000")))
    expected = resolve.live(resolve.lww(rows))
    return inspect.snapshot_verify(text(resolve.live(store.state()), "prefix", "key", "value"), expected, ["prefix", "key"], "value")
