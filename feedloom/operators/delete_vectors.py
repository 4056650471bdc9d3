"""Current state of a table under a change feed, kept by delete vectors.

Data files are never rewritten.  An index holds, per key, the file and position of the image
that stands.  Applying a batch writes its own newest image of every key to files of its own,
looks the keys up in the index, and sets the bit of whichever of the two images lost, in
the bitmap of that image's file.  A read scans the files and passes over the positions whose
bit is set.

Bitmaps are kept in words of 64 positions, and only words with a bit set exist.  A batch adds an
index run, one row per key it holds with the place that stands now and the place that lost, and the
words it sets, nothing of what was there before; runs and words are merged when there are more than
``merge_at``.  Runs lie in folders by hash prefix of the key (``shelf``), so that a small batch opens
only the shelves of its keys.  Layout below ``root``: ``data/<tag>`` (images), ``runs/<tag>/index``,
``runs/<tag>/words``, ``batch/<id>`` and ``manifest/<n>``, written last; a tag is the version and a number of the
writer's own.  A batch that failed before its manifest is simply applied again; one with a manifest is skipped;
of two writers one loses at the manifest and gets a Conflict.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.keys import fingerprint
from feedloom.sources import shared
from feedloom.sources.manifests import Manifests

#: Bytes that a shelf of the index is meant to hold; the number of shelves is set by the first batch and by merges.
PER_SHELF = 64 << 20
#: Bytes of images up to which a batch's keys are broadcast to look them up, so that the index isn't shuffled.
SMALL_BATCH = 1 << 20
#: Shelves at most, as powers of two: folders of a run, and numbers on the driver.
MOST_BITS = 12
#: What a word takes in memory when it is broadcast, at most: key, bits and the hash table's share.
WORD_BYTES = 64


def _number(path: str) -> int:
    """A file's number: what Spark's xxhash64 makes of its name, which holds the write's UUID and the task."""
    n = xxhash.xxh64_intdigest(path.rpartition("/")[2].encode(), 42)
    return n - (1 << 64) if n >> 63 else n


def _word(pos: Column) -> Column:
    return F.shiftright(pos, 6)


class DeleteVectorTable:
    """A keyed table over immutable Parquet files.

    The row that stands for a key is the first by ``newest`` (descending, nulls last) and then
    ``tie`` (ascending, nulls last).  ``key`` maps output names to expressions; null is a key value
    like any other.  Of rows equal in all of these one stands, that of the earlier batch.  Keys are
    told apart by 128 bits: two of n fall together with a chance of n*n / 2**129.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        key: dict[str, Column],
        newest: Sequence[str],
        tie: Sequence[str] = (),
        broadcast_limit: int = 64 << 20,
        merge_at: int = 8,
    ):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.newest, self.tie, self.broadcast_limit, self.merge_at = list(newest), list(tie), broadcast_limit, merge_at
        self.manifests = Manifests(spark, self.root, {"data": [], "runs": [], "bits": 0, "schema": None})

    def _rank(self) -> Column:
        """A struct that is larger the newer the row: all parts ascend, nulls lowest."""
        parts = [F.col(c).alias(f"n{i}") for i, c in enumerate(self.newest)]
        return F.struct(*parts, *[(-F.col(c)).alias(f"t{i}") for i, c in enumerate(self.tie)])

    def _images(self, batch: DataFrame) -> DataFrame:
        """The batch's newest row of each key, as it came: the others can't stand whatever was there before.

        Only hash and rank go into the first aggregation's buffers beside the row; both are cut to one
        per key and task before the shuffle, so a hot key sends one row per task.
        """
        hi, lo = fingerprint(list(self.key.values()), 11), fingerprint(list(self.key.values()), 13)
        row = F.struct(*[F.col(f"`{c}`") for c in batch.columns])
        slim = batch.select(hi.alias("hi"), lo.alias("lo"), self._rank().alias("rank"), row.alias("row"))
        return slim.groupBy("hi", "lo").agg(F.max(F.struct("rank", "row")).alias("m")).select("m.row.*")

    def _placed(self, path: str, schema: T.StructType, version: int) -> DataFrame:
        """Hash, rank and place (batch, file, position) of the images of a batch."""
        df = self.spark.read.schema(schema).parquet(path)
        at = df.metadataColumn("_metadata")  # even if the data have a column of that name
        hi, lo = fingerprint(list(self.key.values()), 11), fingerprint(list(self.key.values()), 13)
        place = F.struct(self._rank().alias("rank"), F.lit(version).alias("batch"), F.xxhash64(at["file_name"]).alias("file"), at["row_index"].alias("pos"))
        return df.select(hi.alias("hi"), lo.alias("lo"), place.alias("new"))

    def apply(self, batch: DataFrame | str | Sequence[str], batch_id: str) -> int:
        """Apply a batch of rows (or of Parquet files) once; returns the version it made.

        Repeats and disorder inside and between batches don't matter.  A batch already applied
        under this ``batch_id`` changes nothing.  An empty batch makes a version too.
        """
        if (done := self.manifests.version_of(batch_id)) is not None:
            return done
        now = self.manifests.newest()
        if not isinstance(batch, DataFrame):
            batch = self.spark.read.parquet(*([batch] if isinstance(batch, str) else batch))
        version = now["version"] + 1
        tag = f"{version}-{uuid.uuid4().hex[:16]}"
        here, data = f"{self.root}/runs/{tag}", f"{self.root}/data/{tag}"
        self._images(batch).write.mode("overwrite").parquet(data)
        files = self.spark.read.schema(batch.schema).parquet(data).inputFiles()  # this batch's only
        if len(set(map(_number, files))) < len(files):
            raise ValueError("two files of one batch share a number")
        weight = shared.sizes(self.spark, data)
        bits = now["bits"] if now["runs"] else self._bits_for(weight)
        new = self._placed(data, batch.schema, version)
        if now["runs"]:
            # Through the index: what stood for each of the batch's keys, and which of the two stands now.
            index = self._index(now, new.schema["new"].dataType)
            if bits:
                touched = [r[0] for r in new.select(self._shelf(bits).alias("shelf")).distinct().collect()]  # at most 2**MOST_BITS
                index = index.where(F.col("shelf").isin(touched))
            if weight <= SMALL_BATCH:
                index = index.join(F.broadcast(new.select("hi", "lo")), ["hi", "lo"], "left_semi")
            both = index.select("hi", "lo", F.col("at").alias("old"), F.lit(None).cast(new.schema["new"].dataType).alias("new")).unionByName(new, allowMissingColumns=True)
            met = both.groupBy("hi", "lo").agg(F.max("old").alias("old"), F.max("new").alias("new")).where("new IS NOT NULL")
            wins = F.col("old").isNull() | (F.col("old.rank") < F.col("new.rank"))
            run = met.select("hi", "lo", F.when(wins, F.col("new")).alias("at"), F.when(wins, F.col("old")).otherwise(F.col("new")).dropFields("rank").alias("lost"))
        else:
            run = new.select("hi", "lo", F.col("new").alias("at"), F.lit(None).cast("struct<batch:int,file:bigint,pos:bigint>").alias("lost"))
        self._write_run(run, f"{here}/index", bits)
        if now["runs"]:
            lost = self.spark.read.schema(run.schema).parquet(f"{here}/index").where("lost IS NOT NULL").select("lost.*")
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("pos") % 64).cast("int"))
            words = lost.groupBy("batch", "file", _word(F.col("pos")).alias("word")).agg(F.call_function("bit_or", bit).alias("bits"))
            words.write.mode("overwrite").parquet(f"{here}/words")
        state = {"data": [*now["data"], tag], "runs": [*now["runs"], tag], "bits": bits, "schema": now["schema"] or batch.schema.json()}
        self.manifests.commit(now, state, batch_id)
        if len(now["runs"]) + 1 > self.merge_at:
            self.merge()
        return version

    @staticmethod
    def _bits_for(weight: int) -> int:
        return min(MOST_BITS, (weight // PER_SHELF).bit_length())

    @staticmethod
    def _shelf(bits: int) -> Column:
        """The first bits of a key's hash."""
        return (F.shiftrightunsigned("hi", 64 - bits) if bits else F.lit(0)).cast("int")

    def _write_run(self, rows: DataFrame, path: str, bits: int) -> None:
        """With several shelves the rows are range-split by hash first, so that a task writes to few of them."""
        if not bits:
            rows.write.mode("overwrite").parquet(path)
            return
        rows = rows.repartitionByRange(max(shared.shuffle_partitions(self.spark), 1 << bits), "hi").sortWithinPartitions("hi")
        rows.withColumn("shelf", self._shelf(bits)).write.mode("overwrite").partitionBy("shelf").parquet(path)

    def _index(self, state: dict, place: T.StructType) -> DataFrame:
        """The places of all runs that stood when their run was written; of a key's the largest stands now."""
        schema = T.StructType().add("hi", T.LongType()).add("lo", T.LongType()).add("at", place)
        if state["bits"]:
            schema = schema.add("shelf", T.IntegerType())
        runs = [self.spark.read.schema(schema).parquet(f"{self.root}/runs/{r}/index") for r in state["runs"]]
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out.where("at IS NOT NULL")

    def merge(self) -> None:
        """Make one run of the index's runs and one set of words of all."""
        now = self.manifests.newest()
        if len(now["runs"]) < 2:
            return
        tag = f"{now['version'] + 1}-{uuid.uuid4().hex[:16]}"
        here = f"{self.root}/runs/{tag}"
        bits = self._bits_for(sum(shared.sizes(self.spark, f"{self.root}/runs/{r}/index") for r in now["runs"]))
        place = self._placed(f"{self.root}/data/{now['data'][0]}", T.StructType.fromJson(json.loads(now["schema"])), 0).schema["new"].dataType
        best = self._index(now, place).groupBy("hi", "lo").agg(F.max("at").alias("at"))
        self._write_run(best, f"{here}/index", bits)
        self._words(now).write.mode("overwrite").parquet(f"{here}/words")
        self.manifests.commit(now, {"runs": [tag], "bits": bits})

    def _words(self, now: dict) -> DataFrame:
        schema = "batch int, file bigint, word bigint, bits bigint"
        paths = [p for r in now["runs"] if shared.exists(self.spark, p := f"{self.root}/runs/{r}/words")]
        if not paths:
            return self.spark.createDataFrame([], schema)
        words = self.spark.read.schema(schema).parquet(*paths)
        return words if len(paths) == 1 else words.groupBy("batch", "file", "word").agg(F.call_function("bit_or", F.col("bits")).alias("bits"))

    def read(self, columns: Sequence[str] | None = None) -> DataFrame:
        """The standing rows, as stored, tombstones among them.

        Each file's words are broadcast to the tasks that read it: files are read in groups whose words are below the
        limit together (a file whose own words exceed it makes a group, and Spark joins that one as it sees fit), and
        the groups are united.  The rows themselves are never shuffled.
        """
        now = self.manifests.newest()
        if not now["version"]:
            raise ValueError("no batch was applied yet")
        words = self._words(now)
        schema = T.StructType.fromJson(json.loads(now["schema"]))
        # One row per file with a bit set, as many as Spark's own list of files at most.
        loads = {(r[0], r[1]): r[2] for r in words.groupBy("batch", "file").agg(F.count(F.lit(1)).alias("n")).collect()}
        most = max(1, self.broadcast_limit // WORD_BYTES)
        groups: list[tuple[list[str], int, list[int]]] = []
        if sum(loads.values()) <= most:
            groups.append(([f"{self.root}/data/{v}" for v in now["data"]], sum(loads.values()), []))
        else:
            for tag in now["data"]:
                v = int(tag.partition("-")[0])
                for f in self.spark.read.schema(schema).parquet(f"{self.root}/data/{tag}").inputFiles():
                    n = loads.get((v, _number(f)), 0)
                    if groups and groups[-1][1] + n <= most and groups[-1][2] == [v]:
                        groups[-1] = ([*groups[-1][0], f], groups[-1][1] + n, [v])
                    else:
                        groups.append(([f], n, [v]))
        out = None
        for paths, n, versions in groups:
            rows = self._read_group(paths, schema, words, n, versions, columns)
            out = rows if out is None else out.unionByName(rows)
        return out

    def _read_group(self, paths: list[str], schema: T.StructType, words: DataFrame, n: int, versions: list[int], columns: Sequence[str] | None) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(*paths)
        kept = list(columns) if columns is not None else rows.columns
        at = rows.metadataColumn("_metadata")
        # The row travels as one struct, so that no column of the data meets one of ours.
        row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
        if not n:
            return rows.select(row).select("row.*")
        rows = rows.select(row, F.xxhash64(at["file_name"]).alias("file"), at["row_index"].alias("pos")).withColumn("word", _word(F.col("pos")))
        if versions:
            words = words.where((F.col("batch") == versions[0]) & F.col("file").isin([_number(p) for p in paths]))
        mine = words.select("file", "word", "bits")
        if n <= max(1, self.broadcast_limit // WORD_BYTES):
            mine = F.broadcast(mine)
        bit = F.call_function("shiftright", F.col("bits"), F.expr("cast(pos % 64 as int)")).bitwiseAND(F.lit(1))
        return rows.join(mine, ["file", "word"], "left").where(F.coalesce(bit, F.lit(0)) == 0).select("row.*")
