"""The folder all executors share, and small files and tables kept in it.

Intermediate tables are written as Parquet below ``spark.checkpoint.dir`` so that
their lineage is cut and a lost executor costs nothing.  Where the setting is
missing, a temporary folder is used, but only in local mode.
"""

from __future__ import annotations

import atexit
import io
import math
import os
import pathlib
import tempfile
import uuid
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder.  Raises on a cluster that names none."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="feedloom-")
    sc.setCheckpointDir(base)
    atexit.register(_remove, spark, base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when Python ends."""
    path = f"{shared_dir(spark)}/feedloom/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialize(df: DataFrame, name: str = "table", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a durable cut of the lineage."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores, for costly work per row.

    Only a small table, read in fewer tasks than that, is shuffled for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let the executors' Python workers import this package, wherever they run; once per application."""
    if (app := spark.sparkContext.applicationId) in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = pathlib.Path(__file__).resolve().parent.parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(f.relative_to(package.parent))), f.read_bytes())
    path = f"{scratch(spark, 'package')}/{package.name}-{zlib.crc32(held.getvalue()):08x}.zip"
    _write_bytes(spark, path, held.getvalue())
    spark.sparkContext.addPyFile(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def blocks_for(df: DataFrame, per_block: int = 64 << 20, times: float = 1.0) -> int:
    """How many blocks leave about ``per_block`` bytes to each; at least the session's shuffle partitions.

    The size is that of the tables the plan reads, an upper bound as long as it multiplies no rows; ``times`` is
    by how much it does.  Leaves of unknown size (rows of the driver's, RDDs) count for nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    held = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    wanted = math.ceil(sum(h for h in held if h < 1 << 60) * times / per_block)
    return min(max(shuffle_partitions(df.sparkSession), wanted), 1_000_000)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _remove(spark: SparkSession, path: str) -> None:
    try:
        fs, p, _ = _fs(spark, path)
        fs.delete(p, True)
    except Exception:  # the session may be gone already
        pass


def remove(spark: SparkSession, path: str) -> None:
    fs, p, _ = _fs(spark, path)
    fs.delete(p, True)


def sizes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``; 0 if it is missing."""
    fs, p, _ = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a written table holds anything but markers."""
    return any(not n.startswith((".", "_")) for n in names(spark, path))


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """File names directly below ``path``, sorted; empty if it is missing."""
    fs, p, _ = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _write_bytes(spark: SparkSession, path: str, data: bytes, once: bool = False) -> None:
    """Write a small file in one step: a reader sees all of the old one, all of the new one, or (the first time) none.

    With ``once`` the file must not be there yet, and of several writers exactly one succeeds; the others get
    FileExistsError.  The folder's file system must rename in one step, as HDFS and local disks do.
    """
    fs, p, jvm = _fs(spark, path)
    if fs.getUri().getScheme() == "file":  # one machine's disk
        here = p.toUri().getPath()
        os.makedirs(os.path.dirname(here), exist_ok=True)
        tmp = f"{here}.{uuid.uuid4().hex}.tmp"
        with open(tmp, "wb") as f:
            f.write(data)
        try:
            (os.link if once else os.replace)(tmp, here)
        finally:
            if once:
                os.unlink(tmp)
        return
    held = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs.mkdirs(p.getParent())
    out = fs.create(held, True)
    out.write(bytearray(data))
    out.close()
    if once:
        if not fs.rename(held, p):  # refused where the target exists
            fs.delete(held, False)
            raise FileExistsError(path)
        return
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(held, p, how)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    _write_bytes(spark, path, text.encode())


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """The same for a file that must be new: FileExistsError if another writer was first."""
    _write_bytes(spark, path, text.encode(), once=True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p, jvm = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
