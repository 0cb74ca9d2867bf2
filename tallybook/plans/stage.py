"""Materialisation points: lineage is cut with tables written to the shared folder.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset
(tests, notebooks on one machine) a temporary folder of this process is used. Tables lie
under the application's id and are deleted when the driver ends; ``sweep`` deletes what
drivers left that ended otherwise.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_MARKED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tallybook-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def _filesystem(spark: SparkSession, path: str):
    """(file system, Path class) that hold a path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


def _run_folder(spark: SparkSession) -> str:
    """The folder of this application's tables, deleted when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    folder = f"{shared_folder(spark)}/tallybook/{app}"
    if folder not in _MARKED:
        fs, path = _filesystem(spark, folder)
        fs.mkdirs(path(folder))
        fs.deleteOnExit(path(folder))
        _MARKED.add(folder)
    return folder


def sweep(spark: SparkSession, older_than_s: float) -> int:
    """Delete the tables of other applications that were last written so many seconds ago; returns how many."""
    root = f"{shared_folder(spark)}/tallybook"
    fs, path = _filesystem(spark, root)
    if not fs.exists(path(root)):
        return 0
    old = [s.getPath() for s in fs.listStatus(path(root)) if s.getModificationTime() / 1000 < time.time() - older_than_s and s.getPath().getName() != spark.sparkContext.applicationId]
    return sum(bool(fs.delete(p, True)) for p in old)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan starts anew there.

    The written table outlives lost executors, unlike a local checkpoint.
    """
    spark = df.sparkSession
    path = f"{_run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit_rows: int) -> DataFrame:
    """Mark a materialised table for broadcast if it has at most ``limit_rows`` rows.

    Beyond the limit the table is returned as it is, so the join shuffles and
    AQE splits its skewed partitions.
    """
    return F.broadcast(df) if df.count() <= limit_rows else df


def shuffled(df: DataFrame) -> DataFrame:
    """Mark a side of a join that grows with the input: the join shuffles and sorts whatever Spark guesses.

    Spark's guess counts the bytes of compressed files and the share of the columns read, so a
    table of many times the threshold may be sent through the driver.
    """
    return df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
