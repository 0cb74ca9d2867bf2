"""Publishing rollups and exports (K16, K21, K24): versions, an atomic pointer, resumable loads."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.finance import csv_cell
from tallybook.plans.stage import _filesystem


def fingerprint(df: DataFrame) -> str:
    """A print of all rows that does not depend on their order or partitions."""
    row = F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}))
    part = lambda a: F.sum(F.conv(F.substr(row, F.lit(a), F.lit(12)), 16, 10).cast("decimal(38,0)"))
    r = df.agg(F.count("*").alias("n"), part(1).alias("a"), part(13).alias("b")).first()
    return f"{r['n']}-{r['a'] or 0}-{r['b'] or 0}"


def publish(df: DataFrame, root: str) -> dict:
    """Write a new version under ``root`` and point to it; readers see the old one or the new one, never a part."""
    spark = df.sparkSession
    version = f"{root}/v-{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"
    df.write.mode("error").parquet(version)
    pointer = {"version": version, "fingerprint": fingerprint(spark.read.parquet(version)), "built": time.time()}
    fs, path = _filesystem(spark, root)
    new, current = path(f"{root}/new-{uuid.uuid4().hex}"), path(f"{root}/current.json")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(pointer).encode()))
    out.close()
    modes = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(modes, 1)
    options[0] = modes.OVERWRITE
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(new, current, options)
    return pointer


def pointer_of(spark: SparkSession, root: str) -> dict | None:
    """The current pointer, or nothing if nothing was published."""
    fs, path = _filesystem(spark, root)
    if not fs.exists(path(f"{root}/current.json")):
        return None
    rows = spark.read.option("wholetext", True).text(f"{root}/current.json").collect()  # one small file
    return json.loads(rows[0]["value"])


def current(spark: SparkSession, root: str, max_age_s: float | None = None) -> DataFrame:
    """The published version; too old or missing is an error, never a silent substitute."""
    p = pointer_of(spark, root)
    if p is None:
        raise LookupError(f"nothing published under {root}")
    if max_age_s is not None and time.time() - p["built"] > max_age_s:
        raise LookupError(f"the version under {root} is too old")
    return spark.read.parquet(p["version"])


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """CSV whose cells no spreadsheet takes for formulas, or JSON lines that keep nulls."""
    if kind == "csv":
        safe: list[Column] = [csv_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
        df.select(*safe).write.option("header", True).option("escape", '"').csv(path)
    else:
        df.write.option("ignoreNullFields", False).json(path)


def load_batches(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keep: str = "true") -> int:
    """Append files not loaded yet that pass ``keep``; a load that broke off goes on where it stopped. Returns the rows it added."""
    query = spark.readStream.schema(schema).option("header", True).csv(source).filter(keep).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)
