"""Structured documents as tables (S7-S9, S11, S13-S15): JSON, XML, GeoJSON, YAML rosters and saved pages of a REST API.

Files are read by executors; only YAML, which has no splittable form, is parsed per file
in Arrow batches (``binaryFile``), never on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallybook.functions.text import blank_to_null


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Rows of an XML roster; elements that are missing are null."""
    return spark.read.schema(schema).option("rowTag", row_tag).option("mode", "PERMISSIVE").xml(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(properties, geometry): features of JSON or GeoJSON files, keys of the properties in lower case, geometry as JSON text."""
    text = spark.read.option("wholetext", True).text(path)
    parsed = F.from_json("value", "features array<struct<properties map<string,string>, attributes map<string,string>, geometry string>>")
    rows = text.select(F.explode(parsed["features"]).alias("f"))
    properties = F.transform_keys(F.coalesce("f.properties", "f.attributes"), lambda k, _: F.lower(k))
    return rows.select(properties.alias("properties"), F.col("f.geometry").alias("geometry"))


def _yaml_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import yaml

    for batch in batches:
        paths, at, entries = [], [], []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            loaded = yaml.safe_load(content) or []
            for i, entry in enumerate(loaded if isinstance(loaded, list) else [loaded]):
                paths.append(path)
                at.append(i)
                entries.append(sorted((k, None if v is None else str(v)) for k, v in _flat(entry)))
        yield pa.record_batch([pa.array(paths, pa.string()), pa.array(at, pa.int64()), pa.array(entries, pa.map_(pa.string(), pa.string()))], ["path", "entry", "fields"])


def _flat(value: object, prefix: str = "") -> Iterator[tuple[str, object]]:
    """Dotted paths of the leaves of nested mappings and lists."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _flat(v, f"{prefix}{k}.")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _flat(v, f"{prefix}{i}.")
    else:
        yield prefix[:-1], value


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """(path, entry, fields): entries of YAML lists as maps from dotted paths to texts."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_yaml_rows, "path string, entry long, fields map<string,string>")


def chamber(fields: Column) -> Column:
    """Where a legislator sat last: house, senate, delegate or executive, by the terms' types."""
    kind = F.coalesce(*[F.try_element_at(fields, F.lit(f"terms.{i}.type")) for i in range(4, -1, -1)])
    state = F.coalesce(*[F.try_element_at(fields, F.lit(f"terms.{i}.state")) for i in range(4, -1, -1)])
    return F.when(kind == "sen", "senate").when(kind.isin("prez", "viceprez"), "executive").when((kind == "rep") & state.isin("DC", "PR", "GU", "VI", "AS", "MP"), "delegate").when(kind == "rep", "house")


def read_pages(spark: SparkSession, path: str, schema: str, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, gaps): results of saved API pages, each key once from its last page, and the page numbers that are missing.

    Pages are JSON objects with ``results`` and ``pagination`` (page, pages).
    """
    pages = spark.read.schema(f"results array<struct<{schema}>>, pagination struct<page: bigint, pages: bigint>").option("multiLine", True).json(path)
    rows = pages.select("pagination.page", F.explode("results").alias("r")).select("page", "r.*")
    last = rows.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("page")))).filter("_k = 1").drop("_k", "page")
    every = pages.agg(F.max("pagination.pages").alias("n")).filter("n is not null").select(F.explode(F.sequence(F.lit(1), "n")).alias("page"))
    return last, every.join(pages.select("pagination.page").distinct(), "page", "left_anti")


def fill_missing(rows: DataFrame, key: list[str], fields: list[str], priority: Column) -> DataFrame:
    """One row per key: each field from the first source in ``priority`` that has it; blanks count as missing."""
    pick = [F.min(F.when(blank_to_null(F.col(f)).isNotNull(), F.struct(priority.alias("p"), blank_to_null(F.col(f)).alias("v"))))["v"].alias(f) for f in fields]
    return rows.groupBy(*key).agg(*pick)


def prune_snapshot(stored: DataFrame, replayed: DataFrame, key: list[str], seat: list[str], capacity: int) -> tuple[DataFrame, DataFrame]:
    """(kept, faults): stored rows that a full replay still has, and seats of the replay held by more than ``capacity`` rows.

    Nothing is pruned while the replay has faults.
    """
    faults = replayed.groupBy(*seat).agg(F.count("*").alias("n")).filter(F.col("n") > capacity)
    sound = faults.agg((F.count("*") == 0).alias("sound"))
    marked = stored.join(replayed.select(*key, F.lit(True).alias("again")).distinct(), key, "left").join(F.broadcast(sound))
    return marked.filter("again or not sound").drop("again", "sound"), faults
