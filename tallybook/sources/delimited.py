"""Delimited sources described by a configuration (S1-S6, S10, S12): no inference, no silent loss.

Every reader returns the well-formed rows and, in ``rejected``, the raw lines that do
not fit the layout with the reason, so that a count of both equals the lines read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.text import blank_to_null
from tallybook.plans.stage import materialize


@dataclass(frozen=True)
class Layout:
    """Columns of a delimited file, in order, and how it is written."""

    columns: tuple[str, ...]
    delimiter: str = "|"
    encoding: str = "ISO-8859-1"
    header: bool = False
    trailing_delimiter: bool = False
    dates: dict[str, str] = field(default_factory=dict)
    decimals: tuple[str, ...] = ()


def raw_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(value): the lines of a text in any encoding (the text source reads UTF-8 only)."""
    return spark.read.schema("value string").option("sep", "\x01").option("quote", "").option("encoding", encoding).option("maxCharsPerColumn", -1).csv(path)


def _typed(layout: Layout, name: str) -> Column:
    c = blank_to_null(F.col(name))
    if name in layout.dates:
        return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in layout.dates[name].split("|")]).alias(name)
    if name in layout.decimals:
        return F.regexp_replace(c, ",", "").try_cast("decimal(14,2)").alias(name)
    return c.alias(name)


def parse_lines(lines: DataFrame, layout: Layout) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of the lines in ``value``; a wrong number of fields rejects a line."""
    lines = lines.select(F.regexp_replace("value", "\r$", "").alias("line")).filter("line != ''")
    parts = lines.select("line", F.split("line", r"\Q" + layout.delimiter + r"\E", -1).alias("p"))
    n = len(layout.columns)
    if layout.trailing_delimiter:
        parts = parts.withColumn("p", F.when((F.size("p") == n + 1) & (F.element_at("p", -1) == ""), F.slice("p", 1, n)).otherwise(F.col("p")))
    if layout.header:
        parts = parts.filter(F.col("p") != F.array(*[F.lit(c) for c in layout.columns]))
    good = parts.filter(F.size("p") == n).select(*[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(layout.columns)])
    rejected = parts.filter(F.size("p") != n).select("line", F.concat(F.lit("fields: "), F.size("p").cast("string")).alias("reason"))
    return good.select(*[_typed(layout, c) for c in layout.columns]), rejected


def read_lines(spark: SparkSession, path: str, layout: Layout) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of an unquoted delimited file."""
    return parse_lines(raw_lines(spark, path, layout.encoding), layout)


def read_csv(spark: SparkSession, path: str, layout: Layout) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of a quoted file with a header that must name the layout's columns; ragged rows are rejected."""
    first = raw_lines(spark, path, layout.encoding).first()
    names = [c.strip().strip('"') for c in (first["value"] if first else "").split(layout.delimiter)]
    if layout.header and names != list(layout.columns):
        raise ValueError(f"header {names} is not {list(layout.columns)}")
    schema = ", ".join(f"`{c}` string" for c in layout.columns) + ", `_corrupt` string"
    raw = spark.read.schema(schema).option("header", layout.header).option("sep", layout.delimiter).option("encoding", layout.encoding).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("enforceSchema", True).csv(path)
    raw = materialize(raw, "csv")  # Spark does not let the rejected text be read alone from the file
    rejected = raw.filter("_corrupt is not null").select(F.col("_corrupt").alias("line"), F.lit("ragged row").alias("reason"))
    return raw.filter("_corrupt is null").select(*[_typed(layout, c) for c in layout.columns]), rejected


def parse_records(lines: DataFrame, layouts: dict[str, Layout]) -> tuple[dict[str, DataFrame], DataFrame]:
    """One table per record type of lines whose first field names the type, and the rejected lines with the reason.

    Rows of at least half the width are padded with nulls; shorter ones, unknown types and
    rows with more fields than columns are rejected.
    """
    any_ = next(iter(layouts.values()))
    parts = lines.filter("value != ''").select(F.col("value").alias("line"), F.split("value", r"\Q" + any_.delimiter + r"\E", -1).alias("p"))
    kind, size = F.get("p", F.lit(0)), F.size("p")
    out, reason = {}, F.lit("unknown type")
    for name, layout in layouts.items():
        n = len(layout.columns)
        width = n + int(layout.trailing_delimiter)
        reason = F.when(kind == name, F.when(size * 2 < n, "short row").when(size > width, "surplus fields")).otherwise(reason)
        own = parts.filter((kind == name) & (size * 2 >= n) & (size <= width))
        out[name] = own.select(*[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(layout.columns)]).select(*[_typed(layout, c) for c in layout.columns])
    return out, parts.select("line", reason.alias("reason")).filter("reason is not null")


def read_records(spark: SparkSession, path: str, layouts: dict[str, Layout]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The record types of a file, and its rejected lines."""
    return parse_records(raw_lines(spark, path, next(iter(layouts.values())).encoding), layouts)


def skip_rows(rows: DataFrame, done: int, key: list[str]) -> DataFrame:
    """Rows after the first ``done`` in the order of ``key`` (resuming a load)."""
    return rows.orderBy(*key).offset(done)
