"""Supersession, latest-wins and column-wise merge of versioned records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def supersession(rows: DataFrame, keys: list[str], order: list[str], digest: str, rid: str = "id") -> DataFrame:
    """Adds ``action`` (inserted, skipped) and ``successor``: per key, a version equal to the one
    before is skipped, a different one supersedes it; rows without a key are always inserted."""
    keyless = F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull()
    w = W.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("action", F.when(~keyless & F.lag(F.struct(digest)).over(w).eqNullSafe(F.struct(digest)), "skipped").otherwise("inserted"))
    ahead = W.partitionBy(*keys).orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    successor = F.first(F.when(F.col("action") == "inserted", F.col(rid)), ignorenulls=True).over(ahead)
    return marked.withColumn("successor", F.when(~keyless & (F.col("action") == "inserted"), successor))


def not_superseded(rows: DataFrame, source: DataFrame, link: str) -> DataFrame:
    """Rows whose source record was not superseded; rows without or with an unknown record stay."""
    gone = source.filter(F.col("superseded_by").isNotNull()).select(F.col("id").alias(link))
    return rows.join(gone, link, "left_anti")


def active_source(rows: DataFrame, source: DataFrame, link: str) -> DataFrame:
    """Rows without a source record or with an active one; an unknown record drops the row."""
    active = source.filter(F.col("superseded_by").isNull()).select(F.col("id").alias("active_id"))
    return rows.join(active, F.col(link) == F.col("active_id"), "left").filter(F.col(link).isNull() | F.col("active_id").isNotNull()).drop("active_id")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, first by ``order`` (DISTINCT ON)."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def merge_columns(rows: DataFrame, keys: list[str], order: list[str], keep_old: list[str], overwrite: list[str]) -> DataFrame:
    """Folds all versions of a key in load order: ``keep_old`` columns keep the last value that is
    not null, ``overwrite`` columns take the last version's value, null or not."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = rows.select(*keys, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in keep_old], *[F.last(c).over(w).alias(c) for c in overwrite], F.row_number().over(W.partitionBy(*keys).orderBy(*order)).alias("_k"))
    return out.filter("_k = 1").drop("_k")


def canonical_json(fields: Column) -> Column:
    """A map as JSON text with sorted keys and no blanks; null values are null, not empty."""
    text = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    pairs = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(text(e["key"]), F.lit(":"), text(e["value"])))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def record_hash(fields: Column) -> Column:
    """sha256 of the canonical JSON of a map."""
    return F.sha2(canonical_json(fields), 256)


def replace_partition(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of ``current`` outside the partitions that ``incoming`` delivers, and all of ``incoming``."""
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)
