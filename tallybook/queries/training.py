"""Queries of the general training-data problems (1 and 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.operators import schema_drift, snapshot_diff
from tallybook.plans.stage import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.found(table(spark, d, "source_record"), table(spark, d, "real_transaction_export_adams"))


def p1_consistent_table(spark: SparkSession, d: str) -> DataFrame:
    """Rows and filled canonical fields of each delivery after routing."""
    out = schema_drift.consistent_table(table(spark, d, "source_record"), table(spark, d, "real_transaction_export_adams"))
    filled = F.size(F.map_filter("fields", lambda _, v: v.isNotNull()))
    return out.groupBy("origin", "feed", "delivery", "layout").agg(F.count("*").alias("rows"), F.sum(filled).alias("filled"), F.sum(F.size("stray")).alias("stray"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_diff.snapshot_changes(table(spark, d, "source_record"))


QUERIES = {f.__name__: f for f in (p1_found, p1_consistent_table, p3_found)}

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8195) || chr(12288)"
SQL = {
    "p3_found": f"""
WITH rows_ AS (
  SELECT data_source_id, strftime(CAST(pull_date AT TIME ZONE 'UTC' AS DATE), '%Y-%m-%d') AS dy, NULLIF(upper(trim(source_record_key, {_WS})), '') AS k, created_at,
         list_sort(list_transform(list_filter(map_entries(raw_fields), lambda e: trim(coalesce(e.value, ''), {_WS}) <> ''), lambda e: e.key || chr(31) || trim(e.value, {_WS}))) AS c
  FROM source_record WHERE feed_kind = 'full'),
days AS (SELECT data_source_id, dy, lag(dy) OVER (PARTITION BY data_source_id ORDER BY dy) AS before FROM (SELECT DISTINCT data_source_id, dy FROM rows_)),
once AS (SELECT data_source_id, dy, k, arg_max(c, created_at) AS c FROM rows_ WHERE k IS NOT NULL GROUP BY ALL),
later AS (SELECT o.*, d.before FROM once o JOIN days d USING (data_source_id, dy) WHERE d.before IS NOT NULL),
earlier AS (SELECT o.*, d.dy AS after FROM once o JOIN days d ON o.data_source_id = d.data_source_id AND o.dy = d.before)
SELECT coalesce(l.data_source_id, e.data_source_id) AS data_source_id, coalesce(l.k, e.k) AS source_record_key, coalesce(l.dy, e.after) AS snapshot_day,
       CASE WHEN e.k IS NULL THEN 'added' WHEN l.k IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM later l FULL JOIN earlier e ON l.data_source_id = e.data_source_id AND l.dy = e.after AND l.k = e.k
WHERE l.c IS DISTINCT FROM e.c""",
}
