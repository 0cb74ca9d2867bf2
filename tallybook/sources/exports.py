"""The portal exports as typed transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.finance import money, tidy, us_date
from tallybook.plans.stage import table


def transactions(spark: SparkSession, d: str) -> DataFrame:
    """One typed row per exported row."""
    x = table(spark, d, "real_transaction_export_adams")
    return x.select(
        F.col("export_row_id").alias("id"), F.col("export_name").alias("series"), "exported_on", F.col("committee_sboe_id").alias("committee"), F.col("committee_name"),
        tidy(F.col("name")).alias("name"), tidy(F.col("employers_name_specific_field")).alias("employer"), tidy(F.col("profession_job_title")).alias("occupation"),
        tidy(F.col("city")).alias("city"), F.upper(tidy(F.col("state"))).alias("state"), F.left(F.col("zip_code"), F.lit(5)).alias("zip5"), F.col("zip_code"),
        F.coalesce(tidy(F.col("transaction_type")), tidy(F.col("transction_type"))).alias("kind"), money(F.col("amount")).alias("amount"), us_date(F.col("date_occured")).alias("day"),
        tidy(F.col("report_name")).alias("report"), tidy(F.col("form_of_payment")).alias("form"), tidy(F.col("purpose")).alias("purpose"),
    )


#: The same transactions for DuckDB.
TX = """tx AS (SELECT export_row_id AS id, export_name AS series, exported_on, committee_sboe_id AS committee, committee_name, nullif(trim(name, ' '), '') AS name,
  nullif(trim(employers_name_specific_field, ' '), '') AS employer, nullif(trim(profession_job_title, ' '), '') AS occupation, nullif(trim(city, ' '), '') AS city,
  upper(nullif(trim(state, ' '), '')) AS state, left(zip_code, 5) AS zip5, zip_code, coalesce(nullif(trim(transaction_type, ' '), ''), nullif(trim(transction_type, ' '), '')) AS kind,
  TRY_CAST(regexp_replace(amount, '[, $]', '', 'g') AS DECIMAL(14,2)) AS amount, CAST(try_strptime(nullif(trim(date_occured, ' '), ''), '%m/%d/%Y') AS DATE) AS day,
  nullif(trim(report_name, ' '), '') AS report, nullif(trim(form_of_payment, ' '), '') AS form, nullif(trim(purpose, ' '), '') AS purpose FROM real_transaction_export_adams)"""
