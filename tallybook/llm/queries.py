"""Queries of the problems on entities and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import addresses, components, contamination, fusion, name_matching, org_matching, tokenizer, truncation
from tallybook.plans.stage import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return addresses.same_places(table(spark, d, "address"), table(spark, d, "ownership"), table(spark, d, "real_transaction_export_adams"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each record that names a place with its class of equal forms and the number of linked classes."""
    return addresses.place_classes(table(spark, d, "address"), table(spark, d, "ownership"), table(spark, d, "real_transaction_export_adams"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return name_matching.same_names(table(spark, d, "donor_er_view"), table(spark, d, "ownership"), table(spark, d, "real_transaction_export_adams"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each named record with its class of equal forms and the number of linked classes."""
    return name_matching.name_classes(table(spark, d, "donor_er_view"), table(spark, d, "ownership"), table(spark, d, "real_transaction_export_adams"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return components.person_groups(table(spark, d, "person_absorption"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return fusion.survivors(table(spark, d, "person"), table(spark, d, "person_absorption")).select("group_id", "field", "person_id")


def p6_fused(spark: SparkSession, d: str) -> DataFrame:
    """The value of maximum posterior per field, without any preference."""
    return fusion.survivors(table(spark, d, "person"), table(spark, d, "person_absorption"), preferred=False).select("group_id", "field", "value", F.round("posterior", 6).alias("posterior"))


def p6_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What decides the surviving values: votes or prior, per field."""
    return fusion.decisions(table(spark, d, "person"), table(spark, d, "person_absorption"))


def _bodies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "organization"), table(spark, d, "address"), table(spark, d, "political_organization_527")


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that town, date or state admits, with its confidence."""
    return org_matching.all_pairs(*_bodies(spark, d))


def p7_reliability(spark: SparkSession, d: str) -> DataFrame:
    """Held-out agreement of the EINs beside the confidence."""
    return org_matching.reliability(*_bodies(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return org_matching.matches(*_bodies(spark, d)).select("organization_id", "political_organization_527_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.token_ids(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return tokenizer.texts_of(tokenizer.token_ids(table(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.found(table(spark, d, "documents"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_classes, p4_found, p4_classes, p5_found, p6_found, p6_fused, p6_decisions, p7_found, p7_matches, p7_reliability, p8_ids, p8_decoded, p9_found, p10_found, p10_rates)}

SQL = {
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p5_found": """
WITH RECURSIVE link AS (
  SELECT DISTINCT lower(trim(absorbed_person_id)) AS a, lower(trim(canonical_person_id)) AS b FROM person_absorption
  WHERE trim(absorbed_person_id) <> '' AND trim(canonical_person_id) <> '' AND lower(trim(absorbed_person_id)) <> lower(trim(canonical_person_id))),
both_ AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(id, seen) AS (
  SELECT a, a FROM both_
  UNION
  SELECT r.id, e.b FROM reach r JOIN both_ e ON e.a = r.seen)
SELECT id AS person_id, min(seen) AS group_id FROM reach GROUP BY id""",
}
