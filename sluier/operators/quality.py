"""Checks of labelled data (gold: doc_id, start, end, text, entity_type, category; docs: doc_id, text)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluier.functions.checks import bsn_valid, iban_valid, icd_normalise
from sluier.operators.entity_types import RARE_CODES, category_of

FINDING = ("doc_id", "check", "severity", "detail")


def _finding(rows: DataFrame, check: str, severity: str, detail) -> DataFrame:
    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.alias("detail"))


def check_offsets(docs: DataFrame, gold: DataFrame) -> DataFrame:
    """Labels whose stretch of the text isn't their text, or is empty."""
    rows = gold.join(docs.select("doc_id", F.col("text").alias("body")), "doc_id")
    bad = ~(F.col("end") > F.col("start")) | (F.substring("body", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("text"))
    return _finding(rows.filter(bad), "offsets", "error", F.col("text"))


def check_unique_ids(docs: DataFrame) -> DataFrame:
    return _finding(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "unique_ids", "error", F.col("n").cast("string"))


def check_category(gold: DataFrame) -> DataFrame:
    return _finding(gold.filter(~F.col("category").eqNullSafe(category_of(F.col("entity_type"))) & F.col("category").isNotNull()), "category", "error", F.col("text"))


def check_label_checksums(gold: DataFrame) -> DataFrame:
    bad = ((F.col("entity_type") == "bsn") & ~bsn_valid(F.col("text"))) | ((F.col("entity_type") == "iban") & ~iban_valid(F.col("text")))
    return _finding(gold.filter(bad), "checksum", "error", F.col("text"))


def warn_rare_codes(gold: DataFrame) -> DataFrame:
    return _finding(gold.filter((F.col("entity_type") == "icd10_code") & icd_normalise(F.col("text")).isin(*RARE_CODES)), "rare_code", "warning", F.col("text"))


def findings(docs: DataFrame, gold: DataFrame) -> DataFrame:
    parts = [check_offsets(docs, gold), check_unique_ids(docs), check_category(gold), check_label_checksums(gold), warn_rare_codes(gold)]
    return reduce(DataFrame.unionByName, parts)


def validation_report(docs: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: errors, warnings, records, entities, ok."""
    told = findings(docs, gold).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    n = docs.agg(F.count(F.lit(1)).alias("records")).crossJoin(gold.agg(F.count(F.lit(1)).alias("entities")))  # one row each
    return told.crossJoin(n).withColumn("ok", F.col("errors") == 0)
