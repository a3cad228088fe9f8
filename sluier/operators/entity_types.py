"""The dimension of entity types, rare diagnosis codes, and what follows from a type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Type, category, code, layers that find it.
ENTITY_TYPES = [
    ("bsn", "direct_identifier", "BSN", ["regex"]),
    ("name", "direct_identifier", "PER", ["deduce", "llm"]),
    ("email", "direct_identifier", "EML", ["regex"]),
    ("phone", "direct_identifier", "TEL", ["regex"]),
    ("iban", "direct_identifier", "IBN", ["regex"]),
    ("postcode_pc6", "direct_identifier", "PC6", ["regex"]),
    ("postcode_pc2", "quasi_identifier", "PC2", []),
    ("address", "direct_identifier", "ADR", ["regex"]),
    ("birthdate", "direct_identifier", "BDT", ["regex"]),
    ("birth_year", "quasi_identifier", "BYR", []),
    ("age", "quasi_identifier", "AGE", ["regex"]),
    ("mrn", "direct_identifier", "MRN", ["regex"]),
    ("epd_id", "direct_identifier", "EPD", ["regex"]),
    ("kenteken", "direct_identifier", "KEN", ["regex"]),
    ("icd10_code", "clinical_sensitive", "ICD", ["regex"]),
    ("diagnosis", "clinical_sensitive", "DGN", []),
    ("admission_date", "quasi_identifier", "ADM", ["regex"]),
    ("discharge_date", "quasi_identifier", "DCH", ["regex"]),
    ("exam_date", "quasi_identifier", "EXM", ["regex"]),
    ("org", "quasi_identifier", "ORG", ["deduce"]),
    ("location", "quasi_identifier", "LOC", ["deduce"]),
    ("product", "free_text", "PRD", ["llm"]),
    ("project", "free_text", "PRJ", ["regex", "llm"]),
]
# Layer -> rank; a lower rank wins an overlap.
LAYERS = {"regex": 1, "spacy": 2, "deduce": 2, "llm": 3}
# Diagnosis codes so rare that they point at a person.
RARE_CODES = (
    "C82.0 C84.4 C84.5 C91.0 C92.4 C92.5 E70.0 E70.2 E71.0 E72.1 E74.0 E75.0 E75.2 E76.0 E76.1 E76.2 E83.0 "
    "G11.1 G11.4 G12.0 G12.1 G71.0 G71.1 G71.2 D80.0 D81.0 D81.1 F84.2 Q78.0"
).split()


def entity_types(spark: SparkSession) -> DataFrame:
    """(entity_type, category, code, identifier_group): 23 rows."""
    rows = [(t, c, code, "direct" if c == "direct_identifier" else "indirect") for t, c, code, _ in ENTITY_TYPES]
    return spark.createDataFrame(rows, "entity_type string, category string, code string, identifier_group string")


def rare_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in RARE_CODES], "code string")


def _lookup(entity_type: Column, place: int) -> Column:
    out = F.when(entity_type == ENTITY_TYPES[0][0], ENTITY_TYPES[0][place])
    for row in ENTITY_TYPES[1:]:
        out = out.when(entity_type == row[0], row[place])
    return out


def category_of(entity_type: Column) -> Column:
    return _lookup(entity_type, 1)


def code_of(entity_type: Column) -> Column:
    return _lookup(entity_type, 2)


def derive_category(spans: DataFrame, entity_type: str = "entity_type") -> DataFrame:
    """spans with category, code and identifier_group of their type. The dimension has 23 rows: always broadcast."""
    types = entity_types(spans.sparkSession)
    return spans.join(F.broadcast(types), spans[entity_type] == types["entity_type"], "left").drop(types["entity_type"])


def missing_metadata(spark: SparkSession, types: DataFrame) -> DataFrame:
    """Types of a table (entity_type) that the dimension lacks."""
    return types.select("entity_type").distinct().join(F.broadcast(entity_types(spark)), "entity_type", "left_anti")


def detector_coverage(spark: SparkSession) -> DataFrame:
    """(entity_type, layers): layers in the order of their rank that can find a type; empty for the others."""
    rules = spark.createDataFrame([(t, layer, LAYERS[layer]) for t, _, _, layers in ENTITY_TYPES for layer in layers], "entity_type string, layer string, rank int")
    found = rules.groupBy("entity_type").agg(F.transform(F.array_sort(F.collect_set(F.struct("rank", "layer"))), lambda x: x["layer"]).alias("layers"))
    return entity_types(spark).select("entity_type").join(F.broadcast(found), "entity_type", "left").withColumn("layers", F.coalesce("layers", F.array().cast("array<string>")))
