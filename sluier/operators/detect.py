"""Detection: patterns (layer 1), merging of layers, routing by confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluier.functions import spans as S
from sluier.functions.checks import bsn_valid, iban_valid
from sluier.operators.dates import context_dates

# Entity type and form, in the order in which they claim their text.
PATTERNS: list[tuple[str, str]] = [
    ("email", r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"),
    ("iban", r"\bNL\d{2}[A-Z]{4}\d{10}\b"),
    ("bsn", r"\b\d{9}\b"),
    ("address", r"(?i)\b(?:[A-Z][\w-]+[ \t]+)?[A-Za-z][\w-]*(?:straat|weg|laan|plein|gracht|kade|singel|dreef|pad|hof|boulevard|steeg)[ \t]+\d{1,4}[A-Za-z]?\b"),
    ("postcode_pc6", r"\b\d{4}\s?[A-Z]{2}\b"),
    ("phone", r"\b(?:\+31|0)[\s-]?[1-9](?:[\s-]?\d){8}\b"),
    ("kenteken", r"\b[A-Z0-9]{1,3}-[A-Z0-9]{1,3}-[A-Z0-9]{1,3}\b"),
    ("mrn", r"(?i)\bMRN[:\s-]{0,3}\d{6,10}\b"),
    ("epd_id", r"(?i)\bEPD[:\s-]{0,3}\d{6,12}\b"),
    ("icd10_code", r"\b[A-TV-Z]\d{2}(?:\.\d{1,2})?\b"),
    ("project", r"\b[A-Z]{2,5}-\d{2,6}\b"),
    ("age", r"(?i)\b(\d{1,3})[\s-]?(?:jaar|jarige?)\b"),
    ("birthdate", r"\b(?:0?[1-9]|[12]\d|3[01])[-/](?:0?[1-9]|1[0-2])[-/](?:19|20)\d{2}\b"),
]
VALIDATORS: dict[str, Callable[[Column], Column]] = {"iban": iban_valid, "bsn": bsn_valid}

SPAN = "struct<start:int,end:int,original:string,entity_type:string,confidence:double,layer:string>"
SPANS = f"array<{SPAN}>"
_RANKED = "array<struct<rank:int,start:int,end:int,original:string,entity_type:string>>"

# Thresholds by configuration key, and their defaults.
THRESHOLDS = {"threshold_regex": 1.0, "threshold_spacy_person": 0.85, "threshold_spacy_org": 0.80, "threshold_spacy_location": 0.85, "threshold_llm": 0.70}


def of_type(text: Column, entity_type: str) -> Column:
    """All matches of one type's pattern that pass its checksum: (start, end, text)."""
    return S.scan(text, dict(PATTERNS)[entity_type], VALIDATORS.get(entity_type))


def pattern_spans(text: Column) -> Column:
    """Layer 1: dates typed by context claim first, then the patterns in order; a find that fails its check claims nothing."""

    def ranked(rank: int, spans: Column, kind: str | None) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(rank).alias("rank"), s["start"], s["end"], s["text"].alias("original"), s["entity_type"] if kind is None else F.lit(kind).alias("entity_type")))

    claims = [ranked(0, context_dates(text), None), *(ranked(i + 1, of_type(text, kind), kind) for i, (kind, _) in enumerate(PATTERNS))]
    chosen = S.resolve(F.array_sort(F.concat(*claims)), _RANKED)
    spans = F.transform(chosen, lambda s: F.struct(s["start"], s["end"], s["original"], s["entity_type"], F.lit(1.0).alias("confidence"), F.lit("regex").alias("layer")))
    return F.array_sort(spans).cast(SPANS)


def detect(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """docs with an array of layer-1 spans in the order of the text; null text has none."""
    return docs.withColumn(into, pattern_spans(F.coalesce(F.col(text), F.lit(""))))


def exploded(docs: DataFrame, spans: str = "spans") -> DataFrame:
    """One row a span: doc_id, seq and the fields of the span."""
    return docs.select("doc_id", F.posexplode_outer(spans).alias("seq", "s")).filter("s is not null").select("doc_id", "seq", "s.*")


def merge_layers(*layers: Column) -> Column:
    """Spans of all layers, the first given wins: a later span that overlaps a kept one is dropped."""

    def tag(layer_no: int, spans: Column) -> Column:
        return F.transform(spans, lambda s, i: F.struct(F.lit(layer_no).alias("layer_no"), i.alias("seq"), s.alias("s")))

    tagged = [tag(i, spans) for i, spans in enumerate(layers)]
    ordered = F.array_sort(F.concat(*tagged))
    kind = f"array<{SPAN}>"
    return F.aggregate(ordered, S.none(kind), lambda taken, x: F.when(F.exists(taken, lambda y: S.overlap(x["s"], y)), taken).otherwise(F.concat(taken, F.array(x["s"]))))


def threshold_of(layer: Column, entity_type: Column, thresholds: dict[str, float]) -> Column:
    """Layer 2 has thresholds for names, organisations and places; other types need full confidence there."""
    t = THRESHOLDS | thresholds
    second = F.when(entity_type == "name", t["threshold_spacy_person"]).when(entity_type == "org", t["threshold_spacy_org"]).when(entity_type == "location", t["threshold_spacy_location"]).otherwise(1.0)
    return F.when(layer == "regex", t["threshold_regex"]).when(layer == "llm", t["threshold_llm"]).otherwise(second)


def route(layer: Column, entity_type: Column, confidence: Column, thresholds: dict[str, float] | None = None) -> Column:
    """`confident` from the threshold on, else `pending`."""
    return F.when(confidence >= threshold_of(layer, entity_type, thresholds or {}), "confident").otherwise("pending")


def layer_counts(spans: DataFrame) -> DataFrame:
    """Finds of each layer and type."""
    return spans.groupBy("layer", "entity_type").agg(F.count(F.lit(1)).alias("finds"))


def read_thresholds(config: DataFrame) -> DataFrame:
    """(key, threshold) of all known keys from config (key, value); a missing or bad text means the default."""
    known = config.sparkSession.createDataFrame(list(THRESHOLDS.items()), "key string, fallback double")
    return known.join(config.select("key", "value"), "key", "left").select("key", F.coalesce(F.col("value").try_cast("double"), "fallback").alias("threshold"))
