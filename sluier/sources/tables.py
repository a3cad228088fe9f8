"""Sources and sinks. Content and vault have base paths of their own; nothing that takes one takes the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluier.operators.entity_types import entity_types

ENTITY = "struct<start:int,end:int,text:string,type:string,category:string,note:string>"
RECORD = f"id string, prompt string, entities array<{ENTITY}>, seed int, scenario string, difficulty string, expected_generalization map<string,string>, meta map<string,string>"
MAPPING_COLUMNS = ["session_id", "pseudonym", "original", "entity_type", "entity_category", "pseudonymization_mode", "created_at"]
VAULT_BUCKETS = 64


def read_labelled_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of labelled dossiers, a JSON object a line; blank lines are skipped.

    A record is rejected if it doesn't parse, lacks id or prompt, or has an entity whose stretch isn't its text.
    """
    rows = spark.read.schema(RECORD + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    bad_span = F.exists(F.coalesce("entities", F.array().cast(f"array<{ENTITY}>")), lambda e: ~F.coalesce((e["end"] > e["start"]) & (F.substring("prompt", e["start"] + 1, e["end"] - e["start"]) == e["text"]), F.lit(False)))
    why = F.when(F.col("_corrupt_record").isNotNull(), "not a record").when(F.col("id").isNull() | F.col("prompt").isNull(), "id or prompt missing").when(bad_span, "offsets")
    # The parsed columns are part of what is read, so the corrupt column may be used without a cache.
    judged = rows.withColumn("reason", why).withColumns({"seed": F.coalesce("seed", F.lit(0)), "entities": F.coalesce("entities", F.array().cast(f"array<{ENTITY}>"))})
    return judged.filter("reason is null").drop("_corrupt_record", "reason"), judged.filter("reason is not null").select("id", "_corrupt_record", "reason")


def write_labelled_jsonl(records: DataFrame, path: str) -> None:
    """JSON lines, compressed: field names and types are most of their text. Readers tell the form by the files' names."""
    records.write.mode("overwrite").option("ignoreNullFields", "true").option("compression", "gzip").json(path)


def write_report_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def type_score_rows(scored: DataFrame) -> DataFrame:
    """One row for each runner and type, types without finds as zeros; exact and overlap scores beside each other (15 columns)."""
    runners = scored.select("runner").distinct()
    types = entity_types(scored.sparkSession).select("entity_type", "category", "identifier_group")
    every = runners.crossJoin(F.broadcast(types))  # runners are a handful, types 23
    out = every
    for mode in ("exact", "overlap"):
        side = scored.filter(F.col("mode") == mode).select("runner", "entity_type", *(F.col(c).alias(f"{mode}_{c}") for c in ("tp", "fp", "fn", "precision", "recall", "f1")))
        out = out.join(side, ["runner", "entity_type"], "left")
    numbers = [c for c in out.columns if c.startswith(("exact_", "overlap_"))]
    return out.select("runner", "entity_type", "identifier_group", *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers))


def write_type_score_csv(scored: DataFrame, path: str) -> None:
    type_score_rows(scored).orderBy("runner", "entity_type").write.mode("overwrite").option("header", True).csv(path)


def write_compare_csv(compared: DataFrame, path: str) -> None:
    compared.orderBy("runner").write.mode("overwrite").option("header", True).csv(path)


def export_mappings(vault: DataFrame) -> DataFrame:
    """All mappings in the order of insertion, seven columns."""
    return vault.orderBy("mapping_id").select(*MAPPING_COLUMNS)


def export_privacy(entities: DataFrame, items: DataFrame) -> DataFrame:
    """Entity rows, then pending rows: ten columns."""
    a = entities.select("session_id", F.lit("entity").alias("kind"), "original", "entity_type", "entity_category", "pseudonym", "mode", F.format_string("%.2f", "confidence").alias("confidence"), "generalized_to", F.lit(False).alias("pending_review"))
    empty = F.lit("")
    b = items.filter("status = 'pending'").select("session_id", F.lit("pending").alias("kind"), F.col("detected_text").alias("original"), F.col("proposed_entity_type").alias("entity_type"), empty.alias("entity_category"), empty.alias("pseudonym"), empty.alias("mode"), F.format_string("%.2f", "confidence").alias("confidence"), F.lit(None).cast("string").alias("generalized_to"), F.lit(True).alias("pending_review"))
    return a.unionByName(b)


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of dataset files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row (fingerprint, rows) that doesn't depend on order or file layout."""
    return df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("fingerprint"), F.count(F.lit(1)).alias("rows"))


def verify_checksums(files: DataFrame, manifests: DataFrame, depth: int = 1) -> DataFrame:
    """files (path, sha256) against manifests (dataset_file, sha256): name, ok. A name is the last depth parts of a path."""
    name = F.array_join(F.slice(F.split("path", "/"), -depth, depth), "/")
    m = manifests.select(F.col("dataset_file").alias("name"), F.col("sha256").alias("__said"))
    return files.withColumn("name", name).join(m, "name", "left").select("name", F.col("sha256").eqNullSafe(F.col("__said")).alias("ok"))


def resolve_manifest(manifests: DataFrame, dataset_file: str, preferred: list[str]) -> DataFrame:
    """Of manifests (path, dataset_file, ...) that name the file, the one whose own name is preferred most."""
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.coalesce(F.array_position(F.array(*(F.lit(p) for p in preferred)), name), F.lit(0))
    fit = manifests.filter(F.col("dataset_file") == dataset_file).withColumn("__rank", F.when(rank == 0, 10**6).otherwise(rank))
    return fit.orderBy("__rank", "path").limit(1).drop("__rank")


def append_content(df: DataFrame, base: str, table: str) -> None:
    """Append to a table of the content store."""
    df.write.mode("append").parquet(f"{base.rstrip('/')}/{table}")


def bucket_of(session_id: str) -> Column:
    return F.pmod(F.xxhash64(session_id), F.lit(VAULT_BUCKETS)).cast("int")


def append_vault(mappings: DataFrame, base: str) -> None:
    """Append mappings to the vault, by bucket of the session, so later joins on session read what they need."""
    mappings.withColumn("bucket", bucket_of("session_id")).write.mode("append").partitionBy("bucket").parquet(f"{base.rstrip('/')}/mappings")


def read_table(spark: SparkSession, base: str, table: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{base.rstrip('/')}/{table}")
