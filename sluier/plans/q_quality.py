"""Queries of data quality, synthesis, sources and the main plan, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluier.operators import quality as Q
from sluier.operators import synth as Y
from sluier.functions.checks import bsn_valid, iban_valid
from sluier.operators.entity_types import category_of
from sluier.operators import detect as D
from sluier.plans.deidentify import deidentify, mappings_of, with_names
from sluier.plans.dossiers import DOSSIER_CTE, GOLD_CTE, dossiers, gold, labelled
from sluier.plans.q_detect import DETECTED_CTE, SQL_VALID, TYPES_CTE
from sluier.plans.q_general import _EDIT_CTE, _OUT_CTE, _RARE, TEST_KEY, _keyed_cte, sql_digest
from sluier.plans.q_review import _BASE as _REVIEW_BASE
from sluier.plans.q_review import _decided, _entities
from sluier.session import materialise, working_dir
from sluier.sources import tables as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _faulty(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Dossiers of which every 50th is there twice, labels of which some are shifted, mistyped or spoilt."""
    docs = dossiers(spark, sf_dir).select("doc_id", "text")
    docs = docs.union(docs.filter("doc_id % 50 = 0"))
    labels = gold(spark, sf_dir)
    labels = labels.select(
        "doc_id",
        F.when(F.col("doc_id") % 40 == 1, F.col("start") + 1).otherwise(F.col("start")).alias("start"),
        "end",
        F.when((F.col("entity_type") == "bsn") & (F.col("doc_id") % 30 == 2), "123456789").otherwise(F.col("text")).alias("text"),
        "entity_type",
        F.when(F.col("doc_id") % 60 == 3, "free_text").otherwise(category_of(F.col("entity_type"))).alias("category"),
    )
    return docs, labels


_FAULTY = f"""doc AS (SELECT doc_id, text FROM dossier UNION ALL SELECT doc_id, text FROM dossier WHERE doc_id % 50 = 0),
label AS (SELECT doc_id, CASE WHEN doc_id % 40 = 1 THEN "start" + 1 ELSE "start" END AS "start", "end", CASE WHEN entity_type = 'bsn' AND doc_id % 30 = 2 THEN '123456789' ELSE text END AS text, entity_type,
  CASE WHEN doc_id % 60 = 3 THEN 'free_text' ELSE category END AS category, category AS policy FROM gold JOIN types USING (entity_type)),
s AS (SELECT * FROM label),
finding AS (
  SELECT l.doc_id, 'offsets' AS "check", 'error' AS severity, l.text AS detail FROM label l JOIN doc d USING (doc_id) WHERE substr(d.text, l."start" + 1, l."end" - l."start") <> l.text
  UNION ALL SELECT doc_id, 'unique_ids', 'error', CAST(count(*) AS VARCHAR) FROM doc GROUP BY doc_id HAVING count(*) > 1
  UNION ALL SELECT doc_id, 'category', 'error', text FROM label WHERE category <> policy
  UNION ALL SELECT doc_id, 'checksum', 'error', text FROM s WHERE (entity_type = 'bsn' AND NOT {SQL_VALID['bsn']}) OR (entity_type = 'iban' AND NOT {SQL_VALID['iban']})
  UNION ALL SELECT doc_id, 'rare_code', 'warning', text FROM label WHERE entity_type = 'icd10_code' AND text IN ({_RARE}))"""
_FINDINGS = f"WITH {DOSSIER_CTE}, {GOLD_CTE}, {TYPES_CTE}, {_FAULTY} "
_ROW = 'SELECT CAST(doc_id AS VARCHAR) AS doc_id, "check", severity, detail FROM finding WHERE "check" = '


def q1_check_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.check_offsets(*_faulty(spark, sf_dir))


def q2_check_unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.check_unique_ids(_faulty(spark, sf_dir)[0])


def q3_check_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.check_category(_faulty(spark, sf_dir)[1])


def q4_check_label_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.check_label_checksums(_faulty(spark, sf_dir)[1])


def q5_warn_rare_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.warn_rare_codes(_faulty(spark, sf_dir)[1])


def q6_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.validation_report(*_faulty(spark, sf_dir))


for _name, _check in {"q1_check_offsets": "offsets", "q2_check_unique_ids": "unique_ids", "q3_check_category": "category", "q4_check_label_checksums": "checksum", "q5_warn_rare_codes": "rare_code"}.items():
    ORACLES[_name] = f"{_FINDINGS}{_ROW}'{_check}'"
ORACLES["q6_validation_report"] = f"""{_FINDINGS} SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, (SELECT count(*) FROM doc) AS records, (SELECT count(*) FROM label) AS entities, count(*) FILTER (severity = 'error') = 0 AS ok FROM finding"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dossiers cut into plain and labelled segments."""
    part = lambda text, kind=None: F.struct(text.alias("text"), F.lit(kind).cast("string").alias("entity_type"))
    parts = F.array(part(F.lit("BSN ")), part(F.col("bsn"), "bsn"), part(F.lit(", geboren ")), part(F.col("birthdate"), "birthdate"), part(F.lit(" te Zoë.")))
    return dossiers(spark, sf_dir).select("doc_id", F.posexplode(parts).alias("seq", "p")).select("doc_id", "seq", "p.text", "p.entity_type")


def y1_segments_to_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = Y.segments_to_gold(_segments(spark, sf_dir))
    return labels.join(docs.withColumnRenamed("text", "body"), "doc_id").select("doc_id", "start", "end", "text", "entity_type", (F.substring("body", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")).alias("fits"))


ORACLES["y1_segments_to_gold"] = f"""WITH {DOSSIER_CTE} SELECT doc_id, 4 AS "start", 13 AS "end", bsn AS text, 'bsn' AS entity_type, true AS fits FROM dossier
UNION ALL SELECT doc_id, 23, CAST(23 + length(birthdate) AS INT), birthdate, 'birthdate', true FROM dossier"""


def y2_render_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template for each customer; told are places and whether values fit their stretch."""
    text = F.concat(F.lit("Naam {{PERSON:"), F.col("c_name"), F.lit("}}, BSN {{BSN}}, {{AGE:93 jaar}} en {{IETS}}."))
    rows = Y.render_placeholders(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), text.alias("text")), seed=1)
    return rows.select("doc_id", F.size("gold").alias("labels"), F.forall("gold", lambda g: F.substring("text", g["start"] + 1, g["end"] - g["start"]) == g["text"]).alias("fits"), F.element_at("gold", 1)["text"].alias("name"), bsn_valid(F.element_at("gold", 2)["text"]).alias("bsn_ok"), "error")


ORACLES["y2_render_placeholders"] = "SELECT c_custkey AS doc_id, 3 AS labels, true AS fits, c_name AS name, true AS bsn_ok, CAST(NULL AS VARCHAR) AS error FROM customer"


def y3_synthetic_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part, whether its made BSN and IBAN are valid and its postcode has its form."""
    seed = F.concat(F.lit("1/"), F.col("p_partkey").cast("string"))
    value = lambda kind: Y.synthetic_value(F.lit(kind), seed)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", bsn_valid(value("bsn")).alias("bsn_ok"), iban_valid(value("iban")).alias("iban_ok"), value("postcode_pc6").rlike("^[1-9][0-9]{3} [A-Z]{2}$").alias("postcode_ok"), value("diagnosis").isNull().alias("no_diagnosis"))


ORACLES["y3_synthetic_values"] = "SELECT p_partkey, true AS bsn_ok, true AS iban_ok, true AS postcode_ok, true AS no_diagnosis FROM part"


def y4_expected_generalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold(spark, sf_dir).select("doc_id", "start", Y.expected_generalisation(F.col("entity_type"), F.col("text")).alias("form"))


ORACLES["y4_expected_generalisation"] = f"""WITH {DOSSIER_CTE}, {GOLD_CTE} SELECT doc_id, "start", CASE WHEN entity_type = 'birthdate' THEN split_part(text, '-', 3) WHEN entity_type = 'postcode_pc6' THEN substr(text, 1, 2)
WHEN entity_type = 'age' AND CAST(regexp_extract(text, '[0-9]+') AS INT) >= 90 THEN '90+ jaar' WHEN entity_type IN ('admission_date', 'discharge_date', 'exam_date') THEN split_part(text, '-', 3) || '-' || lpad(split_part(text, '-', 2), 2, '0') END AS form FROM gold"""


def _mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each customer, a third adversarial; its text names the customer and the scenario."""
    customers = Y.numbered(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal"), "c_custkey")
    mix = Y.scenario_mix(spark, customers.count(), 0.3, ["basis", "contact", "leeftijd"], ["ongeldig", "adres"])
    text = F.concat_ws(" ", F.lit("Naam"), "c_name", F.lit("geval"), "scenario", F.when(F.col("c_acctbal") < 0, "schuld"))
    return customers.join(mix, "i").select("c_custkey", "i", "difficulty", "scenario", text.alias("text"))


def y5_scenario_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)


_MIX = """SELECT c_custkey, i, CASE WHEN i < n - h THEN 'normal' ELSE 'adversarial' END AS difficulty, scenario, 'Naam ' || c_name || ' geval ' || scenario || CASE WHEN c_acctbal < 0 THEN ' schuld' ELSE '' END AS text FROM (
  SELECT *, CASE WHEN i < n - h THEN (['basis', 'contact', 'leeftijd'])[i % 3 + 1] ELSE (['ongeldig', 'adres'])[(i - (n - h)) % 2 + 1] END AS scenario
  FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer), (SELECT count(*) AS n, CAST(ceil(count(*) * CAST(0.3 AS DOUBLE)) AS BIGINT) AS h FROM customer))"""
ORACLES["y5_scenario_mix"] = _MIX


def y6_difficulty_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.difficulty_subset(_mix(spark, sf_dir), "adversarial")


ORACLES["y6_difficulty_subset"] = f"SELECT * FROM ({_MIX}) WHERE difficulty = 'adversarial'"


# -- sources and sinks -------------------------------------------------------------------------


def _path(spark: SparkSession, name: str) -> str:
    return f"{working_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity = lambda x: F.struct(x["start"], x["end"], x["text"], x["entity_type"].alias("type"), category_of(x["entity_type"]).alias("category"), F.lit("").alias("note"))
    entities = F.array_sort(F.transform("labels", entity)).alias("entities")
    return labelled(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("prompt"), entities, F.lit(0).alias("seed"), F.lit("dossier").alias("scenario"), F.lit("normal").alias("difficulty"))


def s1_read_labelled_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON lines, some spoilt, and read back."""
    path = _path(spark, "labelled")
    rows = _records(spark, sf_dir)
    spoilt = F.col("id").cast("long") % 20 == 0
    T.write_labelled_jsonl(rows.withColumn("prompt", F.when(spoilt, F.concat(F.lit("x"), F.col("prompt"))).otherwise(F.col("prompt"))), path)
    good, bad = T.read_labelled_jsonl(spark, path)
    return good.select("id", F.size("entities").alias("entities"), F.lit(None).cast("string").alias("reason")).unionByName(bad.select("id", F.lit(0).alias("entities"), "reason"))


ORACLES["s1_read_labelled_jsonl"] = f"WITH {DOSSIER_CTE} SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 20 = 0 THEN 0 ELSE 18 END AS entities, CASE WHEN doc_id % 20 = 0 THEN 'offsets' END AS reason FROM dossier"


def s2_write_labelled_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "labelled")
    T.write_labelled_jsonl(_records(spark, sf_dir), path)
    back = spark.read.schema(T.RECORD).json(path)
    return back.select("id", F.sha2("prompt", 256).alias("prompt_sha256"), F.size("entities").alias("entities"))


ORACLES["s2_write_labelled_jsonl"] = f"WITH {DOSSIER_CTE} SELECT CAST(doc_id AS VARCHAR) AS id, sha256(text) AS prompt_sha256, 18 AS entities FROM dossier"


def s3_write_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested report of labels by type, written and read back."""
    path = _path(spark, "report")
    n = gold(spark, sf_dir).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
    T.write_report_json(n.groupBy().agg(F.array_sort(F.collect_list(F.struct("entity_type", "n"))).alias("types")), path)
    return spark.read.schema("types array<struct<entity_type:string,n:bigint>>").json(path).select(F.explode("types").alias("t")).select("t.*")


ORACLES["s3_write_report_json"] = f"WITH {DOSSIER_CTE}, {GOLD_CTE} SELECT entity_type, count(*) AS n FROM gold GROUP BY 1"


def s5_write_compare_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a runner, written as CSV and read back."""
    path = _path(spark, "compare")
    runs = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("runner")).agg(F.count(F.lit(1)).alias("runs"), F.countDistinct("user_id").alias("users"))
    T.write_compare_csv(runs, path)
    return spark.read.schema("runner string, runs bigint, users bigint").option("header", True).csv(path)


ORACLES["s5_write_compare_csv"] = "SELECT event_type AS runner, count(*) AS runs, count(DISTINCT user_id) AS users FROM events GROUP BY 1"


def s6_export_mappings_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    vault = _entities(spark, sf_dir).select(F.col("item_id").alias("mapping_id"), "session_id", "pseudonym", "original", "entity_type", category_of(F.col("entity_type")).alias("entity_category"), F.col("mode").alias("pseudonymization_mode"), F.lit("2024-01-01").alias("created_at"))
    return T.export_mappings(vault)


_ENTITY = """SELECT event_id AS item_id, 'u' || user_id AS session_id, event_type || CAST(event_id % 9 AS VARCHAR) AS original, CASE event_id % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'org' ELSE 'location' END AS entity_type,
  '[' || event_id || ']' AS pseudonym, CASE WHEN event_id % 3 = 0 THEN 'two_way' ELSE 'one_way' END AS mode, CASE WHEN event_id % 3 = 0 THEN 'direct_identifier' ELSE 'quasi_identifier' END AS entity_category FROM events WHERE event_id % 2 = 0"""
ORACLES["s6_export_mappings_csv"] = f"SELECT session_id, pseudonym, original, entity_type, entity_category, mode AS pseudonymization_mode, '2024-01-01' AS created_at FROM ({_ENTITY})"


def s7_export_privacy_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = _entities(spark, sf_dir).withColumns({"entity_category": category_of(F.col("entity_type")), "confidence": F.lit(1.0), "generalized_to": F.lit(None).cast("string")})
    return T.export_privacy(entities, _decided(spark, sf_dir))


_PENDING = """SELECT session_id, 'pending' AS kind, detected_text AS original, proposed_entity_type AS entity_type, '' AS entity_category, '' AS pseudonym, '' AS mode, printf('%.2f', confidence) AS confidence, CAST(NULL AS VARCHAR) AS generalized_to, true AS pending_review FROM decided WHERE status = 'pending'"""
ORACLES["s7_export_privacy_csv"] = f"""WITH {_REVIEW_BASE} SELECT session_id, 'entity' AS kind, original, entity_type, entity_category, pseudonym, mode, '1.00' AS confidence, CAST(NULL AS VARCHAR) AS generalized_to, false AS pending_review FROM ({_ENTITY}) UNION ALL {_PENDING}"""


def s8_dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of four tables by their fingerprints; the fingerprint itself must not depend on the layout."""
    told = []
    for name in ("orders", "customer", "events", "documents"):
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        a, b = T.table_fingerprint(table), T.table_fingerprint(table.repartition(7)).select(F.col("fingerprint").alias("again"))
        told.append(a.crossJoin(b).select(F.lit(name).alias("name"), "rows", (F.col("fingerprint") == F.col("again")).alias("stable")))  # one row each
    return told[0].unionByName(told[1]).unionByName(told[2]).unionByName(told[3])


ORACLES["s8_dataset_fingerprint"] = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows, true AS stable FROM {t}" for t in ("orders", "customer", "events", "documents"))


def s8_verify_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON lines, a file for each status, against a manifest of their digests in which that of `P` is wrong."""
    path = _path(spark, "dataset")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("status", F.col("o_orderstatus"))
    orders.repartition("status").write.partitionBy("status").json(path)
    files = T.file_fingerprints(spark, f"{path}/*").withColumn("status", F.regexp_extract("path", "status=([^/]*)/", 1))
    said = F.when(F.col("status") == "P", F.reverse("sha256")).otherwise(F.col("sha256"))
    name = F.array_join(F.slice(F.split("path", "/"), -2, 2), "/")
    told = T.verify_checksums(files.select("path", "sha256"), files.select(name.alias("dataset_file"), said.alias("sha256")), depth=2)
    rows = spark.read.schema("o_orderkey bigint, status string").json(path).groupBy("status").agg(F.count(F.lit(1)).alias("rows"))
    return told.select(F.regexp_extract("name", "status=([^/]*)/", 1).alias("status"), "ok").join(rows, "status").select("status", "rows", "ok")


ORACLES["s8_verify_manifest"] = "SELECT o_orderstatus AS status, count(*) AS rows, o_orderstatus <> 'P' AS ok FROM orders GROUP BY 1"


def s9_resolve_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's manifest names a dataset; of several the preferred name wins."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("/m/"), F.col("s_suppkey").cast("string"), F.lit(".json")).alias("path"), F.concat(F.lit("set"), (F.col("s_suppkey") % 3).cast("string"), F.lit(".jsonl")).alias("dataset_file"))
    return T.resolve_manifest(rows, "set1.jsonl", ["manifest.json", "7.json", "4.json"])


ORACLES["s9_resolve_manifest"] = "SELECT '/m/7.json' AS path, 'set1.jsonl' AS dataset_file FROM supplier WHERE s_suppkey = 7"


def s10_table_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings written to the vault by bucket and read back."""
    base = _path(spark, "vault")
    T.append_vault(_entities(spark, sf_dir).select("session_id", "original", "entity_type", "pseudonym", "mode"), base)
    back = T.read_table(spark, base, "mappings", "session_id string, original string, entity_type string, pseudonym string, mode string, bucket int")
    return back.groupBy("session_id").agg(F.count(F.lit(1)).alias("mappings"), F.count_distinct("bucket").alias("buckets"))


ORACLES["s10_table_io"] = f"SELECT session_id, count(*) AS mappings, CAST(1 AS BIGINT) AS buckets FROM ({_ENTITY}) GROUP BY 1"


# -- the main plan -----------------------------------------------------------------------------


def w1_deidentify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detect (patterns only), generalise and replace over all dossiers; the whole plan is w3_deidentify_names."""
    done = deidentify(dossiers(spark, sf_dir).select("doc_id", "session_id", "text"), TEST_KEY)
    return done.select("doc_id", F.size("general_spans").alias("n_spans"), "outbound_text")


_W1 = f"""WITH {DOSSIER_CTE}, {DETECTED_CTE}, gold AS (SELECT d.doc_id, session_id, s.start AS "start", s."end" AS "end", s.text AS text, s.kind AS entity_type, k FROM detected d JOIN dossier USING (doc_id)),
{_EDIT_CTE}, {TYPES_CTE}, {_keyed_cte(TEST_KEY)}"""
ORACLES["w1_deidentify"] = f"{_W1}, {_OUT_CTE} SELECT doc_id, CAST(n AS INT) AS n_spans, outbound_text FROM outbound"
ORACLES["w1_mappings"] = f"""{_W1} SELECT session_id, original, entity_type, pseudonym, 'one_way' AS mode, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, original, entity_type ORDER BY doc_id, "start") AS rn FROM named) WHERE rn = 1"""


def w1_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = deidentify(dossiers(spark, sf_dir).select("doc_id", "session_id", "text"), TEST_KEY)
    return mappings_of(materialise(done.select("doc_id", "session_id", "held", "general_spans"), "deidentified")).select("session_id", "original", "entity_type", "pseudonym", "mode", "doc_id")


# The whole plan: names are a second layer, and a doubtful find holds its document until the review is done.


def _layers(docs: DataFrame) -> DataFrame:
    """Names after roles, and in every tenth dossier a doubtful find (`Dossier` as an organisation) that must wait for review."""
    doubtful = F.array(F.struct(F.lit(0).alias("start"), F.lit(7).alias("end"), F.lit("Dossier").alias("original"), F.lit("org").alias("entity_type"), F.lit(0.5).alias("confidence"), F.lit("deduce").alias("layer"))).cast(D.SPANS)
    rows = with_names(docs)
    return rows.withColumn("layer_2", F.when(F.col("doc_id").cast("bigint") % 10 == 3, F.concat("layer_2", doubtful)).otherwise(F.col("layer_2")))


def w3_deidentify_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layers, routing, generalisation and replacing over all dossiers."""
    done = deidentify(_layers(dossiers(spark, sf_dir).select("doc_id", "session_id", "text")), TEST_KEY, extra_spans="layer_2")
    return done.select("doc_id", F.size("general_spans").alias("n_spans"), F.size("pending").alias("n_pending"), "held", "outbound_text")


def w4_mappings_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New vault rows of the documents that are not held."""
    done = deidentify(_layers(dossiers(spark, sf_dir).select("doc_id", "session_id", "text")), TEST_KEY, extra_spans="layer_2")
    return mappings_of(materialise(done.select("doc_id", "session_id", "held", "general_spans"), "deidentified")).select("session_id", "original", "entity_type", "pseudonym", "mode", "doc_id")


_W3 = f"""WITH {DOSSIER_CTE}, {DETECTED_CTE}, {GOLD_CTE.replace("gold AS", "every_gold AS")}, gold AS (SELECT d.doc_id, session_id, s.start AS "start", s."end" AS "end", s.text AS text, s.kind AS entity_type, k FROM detected d JOIN dossier USING (doc_id)
  UNION ALL SELECT doc_id, session_id, "start", "end", text, entity_type, k FROM every_gold WHERE entity_type = 'name'),
{_EDIT_CTE}, {TYPES_CTE}, {_keyed_cte(TEST_KEY)}"""
ORACLES["w3_deidentify_names"] = f"{_W3}, {_OUT_CTE} SELECT doc_id, CAST(n AS INT) AS n_spans, CAST(doc_id % 10 = 3 AS INT) AS n_pending, doc_id % 10 = 3 AS held, CASE WHEN doc_id % 10 <> 3 THEN outbound_text END AS outbound_text FROM outbound"
ORACLES["w4_mappings_names"] = f"""{_W3} SELECT session_id, original, entity_type, pseudonym, 'one_way' AS mode, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, original, entity_type ORDER BY doc_id, "start") AS rn FROM named WHERE doc_id % 10 <> 3) WHERE rn = 1"""


def t1_stream_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dossiers arrive as files and are processed in micro-batches; told is what was written."""
    from sluier.streaming.pipeline import run

    base = _path(spark, "stream")
    dossiers(spark, sf_dir).select("doc_id", "session_id", "text").write.json(f"{base}/in")
    run(spark, f"{base}/in", f"{base}/content", f"{base}/vault", f"{base}/checkpoint", TEST_KEY).awaitTermination()
    return spark.read.parquet(f"{base}/content/documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "session_id", "held")


ORACLES["t1_stream_pipeline"] = f"WITH {DOSSIER_CTE} SELECT doc_id, session_id, false AS held FROM dossier"


def t3_stream_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream with doubtful finds: documents that wait, and their review items."""
    from sluier.streaming.pipeline import content_table, run

    base = _path(spark, "stream_review")
    dossiers(spark, sf_dir).select("doc_id", "session_id", "text").write.json(f"{base}/in")
    run(spark, f"{base}/in", f"{base}/content", f"{base}/vault", f"{base}/checkpoint", TEST_KEY, _layers).awaitTermination()
    items = content_table(spark, f"{base}/content", "review").read_all().groupBy("session_id").agg(F.count(F.lit(1)).alias("items"))
    told = spark.read.parquet(f"{base}/content/documents").groupBy("session_id").agg(F.count_if("held").alias("held"), F.count("outbound_text").alias("sent"))
    return told.join(items, "session_id", "left").select("session_id", "held", "sent", F.coalesce("items", F.lit(0).cast("bigint")).alias("items"))


ORACLES["t3_stream_review"] = f"WITH {DOSSIER_CTE} SELECT session_id, CAST(count(*) FILTER (doc_id % 10 = 3) AS BIGINT) AS held, count(*) FILTER (doc_id % 10 <> 3) AS sent, count(*) FILTER (doc_id % 10 = 3) AS items FROM dossier GROUP BY 1"


def t2_stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream with doubtful finds, then decisions about two thirds of them: what was sent for each document, and how often."""
    from sluier.streaming.pipeline import content_table, run

    base = _path(spark, "stream_resume")
    dossiers(spark, sf_dir).select("doc_id", "session_id", "text").write.json(f"{base}/in")
    stream = lambda: run(spark, f"{base}/in", f"{base}/content", f"{base}/vault", f"{base}/checkpoint", TEST_KEY, _layers, f"{base}/decisions").awaitTermination()
    decision = "item_id bigint, session_id string, decided_at timestamp, status string, entity_type string"
    spark.createDataFrame([], decision).write.json(f"{base}/decisions")
    stream()
    turn = F.floor(F.col("doc_id").cast("bigint") / 10) % 3
    items = content_table(spark, f"{base}/content", "review").read_all().filter(turn < 2)
    told = items.select("item_id", "session_id", F.lit("2024-01-01").cast("timestamp").alias("decided_at"), F.when(turn == 0, "accepted").otherwise("rejected").alias("status"), F.lit(None).cast("string").alias("entity_type"))
    told.write.mode("append").json(f"{base}/decisions")
    stream()
    sent = spark.read.parquet(f"{base}/content/documents").filter("not held").select("doc_id", "session_id", "outbound_text").unionByName(content_table(spark, f"{base}/content", "released").read_all().drop("batch"))
    return sent.groupBy(F.col("doc_id").cast("bigint").alias("doc_id"), "session_id").agg(F.count(F.lit(1)).alias("times"), F.sha2(F.min("outbound_text"), 256).alias("outbound_sha256"))


ORACLES["t2_stream_resume"] = f"""{_W3}, {_OUT_CTE}, turn AS (SELECT doc_id, session_id, (doc_id // 10) % 3 AS turn FROM dossier WHERE doc_id % 10 = 3),
open AS (SELECT session_id, count(*) FILTER (turn = 2) AS waiting, count(*) FILTER (turn = 1) AS rejected FROM turn GROUP BY 1),
accepted AS (SELECT session_id, '[ORG-' || substr({sql_digest('skey', "'org:Dossier'")}, 1, 6) || ']' AS token FROM keyed)
SELECT o.doc_id, o.session_id, CAST(1 AS BIGINT) AS times, sha256(CASE WHEN o.doc_id % 10 = 3 AND rejected = 0 THEN token || substr(outbound_text, 8) ELSE outbound_text END) AS outbound_sha256
FROM outbound o JOIN accepted USING (session_id) LEFT JOIN open USING (session_id) WHERE o.doc_id % 10 <> 3 OR waiting = 0"""


def t4_stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit rows that the stream wrote, by session."""
    from sluier.streaming.pipeline import run

    base = _path(spark, "stream_audit")
    dossiers(spark, sf_dir).select("doc_id", "session_id", "text").write.json(f"{base}/in")
    run(spark, f"{base}/in", f"{base}/content", f"{base}/vault", f"{base}/checkpoint", TEST_KEY, _layers).awaitTermination()
    return spark.read.parquet(f"{base}/content/audit").groupBy("session_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("review_required").alias("held"), F.count("error").alias("errors"), F.min("avg_confidence").alias("least"))


ORACLES["t4_stream_audit"] = f"""{_W3}, {_OUT_CTE} SELECT session_id, count(*) AS rows, count(*) FILTER (doc_id % 10 = 3) AS held, CAST(0 AS BIGINT) AS errors, min(CAST(round((n - 2 + 2 * 0.85) / n, 6) AS DOUBLE)) AS least FROM outbound GROUP BY 1"""

QUERIES |= {name: f for name, f in globals().items() if callable(f) and name[0] in "qystw" and name[1].isdigit()}
