"""Queries of checks, detection, layers and routing, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluier.functions import checks as C
from sluier.functions import spans as S
from sluier.functions.tables import register
from sluier.operators import dates, payload
from sluier.operators import detect as D
from sluier.operators import entity_types as T
from sluier.plans.dossiers import DOSSIER_CTE, GOLD_CTE, dossiers, gold


def sql_scan(text: str, pattern: str, more: str = "", keep: str = "") -> str:
    """SQL for a list of (start, end, text) of all matches of a pattern; more: further fields; keep: a condition on the list element s."""
    p = pattern.replace("'", "''")
    field = lambda to: f"CAST(coalesce(list_sum([length(x) for x in g[1:i]]), 0) + coalesce(list_sum([length(x) for x in m[1:{to}]]), 0) AS INT)"
    listed = f"[{{{more}'start': {field('i - 1')}, 'end': {field('i')}, 'text': m[i]}} for i in range(1, len(m) + 1)]"
    listed = f"list_filter({listed}, lambda s: {keep})" if keep else listed
    return f"(SELECT {listed} FROM (SELECT regexp_extract_all({text}, '{p}') AS m, regexp_split_to_array({text}, '{p}') AS g))"


def sql_bsn(x: str) -> str:
    total = " + ".join(f"CAST(substr({x}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate([9, 8, 7, 6, 5, 4, 3, 2, -1]))
    return f"(({total}) <> 0 AND ({total}) % 11 = 0)"


def sql_iban(x: str) -> str:
    """Checked for the one bank that occurs in dossiers."""
    return f"(substr({x}, 5, 4) = 'BANK' AND CAST('11102320' || substr({x}, 9, 10) || '2321' || substr({x}, 3, 2) AS HUGEINT) % 97 = 1)"


SQL_VALID = {"bsn": sql_bsn("s.text"), "iban": sql_iban("s.text")}
SLUGS = {"email": "d2_detect_email", "iban": "d3_detect_iban", "bsn": "d4_detect_bsn", "address": "d5_detect_address", "postcode_pc6": "d6_detect_postcode6", "phone": "d7_detect_phone", "kenteken": "d8_detect_plate", "mrn": "d9_detect_mrn", "epd_id": "d9_detect_epd", "icd10_code": "d10_detect_icd10", "project": "d11_detect_project", "age": "d12_detect_age", "birthdate": "d13_detect_birthdate"}

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _rows(found: DataFrame) -> DataFrame:
    return found.select("doc_id", S.each("s").alias("s")).filter("s is not null").select("doc_id", "s.start", "s.end", F.col("s.text").alias("original"))


def _one_type(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(dossiers(spark, sf_dir).select("doc_id", D.of_type(F.col("text"), kind).alias("s")))


for _kind, _pattern in D.PATTERNS:
    QUERIES[SLUGS[_kind]] = partial(_one_type, _kind)
    ORACLES[SLUGS[_kind]] = f"""WITH {DOSSIER_CTE}, found AS (SELECT doc_id, unnest({sql_scan('text', _pattern, keep=SQL_VALID.get(_kind, ''))}) AS s FROM dossier)
SELECT doc_id, s.start AS "start", s."end" AS "end", s.text AS original FROM found"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def d1_scan_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_documents(spark, sf_dir).select("doc_id", S.scan(F.col("text"), r"[A-Za-z]+[0-9][A-Za-z0-9]*").alias("s")))


ORACLES["d1_scan_pattern"] = f"""WITH found AS (SELECT doc_id, unnest({sql_scan("coalesce(text, '')", '[A-Za-z]+[0-9][A-Za-z0-9]*')}) AS s FROM documents)
SELECT doc_id, s.start AS "start", s."end" AS "end", s.text AS original FROM found"""


def d1_scan_spans_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a table function, called from SQL."""
    register(spark)
    sql = "SELECT doc_id, s.start, s.end, s.text AS original FROM {docs} AS d, LATERAL scan_spans(d.text, '[A-Za-z]+[0-9][A-Za-z0-9]*') AS s"
    return spark.sql(sql, docs=_documents(spark, sf_dir))


ORACLES["d1_scan_spans_table"] = ORACLES["d1_scan_pattern"]


def d2_detect_email_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_documents(spark, sf_dir).select("doc_id", D.of_type(F.col("text"), "email").alias("s")))


_SQL_EMAIL = r"[\p{L}\p{N}_][\p{L}\p{N}_.+-]*@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}"
ORACLES["d2_detect_email_documents"] = f"""WITH found AS (SELECT doc_id, unnest({sql_scan("coalesce(text, '')", _SQL_EMAIL)}) AS s FROM documents)
SELECT doc_id, s.start AS "start", s."end" AS "end", s.text AS original FROM found"""


def d14_detect_context_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dossiers(spark, sf_dir).select("doc_id", S.each(dates.context_dates(F.col("text"))).alias("s")).filter("s is not null")
    return found.select("doc_id", "s.start", "s.end", F.col("s.text").alias("original"), "s.entity_type")


# Written by hand from the wording of the dossiers, not from the cue table.
_WORDED = [("admission_date", "Opgenomen op |Patiënt werd op |Opnamedatum: |Geplande opname op "), ("discharge_date", "Verwachte ontslagdatum: |Ontslagen op |Ontslag naar huis op "), ("exam_date", "MRI-scan op |Bloedafname op ")]
_SQL_DATE = r"\d{1,2}[-/]\d{1,2}[-/]\d{4}"


def _sql_date_type(start: str, text: str = "text") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(substr({text}, 1, {start}), '({leads})$') THEN '{kind}'" for kind, leads in _WORDED) + " END"


_DATED = f"""dated AS (SELECT doc_id, s.start AS "start", s."end" AS "end", s.text AS original, {_sql_date_type('s.start', 'body')} AS entity_type
  FROM (SELECT doc_id, text AS body, unnest({sql_scan('text', _SQL_DATE)}) AS s FROM dossier))"""
ORACLES["d14_detect_context_dates"] = f"""WITH {DOSSIER_CTE}, {_DATED} SELECT * FROM dated WHERE entity_type IS NOT NULL"""


def d15_resolve_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.exploded(D.detect(dossiers(spark, sf_dir))).select("doc_id", "seq", "start", "end", "original", "entity_type", "confidence", "layer")


_ALL = " || ".join(
    [f"coalesce(list_filter(list_transform({sql_scan('text', _SQL_DATE)}, lambda s: {{'rank': 0, 'start': s.start, 'end': s.\"end\", 'text': s.text, 'kind': {_sql_date_type('s.start')}}}), lambda s: s.kind IS NOT NULL), [])"]
    + [f"list_transform({sql_scan('text', p, keep=SQL_VALID.get(k, ''))}, lambda s: {{'rank': {i + 1}, 'start': s.start, 'end': s.\"end\", 'text': s.text, 'kind': '{k}'}})" for i, (k, p) in enumerate(D.PATTERNS)]
)
DETECTED_CTE = f"""claim AS (SELECT doc_id, list_sort({_ALL}) AS every FROM dossier),
kept AS (SELECT doc_id, list_reduce(list_transform(every, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.start < x[1]."end" AND x[1].start < y."end")) > 0 THEN a ELSE a || x END) AS spans FROM claim WHERE len(every) > 0),
detected AS (SELECT doc_id, unnest(spans) AS s FROM kept)"""
ORACLES["d15_resolve_claims"] = f"""WITH {DOSSIER_CTE}, {DETECTED_CTE}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s.start) - 1 AS INT) AS seq, s.start AS "start", s."end" AS "end", s.text AS original, s.kind AS entity_type, CAST(1.0 AS DOUBLE) AS confidence, 'regex' AS layer FROM detected"""


def d16_detector_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers that can find each type, beside how many labels of the type there are."""
    n = gold(spark, sf_dir).groupBy("entity_type").agg(F.count(F.lit(1)).alias("labels"))
    return T.detector_coverage(spark).join(n, "entity_type", "left").select("entity_type", F.array_join("layers", ",").alias("layers"), F.coalesce("labels", F.lit(0)).alias("labels"))


_TYPE_ROWS = ", ".join(f"('{t}', '{c}', '{code}', '{','.join(sorted(layers, key=lambda x: T.LAYERS[x]))}')" for t, c, code, layers in T.ENTITY_TYPES)
TYPES_CTE = f"types(entity_type, category, code, layers) AS (VALUES {_TYPE_ROWS})"
ORACLES["d16_detector_coverage"] = f"""WITH {DOSSIER_CTE}, {GOLD_CTE}, {TYPES_CTE} SELECT entity_type, layers, CAST(coalesce(labels, 0) AS BIGINT) AS labels FROM types LEFT JOIN (SELECT entity_type, count(*) AS labels FROM gold GROUP BY 1) USING (entity_type)"""


def p9_derive_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.derive_category(gold(spark, sf_dir).select("doc_id", "start", "entity_type"))


ORACLES["p9_derive_category"] = f"""WITH {DOSSIER_CTE}, {GOLD_CTE}, {TYPES_CTE}
SELECT doc_id, "start", entity_type, category, code, CASE WHEN category = 'direct_identifier' THEN 'direct' ELSE 'indirect' END AS identifier_group FROM gold JOIN types USING (entity_type)"""


def c1_bsn_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dossiers(spark, sf_dir).select("doc_id", "bsn", C.bsn_valid(F.col("bsn")).alias("valid"))


ORACLES["c1_bsn_valid"] = f"WITH {DOSSIER_CTE} SELECT doc_id, bsn, {sql_bsn('bsn')} AS valid FROM dossier"


def c2_iban_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third account number is spoilt in its last digit."""
    value = F.when(F.col("k") % 3 == 0, F.concat(F.substring("iban", 1, 17), ((F.substring("iban", 18, 1).cast("int") + 1) % 10).cast("string"))).otherwise(F.col("iban"))
    return dossiers(spark, sf_dir).select("doc_id", value.alias("iban")).withColumn("valid", C.iban_valid(F.col("iban")))


ORACLES["c2_iban_valid"] = f"""WITH {DOSSIER_CTE}, v AS (SELECT doc_id, CASE WHEN k % 3 = 0 THEN substr(iban, 1, 17) || CAST((CAST(substr(iban, 18, 1) AS INT) + 1) % 10 AS VARCHAR) ELSE iban END AS iban FROM dossier)
SELECT doc_id, iban, {sql_iban('iban')} AS valid FROM v"""


def c3_icd_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dossiers(spark, sf_dir).select("doc_id", C.icd_normalise(F.concat(F.lit("  "), F.lower("code"), F.lit(" "))).alias("code"))


ORACLES["c3_icd_normalise"] = f"WITH {DOSSIER_CTE} SELECT doc_id, upper(trim('  ' || lower(code) || ' ')) AS code FROM dossier"


def c4_date_triplet(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat_ws("-", (F.col("k") % 34).cast("string"), (F.col("k") % 14).cast("string"), (F.lit(1890) + F.col("k") % 230).cast("string"))
    return dossiers(spark, sf_dir).select("doc_id", value.alias("value")).withColumn("d", C.date_triplet(F.col("value"))).select("doc_id", "value", "d.day", "d.month", "d.year")


ORACLES["c4_date_triplet"] = f"""WITH {DOSSIER_CTE}, v AS (SELECT doc_id, k, CAST(k % 34 AS INT) AS d, CAST(k % 14 AS INT) AS m, CAST(1890 + k % 230 AS INT) AS y FROM dossier)
SELECT doc_id, d || '-' || m || '-' || y AS value, CASE WHEN ok THEN d END AS day, CASE WHEN ok THEN m END AS month, CASE WHEN ok THEN y END AS year
FROM (SELECT *, d BETWEEN 1 AND 31 AND m BETWEEN 1 AND 12 AND y BETWEEN 1900 AND 2100 AS ok FROM v)"""


def _layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dossiers with layer 1 (emails, dates of birth, BSN), layer 2 (doctor's name, and a wrong name over the mail address) and layer 3 (project)."""
    docs = dossiers(spark, sf_dir)
    text = F.col("text")
    span = lambda s, kind, conf, layer: F.transform(s, lambda x: F.struct(x["start"], x["end"], x["text"].alias("original"), F.lit(kind).alias("entity_type"), conf.alias("confidence"), F.lit(layer).alias("layer"))).cast(D.SPANS)
    conf = F.lit(0.5) + (F.col("k") % 6) / 10
    one = F.concat(*(span(D.of_type(text, t), t, F.lit(1.0), "regex") for t in ("email", "bsn")))
    two = F.concat(span(S.scan(text, r"(?:Huisarts|dochter|mail)[: ]+[A-Za-z0-9]+"), "name", conf, "deduce"))
    three = span(D.of_type(text, "project"), "project", conf, "llm")
    return docs.select("doc_id", one.alias("l1"), two.alias("l2"), three.alias("l3"))


_LAYER_CTE = f"""layered AS (
  SELECT doc_id, list_transform({sql_scan('text', dict(D.PATTERNS)['email'])}, lambda s: {{'n': 0, 'start': s.start, 'end': s."end", 'original': s.text, 'kind': 'email', 'conf': CAST(1.0 AS DOUBLE), 'layer': 'regex'}})
    || list_transform({sql_scan('text', dict(D.PATTERNS)['bsn'], keep=SQL_VALID['bsn'])}, lambda s: {{'n': 0, 'start': s.start, 'end': s."end", 'original': s.text, 'kind': 'bsn', 'conf': CAST(1.0 AS DOUBLE), 'layer': 'regex'}}) AS l1,
    list_transform({sql_scan('text', '(?:Huisarts|dochter|mail)[: ]+[A-Za-z0-9]+')}, lambda s: {{'n': 1, 'start': s.start, 'end': s."end", 'original': s.text, 'kind': 'name', 'conf': CAST(0.5 AS DOUBLE) + (k % 6) / 10, 'layer': 'deduce'}}) AS l2,
    list_transform({sql_scan('text', dict(D.PATTERNS)['project'])}, lambda s: {{'n': 2, 'start': s.start, 'end': s."end", 'original': s.text, 'kind': 'project', 'conf': CAST(0.5 AS DOUBLE) + (k % 6) / 10, 'layer': 'llm'}}) AS l3
  FROM dossier),
merged AS (SELECT doc_id, unnest(l1 || list_filter(l2, lambda x: len(list_filter(l1, lambda y: y.start < x."end" AND x.start < y."end")) = 0)
  || list_filter(l3, lambda x: len(list_filter(l1 || l2, lambda y: y.start < x."end" AND x.start < y."end")) = 0)) AS s FROM layered)"""


def l3_merge_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _layered(spark, sf_dir).select("doc_id", D.merge_layers(F.col("l1"), F.col("l2"), F.col("l3")).alias("spans"))
    return D.exploded(merged).select("doc_id", "start", "end", "original", "entity_type", F.round("confidence", 3).alias("confidence"), "layer")


_MERGED = """SELECT doc_id, s.start AS "start", s."end" AS "end", s.original AS original, s.kind AS entity_type, round(s.conf, 3) AS confidence, s.layer AS layer"""
ORACLES["l3_merge_layers"] = f"WITH {DOSSIER_CTE}, {_LAYER_CTE} {_MERGED} FROM merged"


def l4_route_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l3_merge_layers(spark, sf_dir).withColumn("route", D.route(F.col("layer"), F.col("entity_type"), F.col("confidence")))


ORACLES["l4_route_by_threshold"] = f"""WITH {DOSSIER_CTE}, {_LAYER_CTE}, m AS ({_MERGED} FROM merged)
SELECT *, CASE WHEN confidence >= CASE WHEN layer = 'regex' THEN 1.0 WHEN layer = 'llm' THEN 0.7 WHEN entity_type = 'name' THEN 0.85 ELSE 1.0 END THEN 'confident' ELSE 'pending' END AS route FROM m"""


def l5_layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.layer_counts(l3_merge_layers(spark, sf_dir))


ORACLES["l5_layer_counts"] = f"WITH {DOSSIER_CTE}, {_LAYER_CTE} SELECT s.layer AS layer, s.kind AS entity_type, count(*) AS finds FROM merged GROUP BY 1, 2"


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies about each dossier: a project, a name in other case, an unknown type, a text that isn't there, elements and fields of odd kinds; every 5th is broken."""
    entities = F.concat(F.lit('{"entities":[1,{"text":"'), F.col("project"), F.lit('","type":"Project","confidence":0.9},null,{"text":"'), F.upper("doctor"), F.lit('","type":"NAME","confidence":"?"},"los",{"text":"x","type":"thing"},{"text":5,"type":"name"},[{"text":"'), F.col("project"), F.lit('"}],{"text":"nergens","type":"product","confidence":7}]}'))
    return dossiers(spark, sf_dir).select("doc_id", "text", F.when(F.col("k") % 5 == 0, F.lit('{"entities": 3')).otherwise(entities).alias("payload"))


def l1_parse_model_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.parse_payload(_payloads(spark, sf_dir))


ORACLES["l1_parse_model_payload"] = f"""WITH {DOSSIER_CTE}, e AS (
  SELECT doc_id, text, project AS find, 'project' AS entity_type, CAST(0.9 AS DOUBLE) AS confidence FROM dossier WHERE k % 5 <> 0
  UNION ALL SELECT doc_id, text, upper(doctor), 'name', CAST(0.7 AS DOUBLE) FROM dossier WHERE k % 5 <> 0)
SELECT doc_id, CAST(instr(lower(text), lower(find)) - 1 AS INT) AS "start", CAST(instr(lower(text), lower(find)) - 1 + length(find) AS INT) AS "end", substr(text, instr(lower(text), lower(find)), length(find)) AS original, entity_type, confidence
FROM e WHERE instr(lower(text), lower(find)) > 0"""


def l2_repair_model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies wrapped in think tags and fences, some cut in their array."""
    whole = F.concat(F.lit('{"entities":[{"text":"'), F.col("project"), F.lit('","type":"project"},{"text":"b","type":"name"}]}'))
    reply = F.when(F.col("k") % 3 == 0, F.concat(F.lit("<think>{hm}</think>```json\n"), whole, F.lit("\n```"))).when(F.col("k") % 3 == 1, F.concat(F.lit("Zeker: "), F.substring(whole, F.lit(1), F.length(whole) - 14))).otherwise("geen")
    fixed = payload.repair_json(reply)
    return dossiers(spark, sf_dir).select("doc_id", fixed.alias("fixed"))


ORACLES["l2_repair_model_json"] = f"""WITH {DOSSIER_CTE} SELECT doc_id, CASE k % 3 WHEN 0 THEN '{{"entities":[{{"text":"' || project || '","type":"project"}},{{"text":"b","type":"name"}}]}}'
  WHEN 1 THEN '{{"entities":[{{"text":"' || project || '","type":"project"}}]}}' END AS fixed FROM dossier"""

QUERIES |= {name: f for name, f in globals().items() if callable(f) and name[0] in "cdlp" and name[1].isdigit()}
