"""Dossiers derived from `orders`: one for each order, by expressions that both Spark and an SQL oracle evaluate.

The parts of a dossier are known, so the labels (gold) come with it. All values are fictional.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluier.functions import spans as S

# Fixed values of the view.
_NAMES = ["Jansen", "De Vries", "Bakker", "Visser", "Smit", "Mulder"]
_CODES = ["I21.4", "J44", "E11.9", "C50.1", "G71.0", "E75.2", "K35", "D66"]


def _choose(values: list[str], number: str) -> str:
    return "CASE " + number + f" % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_BSN_SUM = " + ".join(f"CAST(substr(b8, {i + 1}, 1) AS BIGINT) * {9 - i}" for i in range(8))
_date = lambda d: f"(CAST(day({d}) AS STRING) || '-' || CAST(month({d}) AS STRING) || '-' || CAST(year({d}) AS STRING))"

PARTS = f"""
SELECT k AS doc_id, 's' || CAST(c AS STRING) AS session_id,
  b8 || CASE WHEN w % 11 = 10 THEN '0' ELSE CAST(w % 11 AS STRING) END AS bsn, w % 11 <> 10 AS bsn_ok,
  CAST(1000 + c % 9000 AS STRING) || ' ' || chr(CAST(65 + c % 26 AS INT)) || chr(CAST(65 + (c + k) % 26 AS INT)) AS postcode,
  CAST(k % 105 AS STRING) || ' jaar' AS age,
  CAST(k % 28 + 1 AS STRING) || '-' || CAST(k % 12 + 1 AS STRING) || '-' || CAST(1920 + k % 90 AS STRING) AS birthdate,
  {_date("d")} AS admission, {_date("d5")} AS discharge, {_date("d2")} AS exam,
  {_choose(_CODES, "k")} AS code, {_choose(_NAMES, "c")} AS doctor, {_choose(_NAMES[::-1], "k")} AS relative,
  'patient' || CAST(c AS STRING) || '@voorbeeld.example' AS email,
  '06-' || CAST(10000000 + k % 90000000 AS STRING) AS phone,
  'MRN: ' || lpad(CAST(k % 100000000 AS STRING), 8, '0') AS mrn,
  'EPD-' || lpad(CAST(k % 1000000000 AS STRING), 9, '0') AS epd,
  'AB-' || lpad(CAST(k % 1000 AS STRING), 3, '0') || '-C' AS plate,
  'PRJ-' || lpad(CAST(c % 10000 AS STRING), 4, '0') AS project,
  'Dorpsstraat ' || CAST(k % 200 + 1 AS STRING) AS street,
  'NL' || lpad(CAST(98 - ((111023200000000000 + account) % 97 * 1000000 + 232100) % 97 AS STRING), 2, '0') || 'BANK' || lpad(CAST(account AS STRING), 10, '0') AS iban, k, c
FROM (SELECT *, {_BSN_SUM} AS w, (k * 7919) % 10000000000 AS account FROM (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d, o_orderdate + INTERVAL '5' DAY AS d5, o_orderdate + INTERVAL '2' DAY AS d2,
    lpad(CAST((o_orderkey * 7919 + 12345678) % 100000000 AS STRING), 8, '0') AS b8 FROM {{orders}}) AS o) AS p
"""

TEXT = """
  'Dossier ' || CAST(doc_id AS STRING) || ', ' || age || ', geboren ' || birthdate || ', BSN ' || bsn || '.' || chr(10)
  || 'Woont ' || street || ', ' || postcode || '. Tel ' || phone || ', mail ' || email || '.' || chr(10)
  || CASE k % 4 WHEN 0 THEN 'Opgenomen op ' WHEN 1 THEN 'Patiënt werd op ' WHEN 2 THEN 'Opnamedatum: ' ELSE 'Geplande opname op ' END || admission || '. '
  || CASE k % 3 WHEN 0 THEN 'Verwachte ontslagdatum: ' WHEN 1 THEN 'Ontslagen op ' ELSE 'Ontslag naar huis op ' END || discharge || '. '
  || CASE k % 2 WHEN 0 THEN 'MRI-scan op ' ELSE 'Bloedafname op ' END || exam || '.' || chr(10)
  || 'Code ' || code || ', ' || mrn || ', ' || epd || ', onder ' || project || ', auto ' || plate || ', rekening ' || iban || '.' || chr(10)
  || 'Huisarts: ' || doctor || '. Contactpersoon: dochter ' || relative || '.'
"""

DOSSIERS = f"SELECT *, {TEXT} AS text FROM ({PARTS}) AS parts"

# entity type, part, what stands before the part in the text.
GOLD_PARTS = [
    ("age", "age", "', '"), ("birthdate", "birthdate", "'geboren '"), ("bsn", "bsn", "'BSN '"), ("address", "street", "'Woont '"), ("postcode_pc6", "postcode", "street || ', '"),
    ("phone", "phone", "'Tel '"), ("email", "email", "'mail '"), ("icd10_code", "code", "'Code '"), ("mrn", "mrn", "', '"), ("epd_id", "epd", "', '"),
    ("project", "project", "'onder '"), ("kenteken", "plate", "'auto '"), ("iban", "iban", "'rekening '"),
    ("admission_date", "admission", "CASE k % 4 WHEN 0 THEN 'Opgenomen op ' WHEN 1 THEN 'werd op ' WHEN 2 THEN 'Opnamedatum: ' ELSE 'opname op ' END"),
    ("discharge_date", "discharge", "CASE k % 3 WHEN 0 THEN 'ontslagdatum: ' WHEN 1 THEN 'Ontslagen op ' ELSE 'huis op ' END"),
    ("exam_date", "exam", "CASE k % 2 WHEN 0 THEN 'scan op ' ELSE 'Bloedafname op ' END"),
    ("name", "doctor", "'Huisarts: '"), ("name", "relative", "'dochter '"),
]


def _label(kind: str, part: str, lead: str) -> str:
    start = f"instr(text, {lead} || {part}) - 1 + length({lead})"
    return f"named_struct('start', CAST({start} AS INT), 'end', CAST({start} + length({part}) AS INT), 'text', {part}, 'entity_type', '{kind}')"


# Labels with their places; written for Spark. The oracle has GOLD_CTE.
_LABELLED = f"SELECT *, array({', '.join(_label(t, p, lead) for t, p, lead in GOLD_PARTS)}) AS labels FROM {{dossiers}}"


def dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, session_id, text and the parts. They are made anew wherever they are read: a written copy is many times as large as `orders`."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    dealt = orders.repartition(max(spark.sparkContext.defaultParallelism, orders.rdd.getNumPartitions()))
    return spark.sql(DOSSIERS, orders=dealt)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dossiers with labels, an array (start, end, text, entity_type) that is made in the row."""
    return spark.sql(_LABELLED, dossiers=dossiers(spark, sf_dir))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, session_id, start, end, text, entity_type, k: a row for each label."""
    rows = labelled(spark, sf_dir).select("doc_id", "session_id", S.each("labels").alias("x"), "k").filter("x is not null")
    return rows.select("doc_id", "session_id", "x.start", "x.end", "x.text", "x.entity_type", "k")


# Two made-up detectors over gold labels: `drops` loses every 7th and takes every 5th one character short, `swaps` mistypes ages and adds a find.
# The changes follow from doc_id, so both detectors are the same in any engine.
_FIND = "named_struct('runner', '{runner}', 'start', {start}, 'end', {end}, 'text', {text}, 'entity_type', {kind}, 'layer', {layer})"
_DROPS = _FIND.format(runner="drops", start="x.start", end="CASE WHEN (doc_id + x.start) % 5 = 0 THEN x.end - 1 ELSE x.end END", text="x.text", kind="x.entity_type", layer="'regex'")
_SWAPS = _FIND.format(runner="swaps", start="x.start", end="x.end", text="x.text", kind="CASE WHEN x.entity_type = 'age' AND doc_id % 3 = 0 THEN 'mrn' ELSE x.entity_type END", layer="CASE WHEN doc_id % 2 = 0 THEN 'regex' ELSE 'deduce' END")
_ADDED = _FIND.format(runner="swaps", start="0", end="7", text="'Dossier'", kind="'org'", layer="'deduce'")
_PREDICTED = f"""concat(transform(filter(labels, x -> (doc_id + x.start) % 7 <> 0), x -> {_DROPS}), transform(labels, x -> {_SWAPS}),
  transform(filter(labels, x -> x.entity_type = 'bsn' AND doc_id % 4 = 0), x -> {_ADDED}))"""


def predicted(docs: DataFrame) -> DataFrame:
    """Labelled dossiers with the finds of both detectors, an array (runner, start, end, text, entity_type, layer)."""
    return docs.withColumn("finds", F.expr(_PREDICTED))


def predictions(docs: DataFrame) -> DataFrame:
    """runner, doc_id, start, end, text, entity_type, layer: a row for each find in labelled dossiers."""
    rows = predicted(docs).select("doc_id", S.each("finds").alias("x")).filter("x is not null")
    return rows.select("x.runner", "doc_id", "x.start", "x.end", "x.text", "x.entity_type", "x.layer")


DOSSIER_CTE = f"dossier AS (SELECT *, {TEXT} AS text FROM ({PARTS}) AS parts)".replace("{orders}", "orders")
GOLD_CTE = "gold AS (" + " UNION ALL ".join(
    f"SELECT doc_id, session_id, CAST(instr(text, {lead} || {p}) - 1 + length({lead}) AS INT) AS \"start\", CAST(instr(text, {lead} || {p}) - 1 + length({lead}) + length({p}) AS INT) AS \"end\", {p} AS text, '{t}' AS entity_type, k FROM dossier"
    for t, p, lead in GOLD_PARTS
) + ")"
PRED_CTE = """pred AS (
  SELECT 'drops' AS runner, doc_id, "start", CASE WHEN (doc_id + "start") % 5 = 0 THEN "end" - 1 ELSE "end" END AS "end", text, entity_type, 'regex' AS layer FROM gold WHERE (doc_id + "start") % 7 <> 0
  UNION ALL SELECT 'swaps', doc_id, "start", "end", text, CASE WHEN entity_type = 'age' AND doc_id % 3 = 0 THEN 'mrn' ELSE entity_type END, CASE WHEN doc_id % 2 = 0 THEN 'regex' ELSE 'deduce' END FROM gold
  UNION ALL SELECT 'swaps', doc_id, 0, 7, 'Dossier', 'org', 'deduce' FROM gold WHERE entity_type = 'bsn' AND doc_id % 4 = 0)"""
