"""Queries of names, gazetteers and windows, with their SQL."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluier.functions import spans as S
from sluier.functions.tables import register_detector
from sluier.operators import names as N
from sluier.plans.dossiers import DOSSIER_CTE, GOLD_CTE, dossiers, gold
from sluier.plans.q_detect import sql_scan

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def n1_role_name_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names after `Huisarts:` and `dochter` in dossiers."""
    return _shown(N.role_name_spans(dossiers(spark, sf_dir).select("doc_id", "text")), "names")


ORACLES["n1_role_name_spans"] = f"""WITH {DOSSIER_CTE}, {GOLD_CTE} SELECT doc_id, "start", "end", text AS original FROM gold WHERE entity_type = 'name'"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold(spark, sf_dir).filter("entity_type in ('name', 'address', 'project', 'bsn')").select("doc_id", "start", "text")


def n2_looks_like_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("doc_id", "start", "text", N.looks_like_name(F.col("text")).alias("fits"))


ORACLES["n2_looks_like_name"] = f"""WITH {DOSSIER_CTE}, {GOLD_CTE}, c AS (SELECT doc_id, "start", text, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM gold WHERE entity_type IN ('name', 'address', 'project', 'bsn'))
SELECT doc_id, "start", text, len(w) BETWEEN 1 AND 4 AND len(list_filter(w, lambda x: NOT (regexp_matches(x, '^[A-Z]') OR regexp_matches(x, '(?i)^(?:de|van|der|den|ter|el|ibn)$')))) = 0 AS fits FROM c"""

# Nested, touching and equal-length spans around words of a dossier.
_WORDY = r"[A-Z][a-z]+"


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words, and pairs of words that hold some of them."""
    text = F.col("text")
    both = F.array_sort(F.concat(S.scan(text, r"[A-Z][a-z]+"), S.scan(text, r"[A-Z][a-z]+: [A-Z][a-z]+")))
    return dossiers(spark, sf_dir).select("doc_id", "text", both.alias("spans"))


def _shown(rows: DataFrame, column: str) -> DataFrame:
    return rows.select("doc_id", S.each(column).alias("s")).filter("s is not null").select("doc_id", "s.start", "s.end", F.col("s.text").alias("original"))


def n3_drop_subsumed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_nested(spark, sf_dir).withColumn("o", N.drop_subsumed(F.col("spans"))), "o")


_NESTED = f"""w AS (SELECT doc_id, unnest({sql_scan('text', '[A-Z][a-z]+')} || {sql_scan('text', '[A-Z][a-z]+: [A-Z][a-z]+')}) AS s FROM dossier)"""
_OUTER = """SELECT doc_id, s.start AS "start", s."end" AS "end", s.text AS original FROM w WHERE NOT EXISTS (SELECT 1 FROM w o WHERE o.doc_id = w.doc_id AND o.s.start <= w.s.start AND w.s."end" <= o.s."end" AND o.s."end" - o.s.start > w.s."end" - w.s.start)"""
ORACLES["n3_drop_subsumed_spans"] = f"WITH {DOSSIER_CTE}, {_NESTED} {_OUTER}"


def n4_expand_name_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second word of `De Vries` grows to the left."""
    rows = gold(spark, sf_dir).filter("entity_type = 'name'").select("doc_id", "start", "end", "text").join(dossiers(spark, sf_dir).select("doc_id", F.col("text").alias("body")), "doc_id")
    inner = F.when(F.col("text").startswith("De "), F.col("start") + 3).otherwise(F.col("start"))
    start, end = N.expand_name_span(F.col("body"), inner, F.col("end"))
    return rows.select("doc_id", F.col("start").alias("labelled"), start.alias("start"), end.alias("end"))


# After `dochter` a particle looks like the end of that word (`..ter De `), and a span never grows from inside a word.
_GROWN = f"""named AS (SELECT g.*, CASE WHEN g.text LIKE 'De %' AND substr(d.text, "start" - 7, 8) = 'dochter ' THEN 3 ELSE 0 END AS kept_back FROM gold g JOIN dossier d USING (doc_id) WHERE entity_type = 'name')"""
ORACLES["n4_expand_name_span"] = f"""WITH {DOSSIER_CTE}, {GOLD_CTE}, {_GROWN} SELECT doc_id, "start" AS labelled, CAST("start" + kept_back AS INT) AS "start", "end" FROM named"""


def _two_finders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one finder (surnames, every second cut by a letter) and additions of another (whole)."""
    named = lambda s, cut: F.transform(s, lambda x: F.struct((x["start"] + cut).alias("start"), x["end"].alias("end"), F.substring("text", x["start"] + cut + 1, x["end"] - x["start"] - cut).alias("text"), F.lit(0.9).alias("confidence"))).cast(N.NAME)
    found = S.scan(F.col("text"), r"Jansen|Vries|Bakker|Visser|Smit|Mulder")
    cut = (F.col("k") % 2).cast("int")
    return dossiers(spark, sf_dir).select("doc_id", "text", "k", named(found, cut).alias("a"), named(found, F.lit(0)).alias("b"))


def n5_merge_name_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_two_finders(spark, sf_dir).withColumn("o", N.merge_name_spans(F.col("a"), F.col("b"), F.col("text"))), "o")


_SURNAMES = sql_scan("text", "Jansen|Vries|Bakker|Visser|Smit|Mulder")
ORACLES["n5_merge_name_spans"] = f"""WITH {DOSSIER_CTE}, w AS (SELECT doc_id, unnest({_SURNAMES}) AS s FROM dossier) SELECT doc_id, s.start AS "start", s."end" AS "end", s.text AS original FROM w"""


def n6_coalesce_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_nested(spark, sf_dir).withColumn("o", N.coalesce_names(F.col("spans"))), "o")


ORACLES["n6_coalesce_names"] = ORACLES["n3_drop_subsumed_spans"]


def n7_dictionary_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a gazetteer of all runs of four words (ASCII letters only) of the benchmark texts."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    runs = lambda w: F.when(F.size(w) > 3, F.transform(F.sequence(F.lit(1), F.size(w) - 3), lambda i: F.array_join(F.slice(w, i, F.lit(4)), " ")))
    entries = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(S.let(words, runs)).alias("surface")).distinct().select("surface", F.lit("org").alias("entity_type"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), " ").alias("text"))
    return N.dictionary_entities(docs, entries).select("doc_id", "start", "end", "text", "entity_type")


ORACLES["n7_dictionary_entities"] = f"""WITH listed AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
entry AS (SELECT DISTINCT array_to_string(w[i:i + 3], ' ') AS surface FROM listed, unnest(range(1, len(w) - 2)) AS r(i)),
d AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' ') AS text FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, text, unnest(range(1, len(s) - 2)) AS i, s FROM (SELECT doc_id, text, {sql_scan('text', '[a-z]+')} AS s FROM d)),
hit AS (SELECT doc_id, s[i].start AS "start", s[i + 3]."end" AS "end", substr(text, s[i].start + 1, s[i + 3]."end" - s[i].start) AS surface FROM w),
f AS (SELECT hit.* FROM hit JOIN entry USING (surface)),
k AS (SELECT doc_id, list_sort(list({{'n': "start" - "end", 'start': "start", 'end': "end", 'text': surface}})) AS every FROM f GROUP BY 1),
kept AS (SELECT doc_id, unnest(list_reduce(list_transform(every, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.start < x[1]."end" AND x[1].start < y."end")) > 0 THEN a ELSE a || x END)) AS s FROM k)
SELECT doc_id, s.start AS "start", s."end" AS "end", s.text AS text, 'org' AS entity_type FROM kept"""


def n8_map_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ["PER", "ORG", "LOC", "GPE", "FAC", "MISC"]
    found = gold(spark, sf_dir).select("doc_id", "start", F.element_at(F.array(*(F.lit(x) for x in labels)), ((F.col("doc_id") + F.col("start")) % 6 + 1).cast("int")).alias("label"))
    return N.map_labels(found)


_LABEL_ROWS = ", ".join(f"('{k}', '{t}', CAST({c} AS DOUBLE))" for k, (t, c) in N.LABELS.items())
ORACLES["n8_map_labels"] = f"""WITH {DOSSIER_CTE}, {GOLD_CTE}, l(label, entity_type, confidence) AS (VALUES {_LABEL_ROWS}), f AS (SELECT doc_id, "start", (['PER', 'ORG', 'LOC', 'GPE', 'FAC', 'MISC'])[(doc_id + "start") % 6 + 1] AS label FROM gold) SELECT f.*, l.entity_type, confidence FROM f JOIN l USING (label)"""


def n9_text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return N.text_windows(docs).select("doc_id", "window", "offset", F.length("part").alias("chars"))


ORACLES["n9_text_windows"] = """WITH d AS (SELECT doc_id, CAST(length(coalesce(text, '')) AS INT) AS n FROM documents)
SELECT doc_id, CAST(w AS INT) AS "window", CAST(least(w * 1600, greatest(n - 2000, 0)) AS INT) AS "offset", CAST(least(n, 2000) AS INT) AS chars
FROM d, unnest(range(0, CASE WHEN n <= 2000 THEN 1 ELSE CAST(ceil((n - 2000) / 1600) AS BIGINT) + 1 END)) AS r(w)"""


def n10_merge_window_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of five letters and more that begin with a capital, found in each window, back in the text; a word cut by a window's border scores less."""
    windows = N.text_windows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    found = windows.select("doc_id", "offset", F.length("part").alias("n"), S.each(S.scan(F.col("part"), r"[A-Z][A-Za-z]{4,}")).alias("s")).filter("s is not null")
    cut = ((F.col("s.start") == 0) & (F.col("offset") > 0)) | (F.col("s.end") == F.col("n"))
    scored = found.select("doc_id", "offset", "s.start", "s.end", F.lit("org").alias("entity_type"), F.when(cut, 0.5).otherwise(0.9).alias("score"))
    return N.merge_window_spans(scored).select("doc_id", "start", "end", "entity_type")


# A word cut by a window is whole in the next one, so merging must give the words of the whole text.
ORACLES["n10_merge_window_spans"] = f"""WITH f AS (SELECT doc_id, unnest({sql_scan("coalesce(text, '')", '[A-Z][A-Za-z]{4,}')}) AS s FROM documents) SELECT doc_id, s.start AS "start", s."end" AS "end", 'org' AS entity_type FROM f"""


def n11_model_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector of the user's: every word `op`, of which a dossier has several."""

    def detect(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": m.start(), "end": m.end(), "label": "PER"} for m in re.finditer(r"\bop\b", t)])

    return N.map_labels(N.model_spans(dossiers(spark, sf_dir), detect))


ORACLES["n11_model_spans"] = f"""WITH {DOSSIER_CTE}, f AS (SELECT doc_id, unnest({sql_scan('text', ' op ')}) AS s FROM dossier) SELECT doc_id, CAST(s.start + 1 AS INT) AS "start", CAST(s."end" - 1 AS INT) AS "end", 'PER' AS label, 'name' AS entity_type, CAST(0.9 AS DOUBLE) AS confidence FROM f"""


def n11_detector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same detector as a table function in SQL."""

    def load():
        op = re.compile(r"\bop\b")
        return lambda text: [{"start": m.start(), "end": m.end(), "label": "PER"} for m in op.finditer(text)]

    register_detector(spark, "find_op", load)
    found = spark.sql("SELECT d.doc_id, s.start, s.end, s.label FROM {docs} AS d, LATERAL find_op(d.text) AS s", docs=dossiers(spark, sf_dir))
    return N.map_labels(found)


ORACLES["n11_detector_table"] = ORACLES["n11_model_spans"]


def l6_supplement_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_two_finders(spark, sf_dir).withColumn("o", N.supplement_names(F.col("a"), F.col("b"), F.col("text"))), "o")


ORACLES["l6_supplement_names"] = f"""WITH {DOSSIER_CTE}, {GOLD_CTE}, {_GROWN} SELECT doc_id, CAST("start" + kept_back AS INT) AS "start", "end", substr(text, 1 + kept_back) AS original FROM named"""

QUERIES |= {name: f for name, f in globals().items() if callable(f) and name[0] in "nl" and name[1].isdigit()}
