"""Queries of the review queue and the audit table, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluier.operators import audit as A
from sluier.operators import review as R
from sluier.session import working_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Events as review items: session = user, detected text and type from the event; labels of decisions from event_id.
_ITEM = """SELECT event_id AS item_id, 'u' || CAST(user_id AS STRING) AS session_id, event_id AS doc_id, 'gezien: ' || event_type || ' vandaag' AS original_text, event_type || CAST(event_id % 9 AS STRING) AS detected_text,
  CASE event_id % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'org' ELSE 'location' END AS proposed_entity_type, CAST(event_id % 10 AS DOUBLE) / 10 AS confidence, 'pending' AS status FROM events"""
_DECISION = """SELECT event_id + CASE WHEN event_id % 11 = 0 THEN 100000000 ELSE 0 END AS item_id, ts AS decided_at,
  CASE event_id % 7 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'modified' WHEN 3 THEN 'pending' WHEN 4 THEN 'weg' ELSE 'accepted' END AS status, CASE WHEN event_id % 2 = 0 THEN 'phone' END AS entity_type FROM events WHERE event_id % 5 <> 0
  UNION ALL SELECT event_id, ts + INTERVAL '1' DAY, 'rejected', CAST(NULL AS STRING) FROM events WHERE event_id % 13 = 0"""


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _ITEM)


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _DECISION)


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.apply_decisions(_items(spark, sf_dir), _decisions(spark, sf_dir))


_BASE = f"""item AS ({_ITEM}), decision AS ({_DECISION}),
checked AS (SELECT d.*, CASE WHEN i.item_id IS NULL THEN 'unknown item' WHEN d.status NOT IN ('pending', 'accepted', 'rejected', 'modified') THEN 'unknown status' WHEN d.status = 'pending' THEN 'back to pending' WHEN d.status = 'modified' AND d.entity_type IS NULL THEN 'modified without type' END AS error
  FROM decision d LEFT JOIN item i USING (item_id)),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY decided_at DESC, status DESC) AS rn FROM checked WHERE error IS NULL) WHERE rn = 1),
decided AS (SELECT i.* EXCLUDE (status), coalesce(l.status, i.status) AS status, CASE WHEN l.status = 'modified' THEN l.entity_type END AS decided_type, l.decided_at FROM item i LEFT JOIN latest l USING (item_id))"""


def r1_enqueue_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds below 0.5 wait for a review."""
    spans = _items(spark, sf_dir).select("doc_id", "session_id", F.col("original_text").alias("text"), F.lit(8).alias("start"), F.lit(12).alias("end"), F.col("detected_text").alias("original"), F.col("proposed_entity_type").alias("entity_type"), "confidence", F.when(F.col("confidence") < 0.5, "pending").otherwise("confident").alias("route"))
    return R.enqueue(spans).drop("item_id")


ORACLES["r1_enqueue_review"] = f"SELECT session_id, doc_id, original_text, detected_text, proposed_entity_type, confidence, status FROM ({_ITEM}) WHERE confidence < 0.5"


def r2_pending_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pending_items(_decided(spark, sf_dir)).select("session_id", "item_id", "detected_text")


ORACLES["r2_pending_items"] = f"WITH {_BASE} SELECT session_id, item_id, detected_text FROM decided WHERE status = 'pending' ORDER BY 1, 2"


def r3_apply_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("item_id", "status", "decided_type")


ORACLES["r3_apply_decisions"] = f"WITH {_BASE} SELECT item_id, status, decided_type FROM decided"


def r3_rejected_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.check_decisions(_decisions(spark, sf_dir), _items(spark, sf_dir)).filter("error is not null").select("item_id", "status", "error")


ORACLES["r3_rejected_decisions"] = f"WITH {_BASE} SELECT item_id, status, error FROM checked WHERE error IS NOT NULL"


def r4_sessions_with_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sessions_with_pending(_decided(spark, sf_dir))


ORACLES["r4_sessions_with_pending"] = f"WITH {_BASE} SELECT session_id, count(*) AS pending, min(item_id) AS oldest FROM decided WHERE status = 'pending' GROUP BY 1 ORDER BY oldest"


def r5_session_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without items count as resolved sessions."""
    sessions = _items(spark, sf_dir).select("session_id").union(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"))))
    return R.session_resolved(sessions, _decided(spark, sf_dir))


ORACLES["r5_session_resolved"] = f"WITH {_BASE} SELECT session_id, count(*) FILTER (status = 'pending') = 0 AS resolved FROM (SELECT session_id, status FROM decided UNION ALL SELECT 'c' || c_custkey, NULL FROM customer) GROUP BY 1"


def r6_accepted_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.accepted_entities(_decided(spark, sf_dir))


_ACCEPTED = "SELECT session_id, item_id, detected_text AS original, CASE WHEN status = 'modified' THEN decided_type ELSE proposed_entity_type END AS entity_type, confidence FROM decided WHERE status IN ('accepted', 'modified')"
_REJECTED = "SELECT DISTINCT session_id, detected_text AS original, proposed_entity_type AS entity_type FROM decided WHERE status = 'rejected'"
ORACLES["r6_accepted_entities"] = f"WITH {_BASE} {_ACCEPTED}"


def r7_rejected_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rejected_keys(_decided(spark, sf_dir))


ORACLES["r7_rejected_keys"] = f"WITH {_BASE} {_REJECTED}"


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select(F.col("item_id").alias("span_id"), "doc_id", "session_id", F.col("detected_text").alias("original"), F.col("proposed_entity_type").alias("entity_type"), F.when(F.col("confidence") < 0.5, "pending").otherwise("confident").alias("route"))


def r8_merge_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_decisions(_fresh(spark, sf_dir), _decided(spark, sf_dir)).select("span_id", "entity_type", "route")


_MERGED = f"""fresh AS (SELECT item_id AS span_id, doc_id, session_id, detected_text AS original, proposed_entity_type AS entity_type, CASE WHEN confidence < 0.5 THEN 'pending' ELSE 'confident' END AS route FROM item),
accepted AS ({_ACCEPTED}), rejected AS ({_REJECTED}), last AS (SELECT session_id, original, arg_max(entity_type, item_id) AS given FROM accepted GROUP BY 1, 2),
merged AS (SELECT span_id, doc_id, coalesce(given, entity_type) AS entity_type, CASE WHEN given IS NOT NULL THEN 'confident' ELSE route END AS route FROM (SELECT * FROM fresh ANTI JOIN rejected USING (session_id, original, entity_type)) LEFT JOIN last USING (session_id, original))"""
ORACLES["r8_merge_decisions"] = f"WITH {_BASE}, {_MERGED} SELECT span_id, entity_type, route FROM merged"


def r9_gate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four finds make a document."""
    spans = R.merge_decisions(_fresh(spark, sf_dir), _decided(spark, sf_dir)).withColumn("doc_id", F.floor(F.col("doc_id") / 4))
    return R.gate_documents(spans)


ORACLES["r9_gate_documents"] = f"WITH {_BASE}, {_MERGED} SELECT CAST(floor(doc_id / 4) AS BIGINT) AS doc_id, count(*) FILTER (route = 'pending') AS pending, count(*) FILTER (route = 'pending') > 0 AS held FROM merged GROUP BY 1"


def r10_context_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents around the word `the`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", R.context_snippet(F.col("text"), F.lit(" the ")).alias("s")).select("doc_id", "s.*")


ORACLES["r10_context_snippet"] = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, instr(coalesce(text, ''), ' the ') AS p FROM documents),
w AS (SELECT doc_id, p, regexp_extract_all(substr(t, 1, greatest(p - 1, 0)), '\S+') AS b, regexp_extract_all(substr(t, p + 5), '\S+') AS a FROM d)
SELECT doc_id, CASE WHEN p > 0 THEN coalesce(array_to_string(b[greatest(len(b) - 4, 1):len(b)], ' '), '') ELSE '' END AS before, ' the ' AS hit, CASE WHEN p > 0 THEN coalesce(array_to_string(a[1:5], ' '), '') ELSE '' END AS after,
  p > 0 AND len(b) > 5 AS cut_before, p > 0 AND len(a) > 5 AS cut_after FROM w"""

_LOG = """SELECT event_id AS id, 'u' || CAST(user_id AS STRING) AS session_id, ts AS created_at, 'Vraag over ' || event_type || chr(10) || props AS original_prompt, event_type || ' ' || CAST(event_id AS STRING) AS pseudonymized_prompt,
  CASE WHEN event_id % 3 > 0 THEN 'model-' || CAST(event_id % 3 AS STRING) END AS llm_model, CASE WHEN event_id % 4 > 0 THEN value / 100 END AS avg_confidence, event_id % 5 = 0 AS review_required, CASE WHEN event_type = 'error' THEN 'fout' END AS error FROM events"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _LOG)


def r11_reconcile_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    vault = _items(spark, sf_dir).filter("item_id % 17 = 0").select("session_id", F.col("detected_text").alias("original"), F.lit("bsn").alias("entity_type"))
    return R.reconcile_session(vault, _decided(spark, sf_dir), _log(spark, sf_dir))


ORACLES["r11_reconcile_session"] = f"""WITH {_BASE}, log AS ({_LOG}), open AS (SELECT session_id, count(*) FILTER (status = 'pending') AS n FROM decided GROUP BY 1), accepted AS ({_ACCEPTED}),
known AS (SELECT session_id, detected_text AS original, 0 AS rank, 'bsn' AS entity_type, 'vault' AS origin FROM item WHERE item_id % 17 = 0
  UNION ALL SELECT session_id, original, 1, entity_type, 'review' FROM accepted JOIN open USING (session_id) WHERE n = 0
  UNION ALL SELECT session_id, detected_text, 2, proposed_entity_type, 'pending' FROM decided WHERE status = 'pending'),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, original ORDER BY rank, entity_type) AS rn FROM known) WHERE rn = 1)
SELECT f.session_id, original, entity_type, origin, last_text FROM first f LEFT JOIN (SELECT session_id, arg_max(pseudonymized_prompt, id) AS last_text FROM log GROUP BY 1) USING (session_id)"""


def a1_append_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of which every third row is in the log already."""
    return A.append_audit(_log(spark, sf_dir).filter("id % 3 = 0"), _log(spark, sf_dir)).select("id", "session_id")


ORACLES["a1_append_audit"] = f"SELECT id, session_id FROM ({_LOG}) WHERE id % 3 <> 0"


def a1_append_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that lies by day, with every third row; the whole log is appended twice. Told are its days."""
    path = f"{working_dir(spark)}/audit-{uuid.uuid4().hex}"
    log = _log(spark, sf_dir).select("id", "session_id", "created_at")
    for rows in (log.filter("id % 3 = 0"), log, log):
        A.append_by_day(rows, path)
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"))


ORACLES["a1_append_by_day"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows, count(*) AS ids FROM events GROUP BY 1"


def a1_new_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.new_sessions(_log(spark, sf_dir).filter("id % 50 = 0"), _log(spark, sf_dir))


ORACLES["a1_new_sessions"] = f"WITH log AS ({_LOG}) SELECT session_id, min(created_at) AS created_at FROM log WHERE session_id NOT IN (SELECT session_id FROM log WHERE id % 50 = 0) GROUP BY 1"


def a2_recent_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.recent_audit(_log(spark, sf_dir), 5000).select("id", "session_id", "error")


ORACLES["a2_recent_audit"] = f"SELECT id, session_id, error FROM ({_LOG}) ORDER BY id DESC LIMIT 1000"


def a3_audit_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.audit_by_session(_log(spark, sf_dir), "u7").select("id", "created_at", "pseudonymized_prompt")


ORACLES["a3_audit_by_session"] = f"SELECT id, created_at, pseudonymized_prompt FROM ({_LOG}) WHERE session_id = 'u7' ORDER BY id"


def a4_audit_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.audit_by_id(_log(spark, sf_dir), 42).select("id", "session_id", "original_prompt")


ORACLES["a4_audit_by_id"] = f"SELECT id, session_id, original_prompt FROM ({_LOG}) WHERE id = 42"


def a5_audit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("id", A.audit_status(F.col("error"), F.col("review_required")).alias("s")).select("id", "s.*")


_STATUS = "CASE WHEN error IS NOT NULL THEN 'error' WHEN review_required THEN 'review' ELSE 'ok' END"
ORACLES["a5_audit_status"] = f"SELECT id, {_STATUS} AS status, CASE WHEN error IS NOT NULL THEN 'danger' WHEN review_required THEN 'warning' ELSE 'success' END AS tone FROM ({_LOG})"


def a6_audit_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.overview(_log(spark, sf_dir)).drop("confidence")


_SHORT = "trim(translate(original_prompt, chr(13) || chr(10) || chr(9), '   '))"
ORACLES["a6_audit_overview"] = f"""SELECT id, strftime(created_at, '%Y-%m-%d %H:%M') AS created, substr(session_id, 1, 8) AS session, CASE WHEN length({_SHORT}) > 60 THEN substr({_SHORT}, 1, 60) || '…' ELSE {_SHORT} END AS prompt,
  coalesce(llm_model, '—') AS model, {_STATUS} AS status FROM ({_LOG})"""


def a7_avg_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _items(spark, sf_dir).select("doc_id")
    spans = _items(spark, sf_dir).filter("doc_id % 6 <> 0").select("doc_id", "confidence")
    return A.avg_confidence(docs, spans)


ORACLES["a7_avg_confidence"] = f"SELECT doc_id, avg(confidence) FILTER (doc_id % 6 <> 0) AS avg_confidence FROM ({_ITEM}) GROUP BY 1"

# Replies made from events: blocks of text among others, or an error, by event_id.
_BODY = """CASE event_id % 5 WHEN 0 THEN '{"id":"m","content":[{"type":"text","text":"' || event_type || '"},"los",{"type":"tool_use","id":"t","input":{"text":"x"}},{"type":"text","text":{"z":1}},7,{"type":"text","text":"klaar"}],"stop_reason":"end_turn"}'
  WHEN 1 THEN '{"content":[null,{"type":"text","text":"half"}],"stop_reason":"max_tokens"}'
  WHEN 2 THEN '{"error":{"message":"stuk ' || event_type || '"}}' WHEN 3 THEN '{"error":"kapot","content":[]}' ELSE '{"content":["los",{"text":5}],"stop_reason":"refusal"}' END"""


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(_BODY).alias("body"))


def a8_reply_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bodies(spark, sf_dir).select("event_id", A.reply_text(F.col("body")).alias("reply"))


ORACLES["a8_reply_text"] = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type || chr(10) || 'klaar' WHEN 1 THEN 'half' ELSE '' END AS reply FROM events"


def a9_reply_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bodies(spark, sf_dir).select("event_id", A.reply_signals(F.col("body")).alias("s")).select("event_id", "s.*")


ORACLES["a9_reply_signals"] = f"""WITH b AS (SELECT event_id, {_BODY} AS body FROM events), j AS (SELECT event_id, json_extract_string(body, '$.stop_reason') AS stop_reason,
  coalesce(json_extract_string(body, '$.error.message'), json_extract_string(body, '$.error')) AS error, event_id % 5 NOT IN (0, 1) AS empty FROM b)
SELECT event_id, stop_reason, error, coalesce(stop_reason = 'max_tokens', false) AS truncated, coalesce(stop_reason = 'refusal', false) AS refusal, empty, error IS NULL AND coalesce(stop_reason NOT IN ('max_tokens', 'refusal'), true) AND NOT empty AS ok FROM j"""


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).filter("item_id % 2 = 0").select("session_id", "item_id", F.col("detected_text").alias("original"), F.col("proposed_entity_type").alias("entity_type"), F.concat(F.lit("["), F.col("item_id").cast("string"), F.lit("]")).alias("pseudonym"), F.when(F.col("item_id") % 3 == 0, "two_way").otherwise("one_way").alias("mode"))


def a10_privacy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.privacy_summary(_entities(spark, sf_dir), _decided(spark, sf_dir))


_SUMMED = """SELECT session_id, count(*) FILTER (item_id % 2 = 0) AS protected, count(*) FILTER (item_id % 6 = 0) AS reversible, count(*) FILTER (status = 'pending') AS pending FROM decided GROUP BY 1"""
ORACLES["a10_privacy_summary"] = f"""WITH {_BASE}, s AS ({_SUMMED})
SELECT *, concat_ws(', ', CASE WHEN protected > 0 THEN protected || ' protected' END, CASE WHEN reversible > 0 THEN reversible || ' reversible' END, CASE WHEN pending > 0 THEN pending || ' pending' END) AS sentence FROM s"""


def a11_privacy_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.privacy_report(_entities(spark, sf_dir), _decided(spark, sf_dir), _log(spark, sf_dir))


ORACLES["a11_privacy_report_rows"] = f"""WITH {_BASE}, log AS ({_LOG})
SELECT session_id, '1 entities' AS section, proposed_entity_type || ' | [' || item_id || '] | ' || CASE WHEN item_id % 3 = 0 THEN 'two_way' ELSE 'one_way' END AS line, '[' || item_id || ']' AS place FROM item WHERE item_id % 2 = 0
UNION ALL SELECT session_id, '2 pending', proposed_entity_type || ' | ' || printf('%.2f', confidence), lpad(CAST(item_id AS VARCHAR), 20, '0') FROM decided WHERE status = 'pending'
UNION ALL SELECT session_id, '3 audit', strftime(created_at, '%Y-%m-%d %H:%M') || ' | ' || {_STATUS}, lpad(CAST(id AS VARCHAR), 20, '0') FROM log"""

QUERIES |= {name: f for name, f in globals().items() if callable(f) and name[0] in "ra" and name[1].isdigit()}
