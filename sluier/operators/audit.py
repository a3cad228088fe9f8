"""The append-only audit table and what replies tell."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluier.operators.payload import content_blocks, string_field

MOST_ROWS = 1000


def append_audit(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows of requests that the log does not hold yet: a repeated batch appends nothing."""
    return requests.join(log.select("id"), "id", "left_anti")


def append_by_day(requests: DataFrame, path: str) -> None:
    """Append requests (id, created_at, ...) to a log that lies by day: only the days that occur in requests are read to tell what is there already."""
    spark = requests.sparkSession
    rows = requests.withColumn("day", F.to_date("created_at"))
    days = [r["day"] for r in rows.select("day").distinct().collect()]  # a batch is of a few days
    known = known_ids(spark, path, days)
    new = rows if known is None else rows.join(known, ["day", "id"], "left_anti")
    new.write.mode("append").partitionBy("day").parquet(path)


def known_ids(spark: SparkSession, path: str, days: list) -> DataFrame | None:
    """(day, id) of these days of a log; other days' folders aren't read. None if there is no log yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema("id bigint, day date").parquet(path).filter(F.col("day").isin(*days)).select("day", "id")


def batch_day(spark: SparkSession, content: str, batch_id: int) -> str:
    """The day of a batch: written down when it is first run, so a batch that is run again later keeps its partition."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{content.rstrip('/')}/days/{batch_id}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    if found:
        return min(found)
    today = datetime.datetime.now(datetime.timezone.utc).date().isoformat()
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(path, today))
    return today


def append_batch(rows: DataFrame, path: str, day: str, batch_id: int) -> None:
    """The audit rows of a batch, in a partition of their own: a batch that is run again replaces its rows, and no other partition is read."""
    rows.withColumn("created_at", F.to_timestamp(F.lit(day))).write.mode("overwrite").parquet(f"{path.rstrip('/')}/day={day}/batch={batch_id}")


def new_sessions(known: DataFrame, requests: DataFrame) -> DataFrame:
    """(session_id, created_at) of sessions not registered yet."""
    return requests.groupBy("session_id").agg(F.min("created_at").alias("created_at")).join(known.select("session_id"), "session_id", "left_anti")


def recent_audit(log: DataFrame, limit: int) -> DataFrame:
    """Newest first; the limit is held to 1..1000, so this is a top-k and no full sort."""
    return log.orderBy(F.desc("id")).limit(max(1, min(MOST_ROWS, limit)))


def audit_by_session(log: DataFrame, session_id: str) -> DataFrame:
    return log.filter(F.col("session_id") == session_id).orderBy("id")


def audit_by_id(log: DataFrame, id: int) -> DataFrame:
    return log.filter(F.col("id") == id)


def audit_status(error: Column, review_required: Column) -> Column:
    """(status, tone): an error beats review, review beats ok."""
    status = F.when(F.coalesce(error, F.lit("")) != "", "error").when(F.coalesce(review_required, F.lit(False)), "review").otherwise("ok")
    tone = F.when(status == "error", "danger").when(status == "review", "warning").otherwise("success")
    return F.struct(status.alias("status"), tone.alias("tone"))


def short(text: Column, most: int = 60) -> Column:
    """One line of at most `most` characters and an ellipsis; a dash for null."""
    flat = F.trim(F.translate(text, "\r\n\t", "   "))
    return F.when(text.isNull(), "—").when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def overview(log: DataFrame) -> DataFrame:
    return log.select(
        "id",
        F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created"),
        F.substring("session_id", 1, 8).alias("session"),
        short(F.col("original_prompt")).alias("prompt"),
        F.coalesce("llm_model", F.lit("—")).alias("model"),
        F.when(F.col("avg_confidence").isNull(), "—").otherwise(F.format_string("%.2f", "avg_confidence")).alias("confidence"),
        audit_status(F.col("error"), F.col("review_required"))["status"].alias("status"),
    )


def avg_confidence(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, avg_confidence): mean over a document's spans, null without any."""
    means = spans.groupBy("doc_id").agg(F.avg("confidence").alias("avg_confidence"))
    return docs.select("doc_id").join(means, "doc_id", "left")


def reply_text(body: Column) -> Column:
    """The texts of all content blocks, one to a line, without white space around; elements and texts of other kinds are passed over, other shapes give an empty text."""
    texts = F.filter(F.transform(content_blocks(body), lambda b: string_field(b, "text")), lambda t: t.isNotNull())
    return F.coalesce(F.regexp_replace(F.array_join(texts, "\n"), r"(?U)^\s+|\s+$", ""), F.lit(""))


def reply_signals(body: Column) -> Column:
    """(stop_reason, error, truncated, refusal, empty, ok)."""
    stop = F.get_json_object(body, "$.stop_reason")
    nested = F.coalesce(F.get_json_object(body, "$.error.message"), F.get_json_object(body, "$.error.detail"))
    plain = F.get_json_object(body, "$.error")
    error = F.coalesce(nested, F.when(~F.coalesce(plain, F.lit("{")).startswith("{"), plain), F.get_json_object(body, "$.detail"))
    truncated, refusal = F.coalesce(stop == "max_tokens", F.lit(False)), F.coalesce(stop == "refusal", F.lit(False))
    empty = reply_text(body) == ""
    return F.struct(stop.alias("stop_reason"), error.alias("error"), truncated.alias("truncated"), refusal.alias("refusal"), empty.alias("empty"), (error.isNull() & ~truncated & ~refusal & ~empty).alias("ok"))


def privacy_summary(entities: DataFrame, items: DataFrame) -> DataFrame:
    """(session_id, protected, reversible, pending, sentence)."""
    kept = entities.groupBy("session_id").agg(F.count(F.lit(1)).alias("protected"), F.count_if(F.col("mode") == "two_way").alias("reversible"))
    waiting = items.groupBy("session_id").agg(F.count_if(F.col("status") == "pending").alias("pending"))
    rows = kept.join(waiting, "session_id", "full").select("session_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("protected", "reversible", "pending")))
    parts = [F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {c}"))) for c in ("protected", "reversible", "pending")]
    return rows.withColumn("sentence", F.concat_ws(", ", *parts))


def privacy_report(entities: DataFrame, items: DataFrame, log: DataFrame) -> DataFrame:
    """(session_id, section, place, line): entities, then pending finds, then the audit timeline. Lines stay rows, so a session of any length works."""
    a = entities.select("session_id", F.lit("1 entities").alias("section"), F.concat_ws(" | ", "entity_type", "pseudonym", "mode").alias("line"), F.col("pseudonym").alias("place"))
    b = items.filter("status = 'pending'").select("session_id", F.lit("2 pending").alias("section"), F.concat_ws(" | ", "proposed_entity_type", F.format_string("%.2f", "confidence")).alias("line"), F.format_string("%020d", F.col("item_id").cast("bigint")).alias("place"))
    c = log.select("session_id", F.lit("3 audit").alias("section"), F.concat_ws(" | ", F.date_format("created_at", "yyyy-MM-dd HH:mm"), audit_status(F.col("error"), F.col("review_required"))["status"]).alias("line"), F.format_string("%020d", F.col("id").cast("bigint")).alias("place"))
    return a.unionByName(b).unionByName(c)
