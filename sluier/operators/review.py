"""The review queue: items and decisions are append-only; an item's state is its latest decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("pending", "accepted", "rejected", "modified")
SNIPPET_WORDS = 5


def enqueue(spans: DataFrame) -> DataFrame:
    """Pending spans (doc_id, session_id, text, start, original, entity_type, ..., route) as review items.

    The id is made from what identifies the item, so a repeated run makes the same items.
    """
    item = F.xxhash64("session_id", "doc_id", "start", "end", "entity_type")
    return spans.filter("route = 'pending'").select(
        item.alias("item_id"), "session_id", "doc_id", F.col("text").alias("original_text"), F.col("original").alias("detected_text"), F.col("entity_type").alias("proposed_entity_type"), "confidence", F.lit("pending").alias("status")
    )


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """One row an item: the decision made last (of equal times the greatest status). Aggregates by item with a map-side part."""
    return decisions.groupBy("item_id").agg(F.max(F.struct("decided_at", "status", "entity_type")).alias("d")).select("item_id", "d.decided_at", "d.status", "d.entity_type")


def check_decisions(decisions: DataFrame, items: DataFrame) -> DataFrame:
    """decisions with error: unknown item, unknown status, back to pending, modified without a type."""
    known = items.select("item_id", F.lit(True).alias("__known"))
    rows = decisions.join(known, "item_id", "left")
    error = (
        F.when(F.col("__known").isNull(), "unknown item")
        .when(~F.col("status").isin(*STATUSES), "unknown status")
        .when(F.col("status") == "pending", "back to pending")
        .when((F.col("status") == "modified") & F.col("entity_type").isNull(), "modified without type")
    )
    return rows.withColumn("error", error).drop("__known")


def apply_decisions(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """items with the status and type that the latest valid decision gives; only `modified` carries a type of its own."""
    valid = check_decisions(decisions, items).filter("error is null").drop("error")
    last = latest_decisions(valid).select("item_id", F.col("status").alias("__status"), F.when(F.col("status") == "modified", F.col("entity_type")).alias("decided_type"), "decided_at")
    return items.join(last, "item_id", "left").withColumn("status", F.coalesce("__status", "status")).drop("__status")


def pending_items(items: DataFrame) -> DataFrame:
    return items.filter("status = 'pending'").orderBy("session_id", "item_id")


def sessions_with_pending(items: DataFrame) -> DataFrame:
    return items.filter("status = 'pending'").groupBy("session_id").agg(F.count(F.lit(1)).alias("pending"), F.min("item_id").alias("oldest")).orderBy("oldest")


def session_resolved(sessions: DataFrame, items: DataFrame) -> DataFrame:
    """(session_id, resolved): no pending item; a session without items is resolved."""
    counted = items.groupBy("session_id").agg(F.count_if(F.col("status") == "pending").alias("n"))
    return sessions.select("session_id").distinct().join(counted, "session_id", "left").select("session_id", (F.coalesce("n", F.lit(0)) == 0).alias("resolved"))


def accepted_entities(items: DataFrame) -> DataFrame:
    """Accepted items with the proposed type, modified ones with the chosen type."""
    kind = F.when(F.col("status") == "modified", F.col("decided_type")).otherwise(F.col("proposed_entity_type"))
    return items.filter("status in ('accepted', 'modified')").select("session_id", "item_id", F.col("detected_text").alias("original"), kind.alias("entity_type"), "confidence")


def rejected_keys(items: DataFrame) -> DataFrame:
    return items.filter("status = 'rejected'").select("session_id", F.col("detected_text").alias("original"), F.col("proposed_entity_type").alias("entity_type")).distinct()


def merge_decisions(spans: DataFrame, items: DataFrame) -> DataFrame:
    """Fresh spans (session_id, original, entity_type, route, ...) after the decisions.

    Rejected (text, type) pairs go from both routes; a text that was accepted takes the type of its last
    accepted item and becomes confident; the rest stays.
    """
    kept = spans.join(rejected_keys(items), ["session_id", "original", "entity_type"], "left_anti")
    last = accepted_entities(items).groupBy("session_id", "original").agg(F.max_by("entity_type", "item_id").alias("__type"))
    rows = kept.join(last, ["session_id", "original"], "left")
    return rows.withColumn("entity_type", F.coalesce("__type", "entity_type")).withColumn("route", F.when(F.col("__type").isNotNull(), "confident").otherwise(F.col("route"))).drop("__type")


def gate_documents(spans: DataFrame) -> DataFrame:
    """(doc_id, pending, held): a document with a pending span waits."""
    return spans.groupBy("doc_id").agg(F.count_if(F.col("route") == "pending").alias("pending")).withColumn("held", F.col("pending") > 0)


def context_snippet(text: Column, value: Column, words: int = SNIPPET_WORDS) -> Column:
    """(before, hit, after, cut_before, cut_after): up to `words` words on both sides of the first hit; not found gives empty contexts."""
    if words < 0:
        raise ValueError("words must not be negative")
    at = F.instr(text, value)
    before = F.regexp_extract_all(F.substring(text, F.lit(1), at - 1), F.lit(r"\S+"), F.lit(0))
    after = F.regexp_extract_all(F.substring(text, at + F.length(value), F.length(text)), F.lit(r"\S+"), F.lit(0))
    n = F.lit(words)
    found = F.struct(
        F.array_join(F.slice(before, F.greatest(F.size(before) - n + 1, F.lit(1)), n), " ").alias("before"),
        value.alias("hit"),
        F.array_join(F.slice(after, F.lit(1), n), " ").alias("after"),
        (F.size(before) > n).alias("cut_before"),
        (F.size(after) > n).alias("cut_after"),
    )
    none = F.struct(F.lit("").alias("before"), value.alias("hit"), F.lit("").alias("after"), F.lit(False).alias("cut_before"), F.lit(False).alias("cut_after"))
    return F.when((at > 0) & (F.length(value) > 0), found).otherwise(none)


def reconcile_session(vault: DataFrame, items: DataFrame, audit: DataFrame) -> DataFrame:
    """(session_id, original, entity_type, origin, last_text): what is known after a reply.

    Vault values first; of a resolved session also accepted texts that the vault lacks; of another its pending ones.
    """
    resolved = session_resolved(items, items)
    accepted = accepted_entities(items).join(resolved.filter("resolved"), "session_id", "left_semi").select("session_id", "original", "entity_type", F.lit(1).alias("rank"), F.lit("review").alias("origin"))
    waiting = items.filter("status = 'pending'").select("session_id", F.col("detected_text").alias("original"), F.col("proposed_entity_type").alias("entity_type"), F.lit(2).alias("rank"), F.lit("pending").alias("origin"))
    known = vault.select("session_id", "original", "entity_type", F.lit(0).alias("rank"), F.lit("vault").alias("origin"))
    first = known.unionByName(accepted).unionByName(waiting).groupBy("session_id", "original").agg(F.min(F.struct("rank", "entity_type", "origin")).alias("f"))
    texts = audit.groupBy("session_id").agg(F.max_by("pseudonymized_prompt", "id").alias("last_text"))
    return first.select("session_id", "original", "f.entity_type", "f.origin").join(texts, "session_id", "left")
