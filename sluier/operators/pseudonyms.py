"""Pseudonyms, the vault of mappings, restoring, re-keying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluier.functions import spans as S
from sluier.functions.keyed import WIDTH, pseudonym, session_pads
from sluier.operators.entity_types import category_of, code_of
from sluier.operators.payload import content_blocks, string_field
from sluier.session import materialise

# Form of a pseudonym in a text.
TOKEN = r"\[[A-Z0-9]{3}-[0-9a-f]{6}\]"
MODES, DEFAULT_MODE = ("one_way", "two_way"), "one_way"


def super_default(config_value: Column) -> Column:
    """Mode of last resort from the configuration: missing, blank or unknown means one_way."""
    mode = F.lower(F.trim(config_value))
    return F.when(mode.isin(*MODES), mode).otherwise(DEFAULT_MODE)


def resolve_mode(entity_type: Column, overrides: Column, default_mode: Column, last: Column | str = DEFAULT_MODE) -> tuple[Column, Column]:
    """(mode, where it comes from): the type's override, the template's default, the last resort."""
    last = F.lit(last) if isinstance(last, str) else last
    own = F.try_element_at(overrides, entity_type)
    source = F.when(own.isNotNull(), "override").when(default_mode.isNotNull(), "template").otherwise("super_default")
    return F.coalesce(own, default_mode, last), source


def make_pseudonym(session_id: Column, entity_type: Column, original: Column, key: bytes, width: int = WIDTH) -> Column:
    """A value's pseudonym; the key stays out of the plan."""
    return S.let(session_pads(session_id, key), lambda pads: pseudonym(pads, entity_type, original, code_of(entity_type), width))


def pseudonymise(docs: DataFrame, key: bytes, text: str = "general_text", spans: str = "general_spans") -> DataFrame:
    """docs with outbound_text and its spans' pseudonyms: every span is replaced, row by row, without a join.

    A pseudonym depends on session, type and original only, so what the vault holds equals what is made here under the same key.
    Where nothing safe can be sent, outbound_text is null and outbound_error tells why: spans overlap, or a row with spans has no session.
    """
    named = lambda pads: F.transform(spans, lambda s: s.withField("pseudonym", pseudonym(pads, s["entity_type"], s["original"], code_of(s["entity_type"]))))
    pads = lambda use: S.let(session_pads(F.col("session_id"), key), use)

    lost = F.col("session_id").isNull() & (F.size(spans) > 0)

    def outbound(every: Column) -> Column:
        edits = F.array_sort(F.transform(every, lambda s: F.struct(s["start"], s["end"], s["pseudonym"].alias("new"))))
        return S.let(
            edits,
            lambda e: S.let(
                S.crossing(e),
                lambda bad: F.struct(every.alias("spans"), F.when(~bad & ~lost, S.rewrite(F.col(text), e)).alias("text"), F.when(lost, "no session").when(bad, "overlapping spans").alias("error")),
            ),
        )

    rows = docs.withColumn("__p", S.let(pads(named), outbound))
    return rows.withColumns({spans: F.col("__p.spans"), "outbound_text": F.col("__p.text"), "outbound_error": F.col("__p.error")}).drop("__p")


def candidates(docs: DataFrame, spans: str = "general_spans") -> DataFrame:
    """One row a span of pseudonymised docs, with the order in which values were first seen."""
    # The outer form keeps the optimiser from testing size(spans) below, which would make the spans twice.
    rows = docs.select("doc_id", "session_id", F.posexplode_outer(spans).alias("seq", "s")).filter("s is not null").select("doc_id", "session_id", "seq", "s.*")
    return rows.withColumn("entity_category", category_of(F.col("entity_type")))


def first_mappings(spans: DataFrame) -> DataFrame:
    """The first occurrence of each (session, original, type), by doc_id and seq.

    A minimum by key has a map-side part, so a session that holds a third of all spans is no hot task;
    the key has the original in it and spreads by itself.
    """
    rest = [c for c in ("doc_id", "seq", "pseudonym", "entity_category", "mode", "confidence", "layer", "generalized_to") if c in spans.columns]
    first = spans.groupBy("session_id", "original", "entity_type").agg(F.min(F.struct(*rest)).alias("f"))
    return first.select("session_id", "original", "entity_type", "f.*")


def build_mappings(spans: DataFrame, vault: DataFrame | None = None) -> DataFrame:
    """New mappings: first occurrence wins, and what the vault holds already wins over all."""
    new = first_mappings(spans)
    return new if vault is None else new.join(vault.select("session_id", "original", "entity_type"), ["session_id", "original", "entity_type"], "left_anti")


def restore_text(replies: DataFrame, vault: DataFrame, text: str = "text") -> DataFrame:
    """replies (session_id, text, ...) with restored: reversible pseudonyms become their originals, others stay.

    Tokens have a fixed shape, so they are found once and joined to the vault by (session, token); a token that stands for several originals
    gives the smallest. Rows are numbered in a written table, so rows that share an id, or are equal, are restored each for itself. A token that very
    many rows of a session hold is one key of the join, whose token side Spark splits; the vault has one row for it. A null session or text stays as it is.
    """
    rows = materialise(replies.withColumn("__row", F.monotonically_increasing_id()), "replies")
    found = rows.select("__row", "session_id", S.each(S.scan(F.col(text), TOKEN)).alias("t")).filter("t is not null")
    tokens = found.select("__row", "session_id", "t.start", "t.end", F.col("t.text").alias("pseudonym"))
    two_way = vault.filter("mode = 'two_way'").groupBy("session_id", "pseudonym").agg(F.min("original").alias("original"))
    edits = tokens.join(two_way, ["session_id", "pseudonym"]).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("original").alias("new")))).alias("__edits"))
    done = rows.join(edits, "__row", "left")
    return done.withColumn("restored", S.rewrite(F.col(text), F.coalesce("__edits", S.none(S.EDIT)))).drop("__edits", "__row")


def restore_json_reply(replies: DataFrame, vault: DataFrame) -> DataFrame:
    """replies (session_id, body, ...) with restored_body: in the blocks of `content`, texts that are strings are restored.

    All other fields of the reply and of its blocks, and elements that are no objects, keep their values; a body without a restored text
    comes back letter for letter, another one with its keys in order. A body that is no object, or whose content is no list, stays as it is.
    """
    rows = materialise(replies.withColumn("__reply", F.monotonically_increasing_id()), "bodies")
    fields = F.expr("try_variant_get(try_parse_json(body), '$', 'map<string,variant>')")
    opened = rows.select("__reply", "session_id", F.posexplode(content_blocks(F.col("body"))).alias("place", "block"))
    texts = opened.select("__reply", "session_id", "place", string_field(F.col("block"), "text").alias("text")).filter(F.col("text").rlike(TOKEN))
    done = restore_text(texts, vault).filter("restored <> text")
    new = done.groupBy("__reply").agg(F.map_from_entries(F.collect_list(F.struct("place", "restored"))).alias("__new"))
    with_text = "to_variant_object(transform_values(try_variant_get(b, '$', 'map<string,variant>'), (k, x) -> CASE WHEN k = 'text' THEN CAST(try_element_at(__new, i) AS VARIANT) ELSE x END))"
    content = f"CAST(transform(try_variant_get(__fields['content'], '$', 'array<variant>'), (b, i) -> CASE WHEN try_element_at(__new, i) IS NULL THEN b ELSE {with_text} END) AS VARIANT)"
    body = F.expr(f"to_json(to_variant_object(transform_values(__fields, (name, value) -> CASE WHEN name = 'content' THEN {content} ELSE value END)))")
    whole = rows.join(new, "__reply", "left").withColumn("__fields", F.when(F.col("__new").isNotNull(), fields))
    return whole.withColumn("restored_body", F.when(F.col("__new").isNotNull(), body).otherwise(F.col("body"))).drop("__new", "__fields", "__reply")


def restore_foreign(text: Column, mapping: Column) -> Column:
    """Tokens of any shape, longest first: mapping is array<struct<token,original>>. For replies whose tokens lack the fixed shape."""
    ordered = F.array_sort(F.transform(mapping, lambda m: F.struct((-F.length(m["token"])).alias("n"), m["token"].alias("token"), m["original"].alias("original"))))
    return F.aggregate(ordered, text, lambda t, m: F.replace(t, m["token"], m["original"]))


def mask_with_codes(text: Column, spans: Column) -> Column:
    """The text with [CODE] for each span; a span that overlaps an earlier one is left out."""
    kept = S.resolve(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], F.concat(F.lit("["), code_of(s["entity_type"]), F.lit("]")).alias("new")))), S.EDIT)
    return S.let(kept, lambda edits: S.rewrite(text, edits))


def rekey_tokens(vault: DataFrame, key: bytes) -> DataFrame:
    """(session_id, old, new) tokens of the vault's values under a new key."""
    return vault.select("session_id", F.col("pseudonym").alias("old"), make_pseudonym(F.col("session_id"), F.col("entity_type"), F.col("original"), key).alias("new"))


def rekey_corpus(texts: DataFrame, vault: DataFrame, key: bytes, text: str = "outbound_text") -> DataFrame:
    """texts (session_id, outbound_text, ...) with the tokens of the new key; rows that share an id are rewritten each for itself."""
    tokens = rekey_tokens(vault, key).select("session_id", F.col("old").alias("pseudonym"), F.col("new").alias("original"), F.lit("two_way").alias("mode"))
    return restore_text(texts, tokens, text).withColumn(text, F.col("restored")).drop("restored")


def respan(text: Column, originals: Column) -> Column:
    """Spans for values without any: each is sought from the end of the one before, else from the start; what isn't found goes."""

    def step(state: Column, value: Column) -> Column:
        ahead = F.instr(F.substring(text, state["at"] + 1, F.length(text)), value)
        start = F.when(ahead > 0, state["at"] + ahead - 1).when(F.instr(text, value) > 0, F.instr(text, value) - 1)
        span = F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("text"))
        found = start.isNotNull() & (F.length(value) > 0)
        return F.struct(F.when(found, start + F.length(value)).otherwise(state["at"]).alias("at"), F.when(found, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    return F.aggregate(originals, F.struct(F.lit(0).alias("at"), S.none().alias("out")), step, lambda s: s["out"])


def session_entities(vault: DataFrame) -> DataFrame:
    """Mappings as entities whose span is the value itself."""
    return vault.select("session_id", "original", "entity_type", "pseudonym", F.lit(0).alias("start"), F.length("original").alias("end"))


def mapping_conflicts(vault: DataFrame) -> DataFrame:
    """Pseudonyms of a session that stand for more than one value."""
    return vault.groupBy("session_id", "pseudonym").agg(F.count_distinct("original").alias("originals")).filter("originals > 1")
