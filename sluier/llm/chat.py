"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log has one row per event: conv_id, message, part, seq, role, kind, text. Kinds: `delta` adds text to its
message, `edit` puts its text in the place of all before, `regenerate` empties the message for
the deltas that follow; other kinds (such as a `start` that tells the role) add nothing. The log is partitioned by
conversation and message, sorted by seq and folded to the final message; the final messages are then gathered by
conversation. So a long conversation isn't gathered with all its events. A table of finished turns is
turned into such a log by log_of(): some turns are streamed, some regenerated, some edited.

Rendering: <|im_start|>role\\ntext<|im_end|>\\n for each turn. Control strings inside roles and texts get one
more backslash after their first character (any that are there already are kept), so no control string
is left and taking one backslash away restores the text. In a role a backslash is written \\s and a line feed \\n.

Defined cases: null text and null role count as empty; a null conv_id is a conversation of its own; a null message number
comes first; messages with the same number are told apart by part and ordered by role, then text; a repeated turn stays twice; a conversation
always has a row if it has an event; a message whose events are all regenerations has an empty text; the role is that of the last event that has
one; columns other than these are not read. A conversation is one row of the result, so all its text must fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluier.functions.spans import let, walk
from sluier.llm.arrays import stretches

# The strings that steer a chat model; (first character, rest).
CONTROL = r"([\[<])(\\*)(/?INST\]|/?s>|</?SYS>>|\|im_start\|>|\|im_end\|>)"
ESCAPED = r"([\[<])\\(\\*)(/?INST\]|/?s>|</?SYS>>|\|im_start\|>|\|im_end\|>)"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

# The conversation that every result holds besides those of the table.
EXTRA = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


#: Characters of a streamed piece.
PIECE = 256


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _role_out(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def log_of(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """Finished turns (conv_id, turn, role, text) as the log of a chat server: each turn is a message that starts with its role.

    By a hash of the turn a fourth of them is streamed in pieces, a fourth begun and regenerated, a fourth begun and edited to its first
    half before the rest is streamed, and a fourth put right by an edit at the end.
    """
    text, none_ = F.coalesce("text", F.lit("")), F.lit(None).cast("string")
    event = lambda kind, body, role=none_: F.struct(F.lit(kind).alias("kind"), body.alias("text"), role.alias("role"))

    def deltas(body: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.floor((F.length(body) - 1) / piece).cast("int"), F.lit(0)))
        return F.transform(places, lambda i: event("delta", F.substring(body, i * piece + 1, F.lit(piece))))

    half = F.floor(F.length(text) / 2).cast("int")
    begun, start = event("delta", F.substring(text, 1, piece)), F.array(event("start", none_, F.col("role")))
    way = F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(4))
    rest = (
        F.when(way == 0, deltas(text))
        .when(way == 1, F.concat(F.array(begun, event("regenerate", none_)), deltas(text)))
        .when(way == 2, F.concat(F.array(begun, event("edit", F.substring(text, F.lit(1), half))), deltas(F.substring(text, half + 1, F.length(text)))))
        .otherwise(F.array(begun, event("edit", text)))
    )
    # The row's number tells repeated turns apart; it is the same however often a part of the table is read.
    turns = conversations.select("conv_id", F.col("turn").alias("message"), F.monotonically_increasing_id().alias("part"), F.concat(start, rest).alias("events"))
    turns = turns.select("conv_id", "message", "part", F.posexplode("events").alias("seq", "e"))
    return turns.select("conv_id", "message", "part", "seq", "e.role", "e.kind", "e.text")


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, message, part, role, text): the fold of each message's events in the order of seq."""
    step = F.struct("seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    by_message = events.groupBy("conv_id", "message", "part").agg(F.array_sort(F.collect_list(step)).alias("steps"))

    def folded(steps: Column) -> Column:
        resets = F.filter(F.transform(steps, lambda s, i: F.when(s["kind"].isin("edit", "regenerate"), i)), lambda i: i.isNotNull())
        live = F.filter(F.slice(steps, F.coalesce(F.array_max(resets), F.lit(0)) + 1, F.size(steps)), lambda s: s["kind"].isin("edit", "delta"))
        roles = F.filter(F.transform(steps, lambda s: s["role"]), lambda r: r.isNotNull())
        return F.struct(F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), F.array_join(F.transform(live, lambda s: s["text"]), "").alias("text"))

    return by_message.select("conv_id", "message", "part", let(F.col("steps"), folded).alias("m")).select("conv_id", "message", "part", "m.role", "m.text")


def render(final: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, mask): one string a conversation; mask: spans (start, end) in it that carry loss."""
    whole = final.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("message", "role", "text", "part"))).alias("turns"))

    def shown(t: Column) -> Column:
        lead = F.concat(F.lit(OPEN), _role_out(t["role"]), F.lit("\n"))
        return F.struct((t["role"] == trained).alias("loss"), lead.alias("lead"), escaped(t["text"]).alias("body"))

    def add(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["lead"])
        end = start + F.length(t["body"])
        mask = F.when(t["loss"], F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(state["out"])
        return F.struct((end + len(CLOSE)).alias("at"), mask.alias("out"))

    pieces = whole.select("conv_id", F.transform("turns", shown).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["lead"], t["body"], F.lit(CLOSE))), "")
    return pieces.select("conv_id", formatted.alias("formatted"), walk(F.col("turns"), add, "array<struct<start:int,end:int>>").alias("mask"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            _role_in(F.substring(p, F.length(F.lit(OPEN)) + 1, F.instr(p, "\n") - F.length(F.lit(OPEN)) - 1)).alias("role"),
            unescaped(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text"),
        ),
    )


def op3(conversations: DataFrame) -> DataFrame:
    extra = conversations.sparkSession.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    shown = render(messages(log_of(rows)))
    turns = shown.withColumn("turns", read_back(F.col("formatted")))
    loss = F.array_join(F.transform(stretches(F.col("formatted"), F.col("mask")), unescaped), "")
    return turns.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_SQL_CONTROL, _SQL_ROLE = CONTROL.replace("'", "''"), "replace(replace(role, '\\', '\\s'), chr(10), '\\n')"

OP3_SQL = f"""
WITH row_of AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (
  SELECT *, '<|im_start|>' || regexp_replace({_SQL_ROLE}, '{_SQL_CONTROL}', '\\1\\\\\\2\\3', 'g') || chr(10)
    || regexp_replace(text, '{_SQL_CONTROL}', '\\1\\\\\\2\\3', 'g') || '<|im_end|>' || chr(10) AS piece
  FROM row_of)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""
