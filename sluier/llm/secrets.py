"""Secret scans with multipart credential linking, in DataFrame functions only.

Base finds (assignments, access identifiers, hexadecimal keys) stand by themselves. Weak candidates (user
names, bare 40-character keys, endpoints) are joined by their intervals: within a scope of SCOPE
characters around it a candidate must meet the parts that complete it, else it isn't reported:
a user name needs a secret, a bare key an identifier, an endpoint both. The interval join runs on the
spans of one row, so nothing is shuffled and a hot source or a repeated document costs no more than its text. Spans are
sorted by start and held in blocks with their bounds, so a candidate is compared with the spans of blocks near it only.

Defined cases: null text counts as empty and has no spans; a match that fails its length is dropped and
still consumes its text; a weak candidate that overlaps a base find is dropped; ties in start are
ordered by kind; offsets are code points, end exclusive. find() replaces columns named base or linked, redact() keeps
all columns but the text and n_chars; repeated rows are scanned one by one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluier.functions.spans import blocks, let, none, walk

# The kinds in the order in which they are listed, with their patterns (Java and RE2 alike).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
USER = r"""(?i:(user_?name|user|login|client_?id|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)"""
KEY = r"[A-Za-z0-9+/=]{40,}"
# A scheme is a whole run of its signs. What stands before it only spares Java the other beginnings in that run; RE2 needs no such help.
_ENDPOINT_TAIL = r"""://[^\x00-\x20"'<>]+"""
ENDPOINT = r"(?<![a-z][0-9+]{0,31})[a-z][a-z0-9+]*+" + _ENDPOINT_TAIL
ENDPOINT_RE2 = r"[a-z][a-z0-9+]*" + _ENDPOINT_TAIL
KINDS = ["assign", "access", "hex", "user", "key", "endpoint"]

LEAST_ASSIGNED, KEY_LENGTH, SCOPE = 6, 40, 200
MASK = "[SECRET]"

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, keep: Callable[[Column, Column], Column] | None = None) -> Column:
    """All matches as (start, kind, end); keep(match, value) tells those that count, value being group 2 of the pattern if it has one."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if pattern == ASSIGN else found
    parts = F.arrays_zip(found.alias("m"), gaps.alias("g"), values.alias("v"))

    def add(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["g"])
        end = start + F.coalesce(F.length(part["m"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        counts = part["m"].isNotNull() if keep is None else part["m"].isNotNull() & keep(part["m"], part["v"])
        more = F.when(counts, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(end.alias("at"), more.alias("out"))

    return F.when(text.rlike(pattern), let(parts, lambda every: walk(every, add, _SPANS))).otherwise(none(_SPANS))


def _bounded(spans: Column) -> Column:
    """Spans sorted by start, in blocks with the least start and the greatest end of each."""
    bounds = lambda b: F.struct(b[0]["start"].alias("low"), F.array_max(F.transform(b, lambda s: s["end"])).alias("high"), b.alias("spans"))
    return F.transform(blocks(F.array_sort(spans)), bounds)


def _meets(bounded: Column, span: Column, reach: int) -> Column:
    """Whether a span is at most reach characters away from one of the spans; -1: whether it overlaps one."""
    near = lambda low, high: (low <= span["end"] + reach) & (high >= span["start"] - reach)
    return F.exists(bounded, lambda b: near(b["low"], b["high"]) & F.exists(b["spans"], lambda s: near(s["start"], s["end"])))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `base` and `linked`: arrays of (start, kind, end), kind as a place in KINDS; sorted."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = F.struct(_spans(t, ASSIGN, 0, lambda m, v: F.length(v) >= LEAST_ASSIGNED).alias("assign"), _spans(t, ACCESS, 1).alias("access"), _spans(t, HEX, 2).alias("hex"))
    rows = docs.withColumn("__base", parts)
    rows = rows.withColumn("base", F.array_sort(F.concat("__base.assign", "__base.access", "__base.hex")))
    # A text without any base find and without a bare key has nothing to link.
    worth = (F.size("base") > 0) | t.rlike(KEY)
    weak = F.struct(_spans(t, USER, 3).alias("user"), _spans(t, KEY, 4, lambda m, v: F.length(m) == KEY_LENGTH).alias("key"), _spans(t, ENDPOINT, 5).alias("endpoint"))

    def link(w: Column) -> Column:
        free = lambda b: F.struct(*(F.filter(w[k], lambda s: ~_meets(b, s, -1)).alias(k) for k in ("user", "key", "endpoint")))
        return let(_bounded(F.col("base")), lambda b: let(free(b), complete))

    def complete(w: Column) -> Column:
        sides = F.struct(_bounded(F.concat("__base.access", w["user"])).alias("identifiers"), _bounded(F.concat("__base.assign", "__base.hex", w["key"])).alias("secrets"))
        return let(
            sides,
            lambda x: F.concat(
                F.filter(w["user"], lambda s: _meets(x["secrets"], s, SCOPE)),
                F.filter(w["key"], lambda s: _meets(x["identifiers"], s, SCOPE)),
                F.filter(w["endpoint"], lambda s: _meets(x["identifiers"], s, SCOPE) & _meets(x["secrets"], s, SCOPE)),
            ),
        )

    return rows.withColumn("linked", F.when(worth, F.array_sort(let(weak, link))).otherwise(none(_SPANS))).drop("__base")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each region that the spans (sorted) cover replaced by MASK."""
    kind = "array<struct<start:int,end:int,new:boolean>>"

    def cut(state: Column, s: Column) -> Column:
        # What a span adds to the regions before it: a new region, or an end further on.
        part = F.struct(F.greatest(s["start"], state["at"]).alias("start"), F.greatest(s["end"], state["at"]).alias("end"), ((s["start"] >= state["at"])).alias("new"))
        return F.struct(part["end"].alias("at"), F.concat(state["out"], F.array(part)).alias("out"))

    def shown(parts: Column) -> Column:
        # Each block's stretch of the text is taken once, its parts from that.
        return let(blocks(parts), lambda every: F.concat(F.array_join(F.transform(every, lambda b, i: stretch(b, F.when(i > 0, F.element_at(F.get(every, i - 1), -1)["end"]).otherwise(0))), ""), F.substring(text, F.element_at(parts, -1)["end"] + 1, F.lit(2**31 - 1))))

    def stretch(b: Column, at: Column) -> Column:
        def piece(own: Column) -> Column:
            before = lambda i: F.when(i > 0, F.get(b, i - 1)["end"]).otherwise(at)
            return F.array_join(F.transform(b, lambda p, i: F.when(p["new"], F.concat(F.substring(own, before(i) - at + 1, p["start"] - before(i)), F.lit(MASK))).otherwise("")), "")

        return let(F.substring(text, at + 1, F.element_at(b, -1)["end"] - at), piece)

    return F.when(F.size(spans) > 0, let(spans, lambda every: let(walk(every, cut, kind), shown))).otherwise(text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with all spans masked in the text; columns stay, n_chars (where there is one) follows the text."""
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), F.col(text).alias("__text"))
    found = find(kept, "__text")
    new = found.withColumn("__new", masked(F.col("__text"), F.array_sort(F.concat("base", "linked"))))
    changed = {text: F.col("__new")} | ({"n_chars": F.length("__new").cast("bigint")} if "n_chars" in docs.columns else {})
    return new.select(*(changed[c].alias(c) if c in changed else F.col(f"__doc.`{c}`") for c in docs.columns))


def op10(docs: DataFrame) -> DataFrame:
    found = find(docs.select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "linked"))).alias("spans"),
    )


def _sql_spans(name: str, pattern: str, kind: int, keep: str = "true") -> str:
    p = pattern.replace("'", "''")
    return f"""list_filter([{{'start': CAST(coalesce(list_sum([length(x) for x in g[1:i]]), 0) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) AS INT), 'kind': {kind},
      'end': CAST(coalesce(list_sum([length(x) for x in g[1:i]]), 0) + coalesce(list_sum([length(x) for x in m[1:i]]), 0) AS INT), 'ok': {keep}}} for i in range(1, len(m) + 1)], lambda s: s.ok)
    FROM (SELECT regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS g, {"regexp_extract_all(t, '" + p + "', 2)" if "v[i]" in keep else "NULL"} AS v)"""


OP10_SQL = f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT doc_id,
    (SELECT {_sql_spans("a", ASSIGN, 0, f"length(v[i]) >= {LEAST_ASSIGNED}")}) AS assigns,
    (SELECT {_sql_spans("b", ACCESS, 1)}) AS accesses, (SELECT {_sql_spans("c", HEX, 2)}) AS hexes,
    (SELECT {_sql_spans("d", USER, 3)}) AS users0, (SELECT {_sql_spans("e", KEY, 4, f"length(m[i]) = {KEY_LENGTH}")}) AS keys0, (SELECT {_sql_spans("f", ENDPOINT_RE2, 5)}) AS ends0
  FROM doc),
based AS (SELECT *, list_sort(assigns || accesses || hexes) AS base FROM found),
freed AS (
  SELECT *, list_filter(users0, lambda w: len(list_filter(base, lambda b: b.start < w.end AND w.start < b.end)) = 0) AS users,
    list_filter(keys0, lambda w: len(list_filter(base, lambda b: b.start < w.end AND w.start < b.end)) = 0) AS keys,
    list_filter(ends0, lambda w: len(list_filter(base, lambda b: b.start < w.end AND w.start < b.end)) = 0) AS ends
  FROM based),
roles AS (SELECT *, accesses || users AS ids, assigns || hexes || keys AS secrets FROM freed),
linked AS (
  SELECT *, list_sort(base
    || list_filter(users, lambda w: len(list_filter(secrets, lambda s: s.start <= w.end + {SCOPE} AND s.end >= w.start - {SCOPE})) > 0)
    || list_filter(keys, lambda w: len(list_filter(ids, lambda s: s.start <= w.end + {SCOPE} AND s.end >= w.start - {SCOPE})) > 0)
    || list_filter(ends, lambda w: len(list_filter(ids, lambda s: s.start <= w.end + {SCOPE} AND s.end >= w.start - {SCOPE})) > 0
         AND len(list_filter(secrets, lambda s: s.start <= w.end + {SCOPE} AND s.end >= w.start - {SCOPE})) > 0)) AS every
  FROM roles)
SELECT doc_id, CAST(len(assigns) AS BIGINT) AS n_assign, CAST(len(accesses) AS BIGINT) AS n_access, CAST(len(hexes) AS BIGINT) AS n_hex,
  sha256(array_to_string([(['assign', 'access', 'hex', 'user', 'key', 'endpoint'])[s.kind + 1] || ':' || s.start || ':' || s.end for s in base], ',')) AS base_sha256,
  coalesce(array_to_string([(['assign', 'access', 'hex', 'user', 'key', 'endpoint'])[s.kind + 1] || ':' || s.start || ':' || s.end for s in every], ','), '') AS spans
FROM linked
"""
