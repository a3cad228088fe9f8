"""Spans in one text: find, choose, rewrite. Offsets are half-open, in code points, from 0.

Everything here is row by row: arrays of structs that hold start and end, folded by aggregate().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FOUND = "array<struct<start:int,end:int,text:string>>"
#: Matches that are folded at once.
CHUNK = 256
#: Spans that are compared each with each; more are cut into groups first.
FEW = 24
EDIT = "array<struct<start:int,end:int,new:string>>"


def java(pattern: str) -> str:
    """The Java spelling: \\w \\b \\d \\s and letter case follow Unicode."""
    return f"(?iU){pattern[4:]}" if pattern.startswith("(?i)") else f"(?U){pattern}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often (or inside whatever lambda) it is referred to.

    It is the start of a fold of nothing, which, unlike an element of a transformed array, isn't copied.
    """
    return F.aggregate(F.array(), value, lambda same, _: same, use)


def each(spans: Column | str) -> Column:
    """The elements of an array that is made in the row, one a row; an empty array gives a null, to be filtered out.

    The plain form lets the optimiser test the array's size further below, where it is made a second time, and what it is made of once for each element.
    """
    return F.explode_outer(spans)


def none(kind: str = FOUND) -> Column:
    return F.array().cast(kind)


def blocks(items: Column) -> Column:
    """An array in parts of CHUNK elements."""

    def parts(every: Column) -> Column:
        n = F.ceil(F.size(every) / CHUNK).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(every, i * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.slice(F.array(every), 1, 0))

    return let(items, parts)


def walk(items: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """Fold items with a state (at int, out array of kind); by blocks, so that a long array isn't copied for each of its elements. The result is out."""

    def block(state: Column, some: Column) -> Column:
        folded = F.aggregate(some, F.struct(state["at"].alias("at"), none(kind).alias("out")), step)
        return let(folded, lambda f: F.struct(f["at"].alias("at"), F.concat(state["out"], f["out"]).alias("out")))

    return F.aggregate(blocks(items), F.struct(F.lit(0).alias("at"), none(kind).alias("out")), block, lambda s: s["out"])


#: Stands between matches and what is around them; a text that holds it is matched in two passes.
MARK = "\x01"


def scan(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """All matches of a pattern, leftmost first, not overlapping: (start, end, text); those for which keep() is false go."""
    rx = java(pattern)

    def step(state: Column, part: Column) -> Column:
        end = state["at"] + F.length(part["text"])
        span = F.struct(state["at"].alias("start"), end.alias("end"), part["text"].alias("text"))
        good = part["match"] if keep is None else part["match"] & keep(part["text"])
        return F.struct(end.alias("at"), F.when(good, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    # One pass puts marks around the matches; pieces then alternate between gaps and matches. In ASCII texts the Unicode classes
    # tell nothing more, and cost three times as much.
    ascii_only = F.octet_length(text) == F.length(text)
    put = lambda r: F.regexp_replace(text, r, f"{MARK}$0{MARK}")
    marked = F.split(F.when(ascii_only, put(pattern)).otherwise(put(rx)), MARK, -1)
    matches, gaps = F.regexp_extract_all(text, F.lit(rx), F.lit(0)), F.split(text, rx, -1)
    plain = F.flatten(F.transform(gaps, lambda g, i: F.when(i < F.size(matches), F.array(g, F.get(matches, i))).otherwise(F.array(g))))
    pieces = F.when(F.contains(text, F.lit(MARK)), plain).otherwise(marked)
    parts = lambda every: F.transform(every, lambda p, i: F.struct(p.alias("text"), (i % 2 == 1).alias("match")))

    def only(every: Column) -> Column:
        # A single match, the most common case, needs no fold.
        start, found = F.length(every[0]), every[1]
        one = F.array(F.struct(start.alias("start"), (start + F.length(found)).alias("end"), found.alias("text")))
        return one if keep is None else F.when(keep(found), one).otherwise(none())

    def few(every: Column) -> Column:
        # The lengths before each match are added up anew, which for some matches is cheaper than a fold that builds an array.
        def at(lengths: Column, i: Column) -> Column:
            start = F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda n, x: n + x)
            return let(start, lambda n: F.struct(n.alias("start"), (n + F.get(lengths, i)).alias("end"), F.get(every, i).alias("text")))

        found = let(F.transform(every, lambda p: F.length(p)), lambda lengths: F.transform(F.sequence(F.lit(1), F.size(every) - 2, F.lit(2)), lambda i: at(lengths, i)))
        return found if keep is None else F.filter(found, lambda s: keep(s["text"]))

    told = lambda every: F.when(F.size(every) == 1, none()).when(F.size(every) == 3, only(every)).when(F.size(every) <= 2 * FEW + 1, few(every)).otherwise(walk(parts(every), step, FOUND))
    return let(pieces, told)


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def resolve(spans: Column, kind: str) -> Column:
    """Greedy choice in the order given: a span that overlaps one already taken is dropped. kind: the array's type.

    What is taken depends only on spans that hang together by overlaps. So a long array is sorted by start and cut wherever no
    earlier span reaches; each group then chooses for itself, and the order given comes back by sorting.
    """
    greedy = lambda some: F.aggregate(some, none(kind), lambda taken, x: F.when(F.exists(taken, lambda y: overlap(x, y)), taken).otherwise(F.concat(taken, F.array(x))))
    item = kind[len("array<") : -1]
    numbered = lambda every: F.array_sort(F.transform(every, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("i"), s.alias("s"))))

    def reach(state: Column, x: Column) -> Column:
        begins = x["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.concat(state["out"], F.array(begins)).alias("out"))

    def grouped(every: Column) -> Column:
        begins = F.filter(F.transform(walk(every, reach, "array<boolean>"), lambda b, i: F.when(b, i)), lambda i: i.isNotNull())
        return let(begins, lambda at: F.transform(at, lambda p, j: F.slice(every, p + 1, F.coalesce(F.get(at, j + 1), F.size(every)) - p)))

    def chosen(group: Column) -> Column:
        first = F.array_sort(F.transform(group, lambda x: F.struct(x["i"].alias("i"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"))))
        taken = lambda some: F.aggregate(some, none(f"array<struct<i:int,start:int,end:int,s:{item}>>"), lambda t, x: F.when(F.exists(t, lambda y: overlap(x, y)), t).otherwise(F.concat(t, F.array(x))))
        return let(first, lambda some: F.when(F.size(some) == 1, some).otherwise(taken(some)))

    many = lambda some: let(numbered(some), lambda every: F.transform(F.array_sort(F.flatten(F.transform(grouped(every), chosen))), lambda x: x["s"])).cast(kind)
    return let(spans, lambda some: F.when(F.size(some) <= FEW, greedy(some)).otherwise(many(some)))


def crossing(edits: Column) -> Column:
    """Whether two edits of an array sorted by start overlap."""
    ends = F.aggregate(
        edits,
        F.struct(F.lit(0).alias("end"), F.lit(False).alias("bad")),
        lambda s, e: F.struct(F.greatest(s["end"], e["end"]).alias("end"), (s["bad"] | (e["start"] < s["end"])).alias("bad")),
        lambda s: s["bad"],
    )
    return ends


def stretches(text: Column, spans: Column) -> Column:
    """The parts of a text at spans (start, end) that are sorted by both. A block's stretch is taken from the text once, and its parts from there."""

    def of(b: Column) -> Column:
        first = b[0]["start"]
        own = F.substring(text, first + 1, F.element_at(b, -1)["end"] - first)
        return let(own, lambda o: F.transform(b, lambda s: F.substring(o, s["start"] - first + 1, s["end"] - s["start"])))

    return F.flatten(F.transform(blocks(spans), of))


def rewrite(text: Column, edits: Column) -> Column:
    """The text with each edit's stretch replaced by its `new`; edits: sorted, without overlap."""
    gaps = F.transform(edits, lambda e, i: F.struct(F.when(i > 0, F.get(edits, i - 1)["end"]).otherwise(0).alias("start"), e["start"].alias("end")))
    parts = let(stretches(text, gaps), lambda kept: F.flatten(F.transform(edits, lambda e, i: F.array(F.get(kept, i), e["new"]))))
    rest = F.substring(text, F.element_at(edits, -1)["end"] + 1, F.lit(2**31 - 1))
    return F.when(F.size(edits) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(text)


def moved(positions: Column, edits: Column) -> Column:
    """Where positions (an array) lie after the edits that end at or before each; edits and positions are sorted together and walked once."""
    kind = "array<struct<i:int,to:int>>"
    # Of an edit and a position at the same place the edit comes first.
    events = F.concat(
        F.transform(edits, lambda e: F.struct(e["end"].alias("place"), F.lit(-1).alias("i"), (F.length(e["new"]) - (e["end"] - e["start"])).alias("by"))),
        F.transform(positions, lambda p, i: F.struct(p.alias("place"), i.alias("i"), F.lit(0).alias("by"))),
    )

    def step(state: Column, e: Column) -> Column:
        told = F.array(F.struct(e["i"].alias("i"), (e["place"] + state["at"]).alias("to")))
        return F.struct((state["at"] + e["by"]).alias("at"), F.when(e["i"] < 0, state["out"]).otherwise(F.concat(state["out"], told)).alias("out"))

    many = F.transform(F.array_sort(walk(F.array_sort(events), step, kind)), lambda x: x["to"])
    # Of few edits: where each ends, and by how much it and those before it move what follows.
    ends = F.transform(edits, lambda e: e["end"])
    by = F.transform(edits, lambda e: F.length(e["new"]) - (e["end"] - e["start"]))
    sums = let(by, lambda every: F.transform(every, lambda _, i: F.aggregate(F.slice(every, F.lit(1), i + 1), F.lit(0), lambda n, x: n + x)))
    shift = lambda position, e, n: position + F.coalesce(F.get(n, F.size(F.filter(e, lambda end: end <= position)) - 1), F.lit(0))
    some = let(ends, lambda e: let(sums, lambda n: F.transform(positions, lambda position: shift(position, e, n))))
    return F.when(F.size(edits) <= FEW, some).otherwise(many)
