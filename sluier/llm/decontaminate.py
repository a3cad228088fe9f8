"""Benchmark decontamination: one Aho-Corasick automaton over normalised test questions and answers.

Both sides are lower-cased (A-Z) and cut into words. Each different word of the benchmark has a symbol, any
other word the symbol 0, so a text becomes one string of symbols that the automaton reads once; its
patterns are the windows of `window` consecutive words (a shorter item is one window). Hits are runs of word
places with their offsets in the original text.

The automaton's items are broadcast. A benchmark of more than SHARD characters is dealt into shards of about that size, long
items in parts whose windows are all those of the item; each shard's automaton then reads the texts in a pass of its own, and the runs
and items of all passes are united by document. So memory doesn't grow with the benchmark, and the results are the same.

Defined cases: null texts have no words; an item without words has no window; items that share a
window, or an item_id, all count, an id once; a null item_id takes no part; repeated documents are judged one by one; match() replaces a
column named contamination, keep_clean() keeps the columns as they are.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluier.llm import workers
from sluier.session import materialise

WINDOW = 10
#: Characters of a benchmark in one automaton (some 50 bytes of memory each), and windows of an item in one part.
SHARD, PART = 4_000_000, 20_000

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after lower-casing
_ANY_CASE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Matcher:
    """The automaton and the symbols of its words."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.symbols: dict[bytes, str] = {}
        patterns: dict[str, set[str]] = defaultdict(set)
        for item_id, text in items:
            coded = "".join(self.symbols.setdefault(w, self._symbol(len(self.symbols) + 1)) for w in words_of(text))
            for i in range(max(1, len(coded) - window + 1) if coded else 0):
                patterns[coded[i : i + window]].add(item_id)
        self.automaton = ahocorasick.Automaton()
        for pattern, ids in patterns.items():
            self.automaton.add_word(pattern, (len(pattern), tuple(sorted(ids))))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    @staticmethod
    def _symbol(i: int) -> str:
        return chr(i if i < 0xD800 else i + 0x800)

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words; hit words as runs [first, end); ids of the items found, sorted."""
        words = words_of(text)
        if self.empty:
            return len(words), [], []
        symbol = self.symbols.get
        runs: list[list[int]] = []
        items: set[str] = set()
        for last, (length, ids) in self.automaton.iter("".join([symbol(w, "\0") for w in words])):
            items.update(ids)
            first = last + 1 - length
            while runs and runs[-1][1] >= first:  # ends ascend; a longer window may begin before earlier runs
                first = min(first, runs.pop()[0])
            runs.append([first, last + 1])
        return len(words), [(a, b) for a, b in runs], sorted(items)


def spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets [start, end) of runs of words in the original text."""
    if not runs:
        return []
    places = [m.span() for m in _ANY_CASE.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in runs]


_RUN = T.StructType([T.StructField(c, T.IntegerType()) for c in ("first", "last", "start", "end")])
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("runs", T.ArrayType(_RUN))])
_KIND = pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("runs", pa.list_(pa.struct([(c, pa.int32()) for c in ("first", "last", "start", "end")])))])

_matchers: dict[tuple[str, int], Matcher] = {}


def _matcher(items, name: str, window: int) -> Matcher:
    """The worker's automaton for a broadcast list."""
    if (name, window) not in _matchers:
        _matchers.clear()
        _matchers[name, window] = Matcher(items.value, window)
    return _matchers[name, window]


def _parts_of(benchmark: DataFrame, item_id: str, item_text: str, window: int) -> DataFrame:
    """(id, text) of items in parts of at most PART windows, the words joined by blanks."""
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), _words(F.col(item_text)).alias("w")).filter("id is not null and size(w) > 0").distinct()
    n = F.ceil(F.greatest(F.size("w") - (window - 1), F.lit(1)) / PART).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice("w", i * PART + 1, F.lit(PART + window - 1)), " "))
    return items.select("id", F.explode(parts).alias("text"))


def _finder(spark: SparkSession, parts: DataFrame, window: int):
    """(broadcast, function): the function finds items and runs in a text column by the automaton of these parts."""
    listed = spark.sparkContext.broadcast([(r["id"], r["text"]) for r in parts.collect()])
    name = uuid.uuid4().hex

    @F.arrow_udf(_FOUND)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        workers.turn("decontaminate", _matchers.clear)
        matcher = _matcher(listed, name, window)
        for batch in batches:
            out = []
            for x in batch:
                text = x.as_py()
                n, runs, ids = matcher.hits(text)
                placed = [{"first": a, "last": b, "start": c, "end": d} for (a, b), (c, d) in zip(runs, spans(text or "", runs), strict=True)]
                out.append({"n_words": n, "items": ids, "runs": placed})
            yield pa.array(out, _KIND)

    return listed, found


def _told(found: Column) -> Column:
    """n_words, n_hit, items, spans of what was found."""
    runs = found["runs"]
    hit = F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    return F.struct(found["n_words"].alias("n_words"), hit.alias("n_hit"), found["items"].alias("items"), F.transform(runs, lambda r: F.struct(r["start"], r["end"])).alias("spans"))


def united(runs: list[dict]) -> list[dict]:
    """Runs that overlap or touch become one."""
    out: list[dict] = []
    for run in sorted(runs, key=lambda r: (r["first"], r["last"])):
        if out and run["first"] <= out[-1]["last"]:
            if run["last"] > out[-1]["last"]:
                out[-1] = out[-1] | {"last": run["last"], "end": run["end"]}
        else:
            out.append(run)
    return out


@F.arrow_udf(T.ArrayType(_RUN))
def _united(batch: pa.Array) -> pa.Array:
    return pa.array([united(x.as_py()) for x in batch], _KIND.field("runs").type)


def match(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """docs with a struct `contamination`: n_words, n_hit, items, spans (code points of the original text)."""
    spark = docs.sparkSession
    parts = _parts_of(benchmark, item_id, item_text, window)
    size = parts.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard))
    if shards == 1:
        return docs.withColumn("__found", _finder(spark, parts, window)[1](F.col(text))).withColumn("contamination", _told(F.col("__found"))).drop("__found")
    # Written once, so that a row has the same number in each pass.
    rows = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    passes = None
    for i in range(shards):
        listed, found = _finder(spark, parts.filter(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == i), window)
        told = materialise(rows.select("__row", found(F.col(text)).alias("f")).filter((F.size("f.runs") > 0) | F.lit(i == 0)), "shard")
        passes = told if passes is None else passes.unionByName(told)
        listed.destroy()
    every = lambda c: F.flatten(F.collect_list(f"f.{c}")).alias(c)  # noqa: E731  (a document has one row a pass at most)
    whole = passes.groupBy("__row").agg(F.max("f.n_words").alias("n_words"), F.array_sort(F.array_distinct(every("items"))).alias("items"), every("runs"))
    whole = whole.select("__row", F.struct("n_words", "items", _united(F.col("runs")).alias("runs")).alias("__found"))
    return rows.join(whole, "__row").withColumn("contamination", _told(F.col("__found"))).drop("__row", "__found")


def _words(text: Column) -> Column:
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))


def op2(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    c = "contamination"
    return match(docs.select("doc_id", "text"), benchmark).select(
        "doc_id",
        f"{c}.n_words",
        f"{c}.n_hit",
        F.size(f"{c}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{c}.items", ","), 256).alias("items_sha256"),
        (F.col(f"{c}.n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
item_window AS (
  SELECT DISTINCT id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS p
  FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
doc AS (
  SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
hit AS (
  SELECT row_no, i AS first, n, id
  FROM (SELECT row_no, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
        FROM doc, (SELECT DISTINCT n FROM item_window) AS lengths, unnest(range(1, len(w) - n + 2)) AS r(i) WHERE len(w) >= n)
  JOIN item_window USING (n, p)),
ids AS (SELECT row_no, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS items FROM (SELECT DISTINCT row_no, id FROM hit) GROUP BY row_no),
places AS (SELECT row_no, count(DISTINCT place) AS n_hit FROM hit, unnest(range(first, first + n)) AS r(place) GROUP BY row_no)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN ids USING (row_no) LEFT JOIN places USING (row_no)
"""


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a window of the benchmark; the columns stay."""
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), F.col("text").alias("__text"))
    return match(kept, benchmark, text="__text").filter("contamination.n_hit = 0").select("__doc.*")
