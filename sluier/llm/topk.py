"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Components are whole numbers, floor(scale * x). In a block of vectors the index holds, for each
level of quantised impact (|value| from 2**l up to 2**(l+1) - 1), a posting segment: the vectors and dimensions that have
a value of that level, and the values, packed. Levels are processed from the highest down.
After a level a vector's score so far and what its unread postings can still add or take away (the
query's and the vector's remaining lengths, by Cauchy and Schwarz) bound its true score; a vector whose upper bound is
below what the k-th best surely has can't be a member. Reading of further segments stops for a block once
few enough possible members are left, and only those are rescored exactly from the whole vectors. Bounds
compare with >=, so ties stay in until the exact scores decide.

Queries come in groups of bounded size (AT_ONCE bytes), which are broadcast; for each group the vectors are read once,
where they lie, and never shuffled. Before that a sample of the vectors (one in SAMPLE) gives each query a k-th best that the whole
table can only raise; tasks carry the k best of each query from block to block and return what beats that bound, so
a task returns at most k rows a query, and the k best of all tasks are ranked.

Defined cases: vectors that are null, or hold null or non-finite components, and rows with a null id take no part; vectors
of different lengths are compared as if the shorter ended in zeros; an empty vector scores 0 with all; rows that repeat an
id are vectors of their own, none of them is a candidate of a query with that id, and each of them that is a query is answered; ties go to the
smaller id; columns other than id and vector are not read. Scores beyond 2**53 are made of Python's whole numbers, held to the range of a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluier.session import materialise

K, SCALE = 20, 64
#: Queries and vectors that are compared at once.
QUERIES, VECTORS = 512, 4096
#: Bytes of queries that are broadcast at once, at most.
AT_ONCE = 32 << 20
#: One vector in so many gives the first bounds.
SAMPLE = 32
#: Share of a block's vectors that may be left when the reading of segments stops.
FEW = 0.05


class ImpactIndex:
    """Posting segments of a block of whole-number vectors, by level of impact."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        size = np.abs(vectors)
        top = int(size.max()).bit_length() if vectors.size else 0
        self.segments = []  # vectors, dimensions, values, lengths of what is unread after it
        rest = vectors.copy()
        for level in range(top, 0, -1):
            here = (size >= 1 << (level - 1)) & (size < 1 << level)
            rows, dims = np.flatnonzero(here.any(axis=1)), np.flatnonzero(here.any(axis=0))
            if len(rows):
                held = np.where(here, vectors, 0.0)
                rest -= held
                self.segments.append((rows, dims, np.ascontiguousarray(held[np.ix_(rows, dims)].T), np.sqrt((rest * rest).sum(axis=1))))

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray, few: float = FEW) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query (its place): places of its possible members and their exact scores; own id and what surely scores below least are left out."""
        n = len(self.vectors)
        alive = own[:, None] != ids[None, :]
        length = np.sqrt((queries * queries).sum(axis=1))
        scores = np.zeros((len(queries), n))
        for rows, dims, values, rest in self.segments:
            if alive.sum() <= few * alive.size:
                break
            part = queries[:, dims] @ values
            if len(rows) == n:
                scores += part
            else:
                scores[:, rows] += part
            # A margin for the rounding of lengths; scores are whole numbers and exact.
            reach = length[:, None] * rest[None, :] * (1 + 1e-9) + 1e-6
            sure = least
            if n > k:
                low = np.where(alive, scores - reach, -np.inf)
                sure = np.maximum(least, np.partition(low, n - k, axis=1)[:, n - k])
            alive &= scores + reach >= sure[:, None]
        for q in np.flatnonzero(alive.any(axis=1)):
            members = np.flatnonzero(alive[q])
            yield q, members, self.vectors[members] @ queries[q]


def _plain(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Scores of components too large for doubles, in Python's whole numbers, held to the range of a long."""
    listed = vectors.tolist()
    for i, q in enumerate(queries.tolist()):
        members = np.flatnonzero(ids != own[i])
        yield i, members, np.array([max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, listed[m], strict=True)))) for m in members], np.int64)


def _matrix(values: pa.Array, wide: int) -> np.ndarray:
    """Rows of a list array as whole numbers, cut or filled with zeros to a width."""
    sizes = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(values)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(values), wide), np.int64)
    fit = at < wide
    out[rows[fit], at[fit]] = values.flatten().to_numpy(zero_copy_only=False)[fit]
    return out


class _Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int, scores: np.ndarray, ids: np.ndarray):
        # A bound from the sample counts, but is no row of the result.
        self.k, self.bound, self.bound_id = k, scores, ids
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.least = scores.astype(np.float64)
        self.least[ids < 0] = -np.inf

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = scores.astype(np.int64)
        if self.bound_id[q] >= 0:
            fit = (scores > self.bound[q]) | ((scores == self.bound[q]) & (ids <= self.bound_id[q]))
            ids, scores = ids[fit], scores[fit]
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        best = np.lexsort((ids, ~scores))[: self.k]  # ~ turns the order and holds for all longs
        self.ids[q], self.scores[q] = ids[best], scores[best]
        if len(best) == self.k:
            self.least[q] = max(self.least[q], float(scores[best[-1]]))

    def rows(self, rows: np.ndarray) -> pa.RecordBatch:
        n = np.array([len(x) for x in self.ids])
        return pa.record_batch({"query_row": np.repeat(rows, n), "vec_id": np.concatenate([np.zeros(0, np.int64), *self.ids]), "score": np.concatenate([np.zeros(0, np.int64), *self.scores])})


def _searcher(group, k: int):
    """Arrow batches of vectors (id, values) -> the best of a partition for a broadcast group of queries."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, own, queries, scores, ids = group.value
        best = _Best(len(rows), k, scores, ids)
        largest = float(np.abs(queries.astype(np.float64)).max(initial=0))
        for block in _blocks(batches):
            names, vectors = block["id"].to_numpy(), _matrix(block["values"].combine_chunks(), queries.shape[1])
            exact = largest * float(np.abs(vectors.astype(np.float64)).max(initial=0)) * max(1, queries.shape[1]) < 2.0**53
            index = ImpactIndex(vectors.astype(np.float64)) if exact else None
            for a in range(0, len(rows), QUERIES):
                some, mine = queries[a : a + QUERIES], own[a : a + QUERIES]
                told = index.search(some.astype(np.float64), mine, names, k, best.least[a : a + QUERIES]) if exact else _plain(some, mine, vectors, names)
                for q, members, score in told:
                    best.add(a + q, names[members], score)
        yield best.rows(rows)

    return found


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= VECTORS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def whole_numbers(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(id, values array<bigint>) of the vectors that take part."""
    x = F.col(embedding).cast("array<double>")
    fit = F.col(vec_id).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(fit).select(F.col(vec_id).cast("bigint").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).cast("array<bigint>").alias("values"))


def _found(vectors: DataFrame, group, k: int) -> DataFrame:
    """(query_row, vec_id, score, rank) of the k best of each query of a group."""
    best = vectors.select("id", "values").mapInArrow(_searcher(group, k), "query_row long, vec_id long, score long")
    # Ranking limits each task's rows to k a query before they are shuffled, so no query gathers all tasks.
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score); both sides are (id, values)."""
    spark = queries.sparkSession
    queries = materialise(queries.select("id", "values").withColumn("row", F.monotonically_increasing_id()), "queries")
    n, wide = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("values")), F.lit(0))).first()
    groups = max(1, -(-8 * n * max(1, wide) // AT_ONCE))
    sample = vectors.filter(F.pmod(F.xxhash64("id", "values"), F.lit(SAMPLE)) == 0)
    parts = []
    for g in range(groups):
        # Dealt by row number: at most AT_ONCE bytes and a row from each partition of the queries.
        told = queries.filter(F.pmod("row", F.lit(groups)) == g).toArrow()
        rows, own, matrix = told["row"].to_numpy(), told["id"].to_numpy(), _matrix(told["values"].combine_chunks(), wide)
        order = np.argsort(rows)
        rows, own, matrix = rows[order], own[order], matrix[order]
        scores, ids = np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        first = spark.sparkContext.broadcast((rows, own, matrix, scores, ids))
        bounds = _found(sample, first, k).filter(F.col("rank") == k).select("query_row", "score", "vec_id").toArrow()
        at = np.searchsorted(rows, bounds["query_row"].to_numpy())
        scores[at], ids[at] = bounds["score"].to_numpy(), bounds["vec_id"].to_numpy()
        second = spark.sparkContext.broadcast((rows, own, matrix, scores, ids))
        parts.append(materialise(_found(vectors, second, k), "best"))
        first.destroy()
        second.destroy()
    names = queries.select(F.col("row").alias("query_row"), F.col("id").alias("query_id"))
    return reduce(DataFrame.unionByName, parts).join(names, "query_row").select("query_id", "rank", "vec_id", "score")


def op4(embeddings: DataFrame) -> DataFrame:
    vectors = whole_numbers(embeddings, "vec_id", "embedding", SCALE)
    return top_k(vectors.filter(F.pmod("id", F.lit(20)) == 0), vectors)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT q.vec_id AS query_id, q.n AS query_row, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM (SELECT *, row_number() OVER () AS n FROM v WHERE vec_id % 20 = 0) q JOIN v c ON q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS INT) AS rank FROM pair)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
