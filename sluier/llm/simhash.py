"""SimHash near-duplicate detection with a Gray-order hierarchical index.

Fingerprints: 64 bits over word shingles. Two fingerprints link at `distance` or fewer differing bits.

Candidates: a fingerprint is cut into four blocks; fingerprints at distance 2 or less agree in two
blocks at least, so each distinct fingerprint is listed under the six pairs of its blocks. A list of
more than HOT members is dealt again by pairs of quarters of the two open blocks; what is then
still together differs in 16 bits only, so no list exceeds 65,536 members whatever the data.

In a list the members stand in Gray order. Runs of members form leaves, runs of leaves form the nodes
above; each node keeps the bits that all below it share (mask and pattern). Two nodes are
compared from the top: the differing bits among those both share count up on the way down, and the
pair of groups is dropped when they exceed the distance. Surviving members are compared exactly. A list
returns links that span its components, never all pairs.

Components: alternating star contractions over the links, each round written to the shared folder.

Defined cases: null text counts as empty; a text without words has fingerprint 0, which links like any
other; a text of fewer words than a shingle is one shingle; rows with the same text share a
fingerprint; a null doc_id never becomes a component id unless no other row of the component has one; near_duplicates() has one
row for each row, repeated ones too, and reads no other columns; keep_one() keeps all columns as they are. A fingerprint or a
node that very many rows share is one key of a join; adaptive execution splits such a key's rows, there is nothing to gather.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluier.llm import workers
from sluier.session import drop_materialised, materialise

SHINGLE, DISTANCE, SEED = 3, 2, 42
#: Members of a list beyond which it is dealt again.
HOT = 2048
#: Members of a leaf and children of a node.
FAN = 16
#: Pairs of nodes or members compared at once.
AT_ONCE = 1 << 20


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text, as a signed 64-bit integer."""
    data = b" ".join((text or "").encode().lower().split())
    if not data:
        return 0
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32).tolist()
    if len(ends) + 1 <= shingle:
        hashes = [xxhash.xxh64_intdigest(data, SEED)]
    else:
        starts = [0, *(x + 1 for x in ends)]
        stops = [*ends, len(data)][shingle - 1 :]
        digest, view = xxhash.xxh64_intdigest, memoryview(data)
        hashes = [digest(view[a:b], SEED) for a, b in zip(starts, stops, strict=False)]
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], np.uint64)
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprints of a text column, as bigint."""

    @F.arrow_udf("bigint")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        workers.turn("simhash")
        for batch in batches:
            yield pa.array([text_fingerprint(x.as_py(), shingle) for x in batch], pa.int64())

    return of(text)


# -- the index over sorted lists ---------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a code in the Gray order: prefix parities of its bits."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def _levels(members: np.ndarray, group: np.ndarray) -> list[tuple]:
    """Levels from the leaves up: (pattern, mask, first child, end of children); no node crosses a list."""
    ones = np.full(len(members), ~np.uint64(0))
    levels = [(members, ones, None, None)]
    owner = group
    while True:
        pattern, mask, _, _ = levels[-1]
        edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        size = np.diff(np.r_[edge, len(owner)])
        if size.max() <= 1:
            return levels
        within = np.arange(len(owner)) - np.repeat(edge, size)
        first = np.flatnonzero(within % FAN == 0)
        end = np.r_[first[1:], len(owner)]
        both = np.bitwise_and.reduceat(pattern, first)
        any_ = np.bitwise_or.reduceat(pattern, first)
        shared = np.bitwise_and.reduceat(mask, first) & ~(both ^ any_)
        levels.append((both & shared, shared, first, end))
        owner = owner[first]


def linked_pairs(members: np.ndarray, group: np.ndarray, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of linked members, in parts. members: by list, in Gray order within it."""
    if len(members) < 2:
        return
    levels = _levels(members, group)
    top = np.arange(len(levels[-1][0]))
    stack = [(len(levels) - 1, top, top)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > AT_ONCE:
            stack += [(level, a[i : i + AT_ONCE], b[i : i + AT_ONCE]) for i in range(0, len(a), AT_ONCE)]
            continue
        pattern, mask, first, end = levels[level]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= distance
        a, b = a[near], b[near]
        if level == 0:
            apart = a < b
            if apart.any():
                yield a[apart], b[apart]
            continue
        step = max(1, AT_ONCE // (FAN * FAN))
        for i in range(0, len(a), step):
            na, nb = a[i : i + step], b[i : i + step]
            ca, cb = end[na] - first[na], end[nb] - first[nb]
            n = ca * cb
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(cb, n)
            left, right = np.repeat(first[na], n) + at // width, np.repeat(first[nb], n) + at % width
            keep = left <= right
            stack.append((level - 1, left[keep], right[keep]))


def _spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest place that each member reaches."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            low, differ = np.minimum(ra, rb), ra != rb
            if not differ.any():
                break
            np.minimum.at(root, ra, low)
            np.minimum.at(root, rb, low)
            while (root[root] != root).any():
                root = root[root]
    return root


def _links_of(rows: pa.Table, distance: int) -> pa.RecordBatch:
    fp = rows["fp"].to_numpy().view(np.uint64)
    keys = [rows[c].to_numpy() for c in ("combo", "key", "sub", "subkey")]
    order = np.lexsort((gray_rank(fp), *keys[::-1]))
    fp, keys = fp[order], [k[order] for k in keys]
    new = np.zeros(len(fp), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    group = np.cumsum(new)
    alone = np.ones(len(fp), bool)
    same = group[1:] == group[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    fp, group = fp[~alone], group[~alone]
    root = _spanning(len(fp), linked_pairs(fp, group, distance))
    joined = np.flatnonzero(root != np.arange(len(fp)))
    return pa.record_batch({"a": fp[root[joined]].view(np.int64), "b": fp[joined].view(np.int64)})


def _links_in(distance: int):
    """Arrow batches of a partition sorted by list -> links. A list that goes on in the next batch is held back."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) < 200_000:
                continue
            rows = pa.Table.from_batches(held)
            last = np.ones(rows.num_rows, bool)
            for c in ("combo", "key", "sub", "subkey"):
                values = rows[c].to_numpy()
                last &= values == values[-1]
            cut = rows.num_rows - int(last[::-1].argmin()) if not last.all() else 0
            if cut:
                yield _links_of(rows.slice(0, cut), distance)
            held = rows.slice(cut).to_batches()
        if held:
            yield _links_of(pa.Table.from_batches(held), distance)

    return links


# Pairs of blocks, from high to low: fixed by the choice of four blocks.
PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def _block(x: Column, i: int, width: int) -> Column:
    return F.shiftrightunsigned(x, width * (3 - i)).bitwiseAND((1 << width) - 1)


def _pair_key(x: Column, pair: tuple[int, int], width: int) -> Column:
    return F.shiftleft(_block(x, pair[0], width), width).bitwiseOR(_block(x, pair[1], width))


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that span the components of each list; fps: distinct fingerprints in column fp."""
    if not 0 <= distance <= 2:
        raise ValueError("four blocks, two of which agree, are exact for a distance of 0, 1 or 2")
    fp = F.col("fp")
    listed = fps.select("fp", F.posexplode(F.array(*(_pair_key(fp, p, 16) for p in PAIRS))).alias("combo", "key"))
    counted = listed.groupBy("combo", "key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    # Lists of one member are gone; those that stay carry their size.
    listed = listed.join(counted, ["combo", "key"])
    # The two open blocks of a hot list, as 32 bits, in four quarters.
    open_bits = F.element_at(F.array(*(_pair_key(fp, PAIRS[len(PAIRS) - 1 - i], 16) for i in range(len(PAIRS)))), F.col("combo") + 1)
    quarters = F.array(*(F.struct(F.lit(i).alias("sub"), _pair_key(F.col("open"), p, 8).alias("subkey")) for i, p in enumerate(PAIRS)))
    once = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("bigint").alias("subkey")))
    dealt = (
        listed.withColumn("open", open_bits)
        .select("fp", "combo", "key", F.explode(F.when(F.col("members") > HOT, quarters).otherwise(once)).alias("part"))
        .select("fp", "combo", "key", "part.sub", "part.subkey")
    )
    lists = dealt.repartition("combo", "key", "sub", "subkey").sortWithinPartitions("combo", "key", "sub", "subkey")
    return lists.mapInArrow(_links_in(distance), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node of the component.

    Rounds of star contraction: every node sends its larger neighbours to its smallest one, then the
    reverse for the smaller ones. Each round groups by node with map-side minima and joins; no group is
    collected. The number of rounds grows with the logarithm of the longest chain; they end when a round changes no edge.
    """
    edges = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        # Large star: neighbours above u go to u's smallest neighbour or itself.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: neighbours below u, and u itself, go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array_distinct(F.array("u", "v"))).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        after = materialise(small, "star")
        # Both are without repeats, so equal counts and no new edge mean the same edges.
        same = after.count() == edges.count() and after.join(edges, ["u", "v"], "left_anti").isEmpty()
        drop_materialised(edges)
        edges = after
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp bigint, component_id): one row for each row of docs."""
    docs = materialise(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp")), "fingerprints")
    first = materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    linked = components(links(first.select("fp"), distance))
    roots = first.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = roots.join(smallest, "root").select("fp", "component_id")
    return docs.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that of the smallest doc_id, a null doc_id last, and of rows that share it that of the smallest text hash.

    Rows are told apart by doc_id and text hash, so a doc_id that texts of several components share stays once for each component, and
    rows without a doc_id are kept like others; of rows with the same doc_id and text any one is kept.
    """
    row = F.struct(F.col(doc_id).isNull().alias("unknown"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"))
    rows = materialise(docs.select(row.alias("row"), fingerprint(F.col(text), SHINGLE).alias("fp")), "fingerprints")
    first = materialise(rows.groupBy("fp").agg(F.min("row").alias("row")), "distinct")
    linked = components(links(first.select("fp"), DISTANCE))
    roots = first.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    chosen = roots.groupBy("root").agg(F.min("row").alias("row")).select(*_row_key(F.col("row.id"), F.col("row.hash")))
    # The same keys for both steps, so that the texts are shuffled once.
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), *_row_key(F.col(doc_id), F.xxhash64(text))).join(chosen, ["__unknown", "__id", "__hash"], "left_semi")
    return kept.dropDuplicates(["__unknown", "__id", "__hash"]).select("__doc.*")


def _row_key(doc_id: Column, text_hash: Column) -> tuple[Column, Column, Column]:
    return doc_id.isNull().alias("__unknown"), F.coalesce(doc_id.cast("string"), F.lit("")).alias("__id"), text_hash.alias("__hash")


def op5(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
