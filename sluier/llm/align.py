"""Cross-tokenizer alignment: two token sequences over the same bytes, merged in lockstep.

Both tokenizers cut the bytes of a text (with a blank before it) into tokens. All documents of a block are merged at the same
time: one vector holds the A and the B pointer of each lane, and every step emits the link of each lane's two tokens,
moves the pointer whose token ends first (both where they end together, which is a cut between groups) and drops the lanes
that are done. A lane is LANE tokens of A at most, so a long text is many lanes and the number of steps is bounded: a lane begins at
a token of A and at the B token that holds its first byte.

How often an id pair is linked in the corpus is counted by block first: a block keeps each of its pairs once, with the number of
its links, and refers to it by its place there. Pairs are summed over the blocks, and each block then gets the sums of its own pairs back. So what is shuffled follows
the different pairs of blocks, a pair is one row of a block at most, and no link leaves its document.

Defined cases: texts that are null, empty, or whose A or B bytes differ from blank and text (a text that holds the sign a piece
model writes for a blank) have no tokens: counts are zero and lists empty. Repeated rows and ids stay rows of their own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluier.llm import bpe
from sluier.llm.sentencepieces import Model, model_of
from sluier.session import materialise

#: Tokens of A in a lane.
LANE = 128
#: Characters of texts that are merged at once (one text at least), and whose pairs are counted together.
BLOCK = 1 << 19


def read_byte_vocabulary(path: str) -> dict[bytes, int]:
    """The tokens of a byte-level BPE file as bytes, with their ids; ids must follow the order of the merges."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that are written as the character of their number
    letters = {chr(byte): byte for byte in shown} | {chr(256 + i): byte for i, byte in enumerate(b for b in range(256) if b not in set(shown))}
    made = [model["vocab"]["".join(pair if isinstance(pair, list) else pair.split(" "))] for pair in model["merges"]]
    if made != sorted(made):
        raise ValueError("merges are not in the order of ids")
    return {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}


class ByteCoder(bpe.Coder):
    """A coder over the vocabulary of such a file."""

    def __init__(self, path: str):
        import regex

        self.transducer, self.usual, self.split = bpe.Transducer(read_byte_vocabulary(path)), True, regex.compile(public_tokenizers.PATTERN).findall
        self._clear()
        tokens = self.transducer.tokens
        self.sizes = np.zeros(max(tokens) + 1, np.int64)
        self.sizes[list(tokens)] = [len(token) for token in tokens.values()]


@lru_cache(maxsize=1)
def _byte_coder(path: str) -> ByteCoder:
    return ByteCoder(path)


@dataclass
class Block:
    """Documents of a block with their tokens: ids, offsets of documents, and where each token ends (in the bytes of all documents)."""

    a: np.ndarray
    a_at: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_at: np.ndarray
    b_ends: np.ndarray

    def merge(self) -> None:
        """Links (places of A and B tokens, in order) and cuts (places of the A and B tokens that end a group)."""
        n = len(self.a_at) - 1
        lanes = -(-np.diff(self.a_at) // LANE)
        doc = np.repeat(np.arange(n), lanes)
        a = self.a_at[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        stop = np.minimum(a + LANE, self.a_at[doc + 1])
        began = np.where(a > 0, self.a_ends[a - 1], 0) if len(a) else a
        b = np.searchsorted(self.b_ends, began, side="right")
        linked_a, linked_b, cut_a, cut_b = [], [], [], []
        while len(a):
            linked_a.append(a)
            linked_b.append(b)
            end_a, end_b = self.a_ends[a], self.b_ends[b]
            both = end_a == end_b
            cut_a.append(a[both])
            cut_b.append(b[both])
            a, b = a + (end_a <= end_b), b + (end_b <= end_a)
            going = a < stop
            if not going.all():
                a, b, stop = a[going], b[going], stop[going]
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        linked_a, linked_b = join(linked_a), join(linked_b)
        order = np.argsort(linked_a + linked_b, kind="stable")  # grows along all documents
        self.linked_a, self.linked_b = linked_a[order], linked_b[order]
        self.cut_a, self.cut_b = np.sort(join(cut_a)), np.sort(join(cut_b))
        # The number of links, and of groups, of each document.
        self.links_at = np.searchsorted(self.linked_a, self.a_at)
        self.groups_at = np.searchsorted(self.cut_a, self.a_at)

    def written(self) -> list[bytes]:
        """The groups of each document: `a1,a2|b1;a3|b2,b3`."""
        if not len(self.a):
            return [b""] * (len(self.a_at) - 1)
        of_a, of_b = np.searchsorted(self.cut_a, np.arange(len(self.a))), np.searchsorted(self.cut_b, np.arange(len(self.b)))
        before_b = np.concatenate([[0], self.cut_b + 1])  # B tokens before each group
        place_a, place_b = np.arange(len(self.a)) + before_b[of_a], np.arange(len(self.b)) + (self.cut_a + 1)[of_b]
        ids, sign = np.zeros(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        sign[place_a[self.cut_a]], sign[place_b[self.cut_b]] = ord("|"), ord(";")
        width = len(str(int(ids.max())))
        digits, sizes = _digits(width)
        signs = np.zeros((len(ids), width + 1), np.uint8)
        signs[:, :width] = digits[ids]
        signs[np.arange(len(ids)), sizes[ids]] = sign
        flat = signs[signs != 0]
        ends = np.concatenate([[0], np.cumsum(sizes[ids] + 1)])[self.a_at + self.b_at]
        data = flat.tobytes()
        return [data[x : y - 1] if y > x else b"" for x, y in zip(ends.tolist(), ends[1:].tolist())]


@lru_cache(maxsize=2)
def _digits(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal numbers below 10^width as rows of digits, filled up with zeros, and their lengths."""
    numbers = [str(i).encode() for i in range(10**width)]
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in numbers), np.uint8).reshape(-1, width), np.array([len(x) for x in numbers])


def _tiles(model: Model, texts: list[str | None], ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that each piece stands for (a blank is one), and which texts the pieces give back with one blank before."""
    sizes = model.written_sizes
    held = sizes[ids]
    told = np.add.reduceat(np.append(held, 0), at[:-1]) * (np.diff(at) > 0) if len(at) > 1 else held[:0]
    # Equal lengths are not yet equal bytes; only texts with a blank sign, or under a model that rewrites, can differ.
    good = []
    flat = None
    for i, text in enumerate(texts):
        want = " " + (text or "")
        same = bool(text) and told[i] == len(want.encode())
        if same and not (model.normaliser.plain and "▁" not in want):
            flat = ids.tolist() if flat is None else flat
            same = b"".join(model.written[x] for x in flat[at[i] : at[i + 1]]) == want.encode()
        good.append(same)
    return held, np.array(good, bool)


def _only(good: np.ndarray, at: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Offsets and values with those of bad documents taken out."""
    sizes = np.diff(at)
    keep = np.repeat(good, sizes)
    return np.concatenate([[0], np.cumsum(np.where(good, sizes, 0))]), *(v[keep] for v in values)


def block_of(texts: list[str | None], a_path: str, b_path: str) -> Block:
    """The tokens of both tokenizers, merged."""
    coder, model = _byte_coder(a_path), model_of(b_path)
    a_at, a = coder.encode([f" {text}" if text else None for text in texts])
    b_at, b, _ = model.encode(texts, places=False)
    held, good = _tiles(model, texts, b, b_at)
    a_at, a = _only(good, a_at, a)
    b_at, b, held = _only(good, b_at, b, held)
    block = Block(a.astype(np.int64), a_at, np.cumsum(coder.sizes[a]), b.astype(np.int64), b_at, np.cumsum(held))
    full = np.diff(a_at) > 0
    assert (block.a_ends[a_at[1:][full] - 1] == block.b_ends[b_at[1:][full] - 1]).all(), "tokens don't cover the text"
    block.merge()
    return block


def _blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[list[pa.RecordBatch], list[str | None]]]:
    """Rows in parts of BLOCK characters or one text."""
    rows, texts, held = [], [], 0
    for batch in batches:
        begin = 0
        for i, value in enumerate(batch.column(text)):
            value = value.as_py()
            texts.append(value)
            held += len(value or "")
            if held >= BLOCK:
                rows.append(batch.slice(begin, i + 1 - begin))
                yield rows, texts
                rows, texts, held, begin = [], [], 0, i + 1
        if begin < batch.num_rows:
            rows.append(batch.slice(begin))
    if texts:
        yield rows, texts


def _int_lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


LINK = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
_LINK = pa.struct([("a", pa.int32()), ("b", pa.int32())])


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """docs with a_ids, b_ids, links and cuts: links are pairs of token places whose bytes overlap, cuts are the places of the tokens that end
    a group. Columns of these names are replaced; all others stay."""
    names = ["a_ids", "b_ids", "links", "cuts"]
    lists = [T.ArrayType(T.IntegerType())] * 2 + [T.ArrayType(LINK)] * 2
    shape = T.StructType([T.StructField(n, t) for n, t in zip(names, lists)])
    kind = pa.struct([("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())), ("links", pa.list_(_LINK)), ("cuts", pa.list_(_LINK))])

    @F.arrow_udf(shape)
    def aligned(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = [pa.array([], kind)]
            for texts in bpe.slices(column):
                k = block_of(texts, a_path, b_path)
                pairs = lambda a, b, at, k=k: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays([pa.array(a - np.repeat(k.a_at[:-1], np.diff(at)), pa.int32()), pa.array(b - np.repeat(k.b_at[:-1], np.diff(at)), pa.int32())], fields=list(_LINK)))
                parts.append(pa.StructArray.from_arrays([_int_lists(k.a_at, k.a, pa.int32()), _int_lists(k.b_at, k.b, pa.int32()), pairs(k.linked_a, k.linked_b, k.links_at), pairs(k.cut_a, k.cut_b, k.groups_at)], fields=list(kind)))
            yield pa.concat_arrays(parts)

    return docs.withColumn("__aligned", aligned(F.col(text))).withColumns({n: F.col(f"__aligned.{n}") for n in names}).drop("__aligned")


_COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
#: Of a document: its links as places of their id pairs in the block. Of a block: its id pairs and how many links hold each.
_PLACES = "__block long, __links array<int>, __pairs array<long>, __held array<long>"


def link_counts(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """docs without their text, with n_a, n_b, n_groups, n_links, groups_sha256, n_best (links whose id pair is the most common one of its B id) and
    count_sum (how often the id pairs of its links are linked in all documents). Columns of these names are replaced."""
    others = [c for c in docs.columns if c not in {text, *T.StructType.fromDDL(f"{_COUNTS}, n_best long, count_sum long").names}]
    kept = [T.StructField(c, docs.schema[c].dataType) for c in others]
    shape = T.StructType([*kept, *T.StructType.fromDDL(_COUNTS), *T.StructType.fromDDL(_PLACES)])
    names, told_names = [*others, *T.StructType.fromDDL(_COUNTS).names], shape.names

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, (rows, texts) in enumerate(_blocks(batches, text)):
            k = block_of(texts, a_path, b_path)
            pairs, place, held = np.unique(k.a[k.linked_a] << 32 | k.b[k.linked_b], return_inverse=True, return_counts=True)
            table = pa.Table.from_batches(rows).combine_chunks()
            n = len(texts)
            sha = [hashlib.sha256(x).hexdigest() if x else "" for x in k.written()]
            counts = [pa.array(np.diff(x), pa.int64()) for x in (k.a_at, k.b_at, k.groups_at, k.links_at)]
            columns = [*(table.column(c).combine_chunks() for c in others), *counts, pa.array(sha, pa.string()), pa.array(np.full(n, task | number)), _int_lists(k.links_at, place, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], told_names)
            told = [pa.nulls(1, c.type) for c in columns]
            told[-4:] = [pa.array([task | number]), pa.nulls(1, pa.list_(pa.int32())), pa.array([pairs], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(told, told_names)

    rows = materialise(docs.mapInArrow(merged, shape), "aligned")
    pairs = rows.filter("__pairs is not null").select("__block", F.posexplode(F.arrays_zip("__pairs", "__held")).alias("place", "p")).select(F.col("__block").alias("block"), "place", F.col("p.__pairs").alias("pair"), F.col("p.__held").alias("held"))
    total = pairs.groupBy("pair").agg(F.sum("held").alias("n"))
    # A B id has as many different partners as A has ids, at most.
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    total = total.select("pair", "n", (F.col("n") == F.max("n").over(of_b)).alias("best"))
    known = pairs.select("block", "place", "pair").join(total, "pair").select("block", "place", "n", "best")
    out = T.StructType([*kept, *T.StructType.fromDDL(f"{_COUNTS}, n_best long, count_sum long")])

    def summed(documents: pa.Table, sums: pa.Table) -> pa.Table:
        place = sums.column("place").to_numpy()
        n, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        n[place], best[place] = sums.column("n").to_numpy(), sums.column("best").to_numpy().astype(np.int64)
        documents = documents.combine_chunks()
        links = documents.column("__links").combine_chunks()
        flat = links.flatten().to_numpy()
        at = np.concatenate([[0], np.cumsum(documents.column("n_links").to_numpy())])
        over = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x[flat])])[at]), pa.int64())
        return documents.select(names).append_column("n_best", over(best)).append_column("count_sum", over(n))

    documents = rows.filter("__links is not null").drop("__pairs", "__held")
    return documents.groupBy("__block").cogroup(known.groupBy("block")).applyInArrow(summed, out)


def op13(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    return link_counts(docs.select("doc_id", "text"), a_path, b_path).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
