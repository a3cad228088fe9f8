"""Token counts by separator scan over flat token files.

A token file is a run of token ids without an index, 16 bits each (32 if the rank table needs them); each document ends
in an end-of-document id. It is read in blocks of fixed size whose borders fall anywhere. The scan finds the separators of a block with
one vectorised search; a block then is (tokens, separators, tokens after the last separator). What a document
had before its block is stitched on by a prefix scan over these, in two levels (blocks in a segment, then
segments), so that one huge file isn't scanned in one task.

Defined cases: null and empty texts are documents of 0 tokens; tokens after the last separator are an unfinished
document and are returned with finished = false; an empty file has no documents; an id that no document's row gets
back is an error, never a count of 0; rows that repeat a doc_id are counted one by one; other columns are not read.
PySpark has no sink for raw bytes, so op8 writes the blocks of its files as binary rows of a Parquet table; files that other
tools wrote are read by blocks_of_files().
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluier.llm.bpe import encode_texts, read_ranks, slices
from sluier.session import working_dir

END_OF_DOCUMENT, BLOCK, SEGMENT = 50_256, 65_536, 1_024
_FILES = "part string, file string, block int, payload binary, doc_ids array<bigint>"


def width_of(ranks: str, separator: int = END_OF_DOCUMENT) -> int:
    """Bytes of an id in a token file: 2, or 4 if the table or the separator needs them."""
    return 2 if max(separator, max(read_ranks(ranks).values())) < 1 << 16 else 4


def write_token_files(docs: DataFrame, path: str, ranks: str, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, separator: int = END_OF_DOCUMENT) -> None:
    """Encode docs into token files under path, one for each partition: part=tokens holds blocks of ids, part=names the doc_ids in the order written."""
    kind = pa.schema([("part", pa.string()), ("file", pa.string()), ("block", pa.int32()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])
    width = width_of(ranks, separator)

    def batch_of(part: str, file: str, number: int, payload: bytes | None, ids: list | None) -> pa.RecordBatch:
        return pa.record_batch([[part], [file], pa.array([number], pa.int32()), pa.array([payload], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], schema=kind)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = f"{TaskContext.get().partitionId():08d}"
        held, blocks, names = bytearray(), 0, 0
        for batch in batches:
            done = 0
            for part in slices(batch.column(1)):
                offsets, ids = encode_texts(part, ranks)
                held += np.insert(ids, offsets[1:], separator).astype(f"<u{width}").tobytes()
                while len(held) >= width * block:
                    yield batch_of("tokens", file, blocks, bytes(held[: width * block]), None)
                    del held[: width * block]
                    blocks += 1
                yield batch_of("names", file, names, None, batch.column(0).slice(done, len(part)).to_pylist())
                done += len(part)
                names += 1
        if held:
            yield batch_of("tokens", file, blocks, bytes(held), None)

    rows = docs.select(F.col(doc_id).cast("bigint"), F.col(text))
    rows.mapInArrow(files, _FILES).write.partitionBy("part").option("compression", "zstd").parquet(path)


def scan(blocks: DataFrame, separator: int = END_OF_DOCUMENT, segment: int = SEGMENT, width: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens, finished) of each document in blocks of (file, block, payload); width: bytes of an id."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(x.as_buffer(), f"<u{width}") for x in batch.column(2)]
            ends = [np.flatnonzero(t == separator).astype(np.int32) for t in tokens]
            yield pa.record_batch(
                {
                    "file": batch.column(0),
                    "block": batch.column(1),
                    "tokens": pa.array([len(t) for t in tokens], pa.int64()),
                    "ends": pa.array(ends, pa.list_(pa.int32())),
                }
            )

    found = blocks.select("file", "block", "payload").mapInArrow(find, "file string, block int, tokens long, ends array<int>")
    found = found.withColumn("seps", F.size("ends").cast("long")).withColumn("tail", F.when(F.col("seps") > 0, F.col("tokens") - F.element_at("ends", -1) - 1).otherwise(F.col("tokens")))
    found = found.withColumn("segment", (F.col("block") / segment).cast("int"))
    # Level 1: within a segment, separators before a block and tokens since the last of them.
    before = Window.partitionBy("file", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = found.withColumn("seps_before", F.coalesce(F.sum("seps").over(before), F.lit(0)))
    # A run: the blocks up to and with the next one that has a separator. In it, what each block before left open adds up.
    here = Window.partitionBy("file", "segment").orderBy("block")
    within = within.withColumn("run", F.count_if(F.col("seps") > 0).over(before)).withColumn("opened", F.coalesce(F.lag("tail").over(here), F.lit(0)))
    in_run = Window.partitionBy("file", "segment", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    within = within.withColumn("carry", F.sum("opened").over(in_run))
    # Level 2: the same over segments.
    by_segment = within.groupBy("file", "segment").agg(
        F.sum("seps").alias("s_seps"), F.max_by(F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tokens")), "block").alias("s_tail")
    )
    segments = Window.partitionBy("file").orderBy("segment")
    past = segments.rowsBetween(Window.unboundedPreceding, -1)
    by_segment = by_segment.withColumn("s_before", F.coalesce(F.sum("s_seps").over(past), F.lit(0)))
    by_segment = by_segment.withColumn("s_run", F.count_if(F.col("s_seps") > 0).over(past)).withColumn("s_opened", F.coalesce(F.lag("s_tail").over(segments), F.lit(0)))
    in_s_run = Window.partitionBy("file", "s_run").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    by_segment = by_segment.withColumn("s_carry", F.sum("s_opened").over(in_s_run))
    joined = within.join(by_segment.select("file", "segment", "s_before", "s_carry", "s_seps"), ["file", "segment"])
    carry = F.col("carry") + F.when(F.col("seps_before") == 0, F.col("s_carry")).otherwise(0)
    lengths = F.transform("ends", lambda e, i: F.when(i == 0, F.col("all_carry") + e).otherwise((e - F.element_at("ends", F.greatest(i, F.lit(1))) - 1).cast("long")))
    joined = joined.withColumn("all_carry", carry)
    done = joined.select("file", (F.col("s_before") + F.col("seps_before")).alias("first"), F.posexplode(lengths).alias("i", "n_tokens"))
    done = done.select("file", (F.col("first") + F.col("i")).alias("ordinal"), F.col("n_tokens").cast("long").alias("n_tokens"), F.lit(True).alias("finished"))
    ended = joined.groupBy("file").agg(
        F.max(F.col("s_before") + F.col("s_seps")).alias("ordinal"), F.max_by(F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("all_carry") + F.col("tokens")), "block").alias("n_tokens")
    )
    return done.unionByName(ended.filter("n_tokens > 0").select("file", "ordinal", "n_tokens", F.lit(False).alias("finished")))


def blocks_of_files(files: DataFrame, block: int = BLOCK, width: int = 2) -> DataFrame:
    """Blocks of flat files read by spark.read.format("binaryFile"), each below that reader's 2 GB."""
    n = F.ceil(F.length("content") / (width * block)).cast("int")
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    return files.select(F.col("path").alias("file"), "content", at.alias("block")).select("file", "block", F.substring("content", F.col("block") * (width * block) + 1, F.lit(width * block)).alias("payload"))


def op8(docs: DataFrame, ranks: str) -> DataFrame:
    spark = docs.sparkSession
    path = f"{working_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, ranks)
    written = spark.read.schema("file string, block int, payload binary, doc_ids array<bigint>, part string").parquet(path)
    tokens, names = written.filter("part = 'tokens'"), written.filter("part = 'names'")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    named = names.withColumn("first", F.coalesce(F.sum(F.size("doc_ids")).over(before), F.lit(0))).select("file", "first", F.posexplode("doc_ids").alias("i", "doc_id"))
    named = named.select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    counted = named.join(scan(tokens, width=width_of(ranks)), ["file", "ordinal"], "left")
    return counted.select("doc_id", F.coalesce("n_tokens", F.raise_error(F.lit("a document has no count")).cast("long")).alias("n_tokens"))
