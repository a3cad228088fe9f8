"""The queries of the subpackage against their SQL, and the pipeline stage by stage."""

import re

import duckdb
import public_tokenizers
import pytest
import test_llm_operators as brute
import tiktoken

import corpus_pipeline
from sluier.llm import bpe, queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, DIR)
    rows = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, df.select(*names).collect())) == sorted(str(r) for r in [spark_row(names, r) for r in rows.fetchall()])


def spark_row(names, values):
    from pyspark.sql import Row

    return Row(*names)(*values)


def test_pipeline(spark):
    source = spark.read.parquet(f"{DIR}/documents.parquet")
    docs, seen = source, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
        assert docs.columns == source.columns
        docs = spark.createDataFrame(docs.collect(), source.schema)
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * source.count()
    assert corpus_pipeline.run(spark, DIR).count() == seen[-1]


def test_pipeline_equals_plain_loops(spark):
    """All stages by brute force but for the scores of the first, which are those of the query."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    toxic = {r["doc_id"] for r in queries.op1_toxicity(spark, DIR).collect() if r["predicted"]}
    ids = sorted(set(docs) - toxic)
    component = brute.brute_components(ids, [brute.brute_fingerprint(docs[i]) for i in ids])
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(queries.RANKS), special_tokens={})
    want = {}
    for i in ids:
        w = words(docs[i])
        if component[i] == i and not any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1)):
            out, at = [], 0
            for a, _, b in sorted(sum(brute.brute_secrets(docs[i]), [])):
                out += [docs[i][at:a], "[SECRET]"] if a >= at else []
                at = max(at, b)
            want[i] = coder.encode_ordinary("".join(out) + docs[i][at:])
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, DIR).collect()} == want


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0


def test_pipeline_stages_with_clashing_columns_and_long_texts(spark):
    """Columns that the operators name themselves, nulls in any column, a text of a million characters: each stage keeps columns and clean rows."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, "een tekst zonder nummer die nergens anders staat", None, None, None), (10**9, "lang woord na woord " * 50_000, "nl", "s", 1), (10**9 + 1, None, None, None, None), (10**9 + 2, "", "nl", "s", 0)], docs.schema)
    clashes = ["score", "predicted", "held_out", "fingerprint", "component_id", "n_hit", "n_items", "contaminated", "spans", "ids_", "hash", "bits", "part", "label", "features", "place", "start", "end"]
    docs = docs.unionByName(odd).withColumns({c: F.lit("x") for c in clashes})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DIR)
        assert kept.columns == docs.columns and kept.filter("score <> 'x' or spans <> 'x' or component_id <> 'x'").count() == 0
        docs = spark.createDataFrame(kept.collect(), docs.schema)
        assert docs.filter("doc_id = 1000000000").count() == 1 and docs.filter("doc_id is null").count() == 1
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert last.count() == docs.count() and set(clashes) <= set(last.columns)
    assert last.filter("doc_id = 1000000000").select("n_tokens").first()[0] > 100_000
