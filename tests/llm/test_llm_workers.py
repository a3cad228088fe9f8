"""What workers and executors hold beside an operator's own task."""

from pyspark.sql import functions as F

from sluier.llm import bpe, queries, toxicity, workers


def test_a_worker_drops_the_tables_of_other_operators():
    bpe._turn()
    ids = bpe.encode_text("een twee drie", queries.RANKS)
    bpe._turn()
    assert bpe._coder.cache_info().currsize == 1  # kept from task to task of its own
    workers.turn("toxicity")
    assert bpe._coder.cache_info().currsize == 0 and bpe._tokens.cache_info().currsize == 0
    bpe._turn()
    assert bpe.encode_text("een twee drie", queries.RANKS) == ids


def test_fitting_toxicity_starts_no_other_python_processes(spark, monkeypatch):
    """Rows of Python objects go through an RDD, whose Python processes are of another kind than those of the features."""
    docs = spark.createDataFrame([(i, "you stupid fool" if i % 4 == 0 else "a fine day in town") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int")

    def refuse(*_, **__):
        raise AssertionError("rows of Python objects")

    monkeypatch.setattr(type(spark), "createDataFrame", refuse)
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    assert toxicity.op1(docs, labels).count() == 60
    assert sorted(map(tuple, toxicity._prior_rows(spark).collect())) == sorted(toxicity.prior())


def test_units_cut_a_text_into_words_once(spark):
    rows = spark.createDataFrame([("Ab ab abcdef, abcdeg",)], "text string").select(F.explode(toxicity.units_of(F.col("text"))).alias("unit"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert sorted(r["unit"] for r in rows.collect()) == sorted({u for w in ("ab", "abcdef", "abcdeg") for u in toxicity._units(w)})
