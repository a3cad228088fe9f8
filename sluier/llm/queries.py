"""Queries of this subpackage, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluier.llm import align, bpe, chat, collocations, decontaminate, licenses, secrets, sentencepieces, simhash, token_counts, topk, toxicity, urls

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op1(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op2(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op3(_table(spark, sf_dir, "conversations"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op4(_table(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op5(_table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.op6(_table(spark, sf_dir, "pages"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op8(_table(spark, sf_dir, "documents"), RANKS)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op9(_table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op10(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.op11(_table(spark, sf_dir, "documents"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.op12(_table(spark, sf_dir, "documents"), PIECES)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.op13(_table(spark, sf_dir, "documents"), BYTES, PIECES)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": decontaminate.OP2_SQL,
        "op3_chat": chat.OP3_SQL,
        "op4_topk": topk.OP4_SQL,
        "op9_licenses": licenses.OP9_SQL,
        "op10_secrets": secrets.OP10_SQL,
        "op11_collocations": collocations.OP11_SQL,
    }
