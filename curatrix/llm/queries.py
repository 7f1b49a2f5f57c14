"""The queries of this package over the driver tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from curatrix.llm import bpe, chunks, decontaminate, fingerprints, jaccard, merkle, ngram_lm, quality, secret_scan, sharding, spelling, sql, vectors, warc

#: Place of the public tokenizer file.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op3_benchmark_decontamination", sql.DECONTAMINATION)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op10_bpe_encoding_and_decoding")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.report(table(spark, folder, "documents"), WORD_BPE)


@query("op9_lm_scoring")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_lm.report(table(spark, folder, "documents"), min_count=1)


@query("op1_document_fingerprints")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.report(table(spark, folder, "documents"))


@query("op2_warc", sql.WARC)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return warc.report(table(spark, folder, "pages"))


@query("op5_secret_scans", sql.SECRETS)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.report(table(spark, folder, "documents"))


@query("op6_sharding")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.report(table(spark, folder, "documents"))


@query("op4_quality_classifier")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return quality.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op7_substring_dedup")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.report(table(spark, folder, "documents"))


@query("op8_ngram_jaccard_join", sql.JACCARD)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.report(table(spark, folder, "documents"))


@query("op8_ngram_jaccard_links", sql.JACCARD_LINKS)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.link_report(table(spark, folder, "documents"))


@query("op11_merkle_dataset_manifest", sql.MERKLE)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.report(table(spark, folder, "documents"))


@query("op13_spelling_variant_grouping", sql.SPELLING)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.report(table(spark, folder, "documents"))


@query("op12_embedding_near_dedup", sql.EMBEDDINGS)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.report(table(spark, folder, "embeddings"))
