"""The corpus pipeline: five stages from raw documents to token ids, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from curatrix.llm import bpe, decontaminate, files, jaccard, quality, secret_scan
from curatrix.llm.queries import WORD_BPE, table
from curatrix.llm.text import fresh


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, the one of the smallest id. Links are those of a stage on words, five-word shingles and 80 %, not the defaults of op8."""
    return jaccard.representatives(docs, size=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; documents without any stay as they are."""
    out = fresh(docs, "_secrets")
    found = secret_scan.scan(docs, out=out)
    spans = F.col(out)["found"]
    text = secret_scan.redacted(F.col("text"), spans)
    changed = {"text": text} | ({"n_chars": F.when(F.size(spans) > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return found.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids."""
    out = fresh(docs, "_bpe")
    made = bpe.encoded(docs, WORD_BPE, out=out, fields=("n_tokens", "ids"))
    return made.select(*docs.columns, F.col(out)["n_tokens"].alias(fresh(docs, "n_tokens")), F.col(out)["ids"].alias(fresh(docs, "token_ids")))


STAGES = [
    ("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("secrets", secret_stage), ("encoding", encoding_stage)]

#: The classifier, the tokenizer and the reachability of links are beyond one SQL statement; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = files.shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
