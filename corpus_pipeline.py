"""Corpus pipeline: from raw documents to token ids.

Each stage takes all that its predecessor kept and returns the columns of documents, the last one token ids. ``run`` writes every
stage as Parquet to the shared folder and reads it again. A stage's own intermediate tables are deleted when the next
stage begins, because its result has been written by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.deploy import ensure_on_executors
from tracewright.llm import decontaminate, near_dedup, quality_classifier, scratch, sentencepiece_bpe, substring_dedup

#: A stage's rows go to the Python workers in batches of about this size. A batch is held by the executor, with room to grow, and up to
#: twice by a worker; Spark's own bound is 10,000 rows or 64 MB, which two tasks beside a full heap have no room for.
BATCH_BYTES = 4_000_000
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"
_begun: list[str] = []


def _bound_batches(spark: SparkSession) -> None:
    """For the session, as a stage's result is computed after the stage returns. A smaller bound stays."""
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BOUND))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BOUND, str(BATCH_BYTES))


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_on_executors(spark)
        _bound_batches(spark)
        while _begun:
            scratch.clear(spark, _begun.pop())
        _begun.append(f"stage-{work.__name__}")
        with scratch.scope(_begun[-1]):
            return work(spark, docs, sf_dir)

    stage.__name__, stage.__doc__ = work.__name__, work.__doc__
    return stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, accepts."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked at 0.8 or more of five-word shingles."""
    return near_dedup.keep_one(docs, shingle=5, percent=80)


@_stage
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 50 words that a document of a smaller doc_id has."""
    return substring_dedup.remove(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans they share with the benchmark."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), mode="spans")


@_stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids (16-bit little-endian, seeded merge-dropout), n_pieces, decoded_sha256, lossless."""
    return sentencepiece_bpe.encode(docs.select("doc_id", "source", "text")).select("doc_id", "source", "_encoded.*")


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", encoding),
]

#: The classifier, the signatures and the seeded encoding are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch.folder(spark, f"pipeline-{name}")
        done = stage(spark, docs, sf_dir)
        done.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
        if before:
            scratch.clear(spark, before)
        before = path
    return docs
