"""Training corpus from ``documents``: score, deduplicate lines and documents, decontaminate, tokenize.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. A stage works on all rows that its predecessor kept:

1. quality classifier: documents predicted to be of low quality go;
2. line dedup: later repeated runs of lines are deleted; documents that lose their whole text go;
3. MinHash near-dedup: one document of each group of near copies stays;
4. benchmark decontamination: documents that hold a benchmark passage go;
5. byte-level BPE: token counts and digests of what is left.

Null and empty texts pass all stages (they have no tokens). No stage is expressible in SQL as a whole
(a fitted model, a hash-ordered selection, merges by rank), so ``ORACLE_SQL`` is None and tests
hold ``run`` against the brute-force versions of the stages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import bpe, decontaminate, lines, minhash, quality
from loomgraph.llm.common import exists, remove, scope, scratch_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.without_repeats(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level BPE encoding and decoding", token_stage),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again.

    Scratch tables of a stage go as soon as its result is written. With ``folder``, one that driver and executors share, results are kept
    there by the stage's number, and a later run goes on after the last complete one; else a result goes once the next one is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, before = folder or f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{base}/stage-{k}"
        if not (folder and exists(spark, f"{path}/_SUCCESS")):
            with scope(spark, f"stage-{k}"):
                out = stage(spark, docs, sf_dir)
                out.write.mode("overwrite").parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
        else:
            docs = spark.read.parquet(path)
        if before and not folder:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
