"""A corpus from raw documents to token files, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows it is given;
its result is written as Parquet and read again as the next stage's ``docs``.
All but the last return the columns of ``documents``.  Nulls, empty texts,
ties, repeated rows, empty tables and extra columns are handled as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import quality_fm, simhash_pivots, source_mix, template_decontam, token_files
from weftgraph.llm.storage import new_folder, remove


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go."""
    return quality_fm.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-equal fingerprints the document with the least id stays."""
    return simhash_pivots.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, re-parameterised or not, go."""
    return template_decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their targets."""
    return source_mix.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files are written and read back: a row per document."""
    return token_files.encode(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
    ("token-ID output", tokens),
]

#: The classifier's and the tokenizer's steps have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder; a stage's rows go when the next one's are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        path = new_folder(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
