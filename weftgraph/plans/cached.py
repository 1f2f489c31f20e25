"""Model stages with a content-addressed result table: what was answered once is not asked again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..providers import Completion, call_stage
from ..session import cut

STORE = "hash string, stage string, version int, result string"


def content_hash(stage: str, model: str, system: str, required: tuple[str, ...], prompt: Column) -> Column:
    """What a result depends on, as one address: stage, model, instructions, wanted keys and prompt."""
    return F.sha2(F.to_json(F.struct(F.lit(stage).alias("s"), F.lit(model).alias("m"), F.lit(system).alias("i"), F.array(*map(F.lit, required)).cast("array<string>").alias("k"), prompt.alias("p"))), 256)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """One winner per address: the oldest version, then the least result; empty where nothing is stored."""
    try:
        rows = spark.read.schema(STORE).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], STORE)
    return rows.groupBy("hash").agg(F.min(F.struct("version", "result")).alias("w")).select("hash", "w.version", "w.result")


def cached_stage(df: DataFrame, path: str, stage: str, provider: Completion, prompt: str, key: str, required: tuple[str, ...] = (), model: str = "default", system: str = "", attempts: int = 2) -> tuple[DataFrame, DataFrame]:
    """``(results, calls)``: ``key, result, from_version`` of every row, and the attempts that were made.

    Prompts whose address is in the table at ``path`` are not sent; equal prompts are sent
    once.  Good replies are appended under the next version; a prompt that
    failed is null in the results and asked again by the next run.  A run that dies before
    its append has stored nothing; two runs at once may both append, and one wins.
    """
    spark = df.sparkSession
    addressed = cut(df.select(key, prompt, content_hash(stage, model, system, required, F.col(prompt)).alias("hash")))
    known = stored(spark, path)
    version = (known.agg(F.max("version")).first()[0] or 0) + 1
    misses = addressed.groupBy("hash").agg(F.min(prompt).alias("prompt")).filter("prompt is not null").join(known.select("hash"), "hash", "left_anti")
    calls = cut(call_stage(misses, stage, provider, "prompt", "hash", required, attempts, system))
    fresh = calls.filter("outcome = 'ok'").select("hash", "stage", F.lit(version).cast("int").alias("version"), "result")
    if fresh.take(1):
        fresh.write.mode("append").parquet(path)
    winners = stored(spark, path)
    return addressed.join(winners, "hash", "left").select(key, "result", F.col("version").alias("from_version")), calls
