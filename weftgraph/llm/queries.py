"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_fm

    return quality_fm.score(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import source_mix

    return source_mix.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_rules

    return line_rules.judge(_documents(spark, sf_dir)).drop("clean_text")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash_pivots as p

    return p.cluster(_documents(spark, sf_dir)).select("doc_id", p.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import template_decontam

    found = template_decontam.matches(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.sort_array(F.transform("items", lambda x: x["item_id"]))
    changed = F.filter("items", lambda x: x["kind"] == "reparameterised")
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), ids.alias("item_ids"), F.size(changed).alias("n_reparameterised"), F.coalesce(F.array_max(F.transform("items", lambda x: x["similarity"])), F.lit(0.0)).alias("similarity"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import cover_dedup

    return cover_dedup.digests(cover_dedup.deduplicate(_documents(spark, sf_dir)))


def op7_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxic_segments

    scored = toxic_segments.score(_documents(spark, sf_dir), _labels(spark, sf_dir))
    return scored.withColumn("n_segments", F.size("segments")).drop("segments")


def op8_line_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_neighbourhood

    return line_neighbourhood.judge(_documents(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_files

    return token_files.encode(_documents(spark, sf_dir))


def op10_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import context_tree

    return context_tree.score(_documents(spark, sf_dir))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import turn_repair

    return turn_repair.digests(turn_repair.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import spelling_variants

    return spelling_variants.group(spelling_variants.dictionary(_documents(spark, sf_dir), damage=97)).select("word", "form", "root", "n", "n_near", "form_n")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import license_scan

    return license_scan.summary(license_scan.scan(_documents(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_fm, op2_mix_sources, op3_line_rules, op4_simhash_near_dedup, op5_template_decontamination, op6_substring_dedup, op7_toxic_segments, op8_line_neighbourhood, op9_token_files, op10_context_tree, op11_turn_repair, op12_spelling_variants, op13_license_scan)}


def oracle_sql() -> dict[str, str]:
    from . import line_neighbourhood, line_rules, source_mix

    return {"op2_mix_sources": source_mix.ORACLE_SQL, "op3_line_rules": line_rules.ORACLE_SQL, "op8_line_neighbourhood": line_neighbourhood.ORACLE_SQL}
