"""Offline replay of turn decisions: intent floor, trigger, policy, combination, plan, guard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules


def decide(turns: DataFrame, triggers: DataFrame, policies: DataFrame, fallback: tuple[str, str], hints: list[str], answers: list[str], allowed: list[str], substitute: str = "S04") -> DataFrame:
    """One row per turn with the strategy that stands after every rule.

    turns: turn_id, the four facts and ``confidence``.
    """
    facts = rules.confidence_floor(turns)
    chosen = rules.select_trigger(facts, triggers, fallback)
    folded = rules.fold_policies(rules.applicable(facts, policies, ("intent", "special_handling")), ("solution", "hint"))
    j = chosen.join(folded, "turn_id", "left")
    head = rules.veto(F.col("primary"), F.coalesce("prohibited", F.array().cast("array<string>")), substitute)
    rest = F.array_except("supporting", F.coalesce("prohibited", F.array().cast("array<string>")))
    out = rules.combine(head, rest, hints, answers, F.array(*map(F.lit, allowed)))
    return j.withColumn("plan", out).select("turn_id", "intent", "raw_intent", "row_id", "matched", F.col("plan.primary").alias("strategy"), F.col("plan.supporting").alias("supporting"), F.col("plan.actions").alias("actions"), "solution", "top_policy")
