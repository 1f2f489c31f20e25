"""One-to-one matching of two sets of names, best pairs first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut
from .entities import candidate_pairs


def greedy_matching(pairs: DataFrame, least: float = 0.8) -> DataFrame:
    """``x, y, score`` of the one-to-one matches that taking pairs from the best down gives.

    Pairs are ranked by score, then ``x``, then ``y``.  A pair that is the best of
    both its ends is taken by the sequential rule whatever happens elsewhere, since
    every pair it could lose to ranks below it.  So each round takes all such pairs at
    once and drops the pairs of their ends; the best pair left is always among them.
    The rounds are as many as the longest chain of ever better neighbours, few
    unless scores are built for it.
    """
    left = cut(pairs.filter(F.col("score") >= least).groupBy("x", "y").agg(F.max("score").alias("score")))
    taken = left.limit(0)
    while left.take(1):
        rank = F.struct((-F.col("score")).alias("down"), "x", "y")
        best = lambda end: left.groupBy(end).agg(F.min(rank).alias("r")).select("r.*")  # noqa: B023, E731
        round_ = cut(best("x").join(best("y"), ["down", "x", "y"]).select("x", "y", (-F.col("down")).alias("score")))
        taken = cut(taken.unionByName(round_))
        left = cut(left.join(round_.select("x"), "x", "left_anti").join(round_.select("y"), "y", "left_anti"))
    return taken


def match_names(a: DataFrame, b: DataFrame, least: float = 0.8, key=tx.norm_title) -> DataFrame:
    """``name_a, name_b, score``: equal names first (1.0), the others matched greedily from ``least`` on.

    Names without a partner come with a null on the other side and score.  Inputs have a column
    ``name``; names that are empty once normalised are left out.
    """
    x, y = (df.select(key(F.col("name")).alias("name")).filter("name <> ''").distinct() for df in (a, b))
    same = x.join(y, "name", "left_semi")
    rest = [cut(df.join(same, "name", "left_anti")) for df in (x, y)]
    items = rest[0].select("name", F.lit("a").alias("side")).unionByName(rest[1].select("name", F.lit("b").alias("side")))
    pairs = candidate_pairs(items.withColumn("id", F.concat("side", F.lit(":"), "name")), least, side="side")
    bare = lambda c: F.substring(c, 3, 1 << 30)
    matched = greedy_matching(pairs.select(bare("a_id").alias("x"), bare("b_id").alias("y"), "score"), least)
    alone = lambda df, end: df.join(matched.select(F.col(end).alias("name")), "name", "left_anti")
    none = F.lit(None).cast("string")
    return (
        same.select(F.col("name").alias("name_a"), F.col("name").alias("name_b"), F.lit(1.0).alias("score"))
        .unionByName(matched.select(F.col("x").alias("name_a"), F.col("y").alias("name_b"), "score"))
        .unionByName(alone(rest[0], "x").select(F.col("name").alias("name_a"), none.alias("name_b"), F.lit(None).cast("double").alias("score")))
        .unionByName(alone(rest[1], "y").select(none.alias("name_a"), F.col("name").alias("name_b"), F.lit(None).cast("double").alias("score")))
    )


def fuzzy_agreement(matches: DataFrame) -> DataFrame:
    """One row: exact and fuzzy matches and the Jaccard index that counts both; two empty sets agree."""
    both = F.col("name_a").isNotNull() & F.col("name_b").isNotNull()
    same = F.col("name_a") == F.col("name_b")
    n = matches.agg(F.count_if(both & same).alias("exact"), F.count_if(both & ~same).alias("fuzzy"), F.count_if(~both).alias("alone"))
    total: Column = F.col("exact") + F.col("fuzzy") + F.col("alone")
    return n.select("*", F.when(total == 0, F.lit(1.0)).otherwise((F.col("exact") + F.col("fuzzy")) / total).alias("fuzzy_jaccard"))
