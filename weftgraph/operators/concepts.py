"""Concepts consolidated across batches: each joins the first earlier one that shares a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut
from .components import hot_keys, join_spread, last_of
from .ordering import numbered

TOKENS = "kind string, token string, canonical long"
NODES = "canonical long, name string, name_th string, first long"


def empty_store(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Tables of no concepts: whom a name or raw id names, and the canonical concepts."""
    return spark.createDataFrame([], TOKENS), spark.createDataFrame([], NODES)


def scoped(by: str | None, value: Column) -> Column:
    """``value`` as a token of its ``by`` (null: of all); null where it is empty."""
    full = F.when(F.coalesce(value, F.lit("")) != "", value)
    return full if by is None else F.when(full.isNotNull(), F.to_json(F.array(F.col(by).cast("string"), full)))


def consolidate_concepts(concepts: DataFrame, tokens: DataFrame, nodes: DataFrame, key=tx.plain_text, by: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A batch of ``pos, raw_id, name, name_th`` against what is stored: ``(assigned, tokens, nodes)``.

    A concept has three tokens, looked for in this order: its name, its other
    name, its raw id.  It is the concept that the first known of them names, else a
    new one; what a token names is settled by the first concept that has it.  So a
    concept's owner is an earlier concept or a stored one, and the canonical concept
    is where the owners lead: a forest, walked by doubling steps.  ``assigned`` is
    ``pos, canonical`` (null where the name is empty); canonical numbers go on from
    the stored ones in order of ``pos``, which must rise from batch to batch.  A
    concept's other name is the first that any of its members has.
    Names hold within a ``by`` where one is given.
    The result does not depend on how concepts are split into batches.
    """
    full = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.col(c))
    usable = cut(concepts.select("pos", *([by] if by else []), "raw_id", full("name").alias("name"), full("name_th").alias("name_th")))
    named = usable.filter("name is not null")

    def token(rank: int, kind: str, value: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), scoped(by, value).alias("token"))

    each = named.select("pos", F.explode(F.array(token(0, "key", key(F.col("name"))), token(1, "key", key(F.col("name_th"))), token(2, "id", F.col("raw_id").cast("string")))).alias("t")).select("pos", "t.*").filter("coalesce(token, '') <> ''")
    each = cut(each)
    # what a token names: a stored concept, else the first of the batch
    firsts = each.groupBy("kind", "token").agg(F.min("pos").alias("first")).join(tokens, ["kind", "token"], "left")
    met = join_spread(each, firsts, ["kind", "token"], hot_keys(each, ["kind", "token"], each.count()))
    known = met.filter("canonical is not null or first < pos")
    owner = known.groupBy("pos").agg(F.min(F.struct("rank", "canonical", "first")).alias("o")).select("pos", "o.canonical", F.when(F.col("o.canonical").isNull(), F.col("o.first")).alias("up"))
    placed = cut(named.select("pos", "name").join(owner, "pos", "left"))
    # roots of the batch: new concepts and those that a stored token names
    ways = last_of(placed.filter("up is not null").select(F.col("pos").alias("node"), "up"))
    ends = placed.select("pos", "canonical", "name").join(ways.select(F.col("node").alias("pos"), F.col("up").alias("root")), "pos", "left").withColumn("root", F.coalesce("root", "pos"))
    ends = cut(ends)
    next_id = (nodes.agg(F.max("canonical")).first()[0] or 0) + 1
    roots = ends.filter("root = pos").select("root", "canonical", "name")
    new = numbered(roots.filter("canonical is null").select("root", "name"), "root", name="canonical", start=next_id)
    settled = cut(roots.filter("canonical is not null").select("root", "canonical").unionByName(new.select("root", "canonical")))
    assigned = cut(join_spread(ends.select("pos", "root"), settled, ["root"], hot_keys(ends, ["root"], ends.count())).select("pos", "canonical"))
    first_token = firsts.filter("canonical is null").select("kind", "token", F.col("first").alias("pos")).join(assigned, "pos").select("kind", "token", "canonical")
    other = named.filter("name_th is not null").join(assigned, "pos").groupBy("canonical").agg(F.min_by("name_th", "pos").alias("_th"))
    all_nodes = nodes.unionByName(new.select("canonical", F.trim("name").alias("name"), F.lit(None).cast("string").alias("name_th"), F.col("root").cast("long").alias("first")))
    kept = all_nodes.join(other, "canonical", "left").select("canonical", "name", F.coalesce("name_th", F.trim("_th")).alias("name_th"), "first")
    out = usable.select("pos").join(assigned, "pos", "left")
    return out, cut(tokens.unionByName(first_token)), cut(kept)
