"""Graph queries for learner contexts: anchors and knowledge rules.

contexts: query_id, topic, learner_state, intent, student_level,
mastered array, excluded array.  Every rule is one set of joins over all
contexts at once; ``schema`` says which vocabulary the graph speaks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .entities import names
from .graph import bfs

#: fixed values: level -> (most candidates, depth, least relevance)
LEVELS = {"beginner": (2, 1, 70), "intermediate": (3, 2, 50), "advanced": (5, 2, 0)}


def _level(k: int):
    return F.coalesce(*[F.when(F.col("student_level") == n, F.lit(v[k])) for n, v in LEVELS.items()], F.lit(3 if k == 0 else 2 if k == 1 else 50))


def anchor(contexts: DataFrame, nodes: DataFrame, floor: float = 0.5) -> DataFrame:
    """``query_id, anchor, tier, score``: exact name, else best token Jaccard of ``floor`` or more.

    Fuzzy candidates come from a join on shared words, which any positive score needs.
    """
    have = names(nodes, tx.norm_name).select("id", "name", "tier", "pos").withColumn("words", tx.pieces(F.col("name"), " "))
    want = contexts.select("query_id", tx.norm_name(F.col("topic")).alias("q")).withColumn("qs", tx.pieces(F.col("q"), " "))
    exact = want.join(have, F.col("q") == F.col("name")).select("query_id", "id", F.lit(0).alias("t"), F.lit(1.0).alias("score"), "pos", "tier")
    shared = want.select("query_id", "qs", F.explode(F.array_distinct("qs")).alias("w")).join(have.select("id", "words", "pos", "tier", F.explode(F.array_distinct("words")).alias("w")), "w")
    fuzzy = shared.select("query_id", "id", F.lit(1).alias("t"), tx.jaccard(F.col("qs"), F.col("words")).alias("score"), "pos", "tier").filter(F.col("score") >= floor)
    w = Window.partitionBy("query_id").orderBy("t", F.desc("score"), "pos", "tier")
    return exact.unionByName(fuzzy).withColumn("k", F.row_number().over(w)).filter("k = 1").select("query_id", F.col("id").alias("anchor"), F.when(F.col("t") == 0, F.lit("exact")).otherwise(F.lit("fuzzy")).alias("tier"), "score")


def _floored(df: DataFrame) -> DataFrame:
    """Neighbours by falling relevance above the level's floor; the strongest alone where none is."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("relevance", F.lit(-1))), "seq")
    ok = F.col("relevance").isNull() | (F.col("relevance") >= F.col("floor"))
    ranked = df.withColumn("pos", F.row_number().over(w)).withColumn("ok", ok).withColumn("some", F.max(ok).over(Window.partitionBy("query_id")))
    return ranked.filter(F.col("ok") | (~F.col("some") & (F.col("pos") == 1))).withColumn("relaxed", ~F.col("some"))


def nearest(items: DataFrame, item: str, by: list[str], value: str, k: int = 3, step: int = 3) -> DataFrame:
    """``query_id, nbr, relevance``: each item's ``k`` most relevant others of the same ``by``, ties by id.

    Relevance is 100, ``step`` less for each 1 between their whole ``value``s, 0 at least.  Items
    of one value see the same others but for themselves, so others are ranked once a value, among
    the ``k + 1`` least ids of each value within reach, and no item is paired with its whole group.
    Those of relevance 0 all tie: only where an item has no better one the least id of them stands.
    """
    reach = 99 // step
    own = items.select(F.col(item).alias("_id"), *by, F.col(value).cast("long").alias("_v")).dropna(subset=["_id", *by])
    few = lambda df, part, *order: df.withColumn("_k", F.dense_rank().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col("_k") <= k + 1).drop("_k")
    heads = few(own.filter("_v is not null"), [*by, "_v"], "_id").groupBy(*by, "_v", "_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("_n"))
    offers = heads.withColumn("_d", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).select(*by, (F.col("_v") + F.col("_d")).alias("_v"), "_id", F.abs("_d").alias("_d"), "_n")
    values = own.select(*by, "_v").distinct()
    met = offers.join(values, [*by, "_v"], "left_semi").groupBy(*by, "_v", "_id").agg(F.min("_d").alias("_d"), F.flatten(F.collect_list(F.array_repeat("_d", F.col("_n")))).alias("_ds"))
    ranked = few(met, [*by, "_v"], "_d", "_id").groupBy(*by, "_v").agg(F.collect_list(F.struct("_id", "_ds")).alias("_near"))
    least = few(own.select(*by, "_id"), by, "_id").groupBy(*by).agg(F.array_sort(F.collect_set("_id")).alias("_any"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_v")]
    seen = values.alias("a").join(ranked.alias("b"), same, "left").select("a.*", "b._near").join(least, by).alias("b")
    pairs = F.flatten(F.transform(F.coalesce("_near", F.array()), lambda x: F.transform(x["_ds"], lambda d: F.struct((-100 + step * d).alias("r"), x["_id"].alias("nbr")))))
    better = F.slice(F.array_sort(F.filter(pairs, lambda x: x["nbr"] != F.col("_id"))), 1, k)
    rest = F.transform(F.slice(F.filter("_any", lambda x: x != F.col("_id")), 1, 1), lambda x: F.struct(F.lit(0).alias("r"), x.alias("nbr")))
    found = own.alias("a").join(seen.hint("merge"), same).select(F.col("a._id").alias("_id"), "_near", "_any").select("_id", better.alias("_xs"), rest.alias("_rest"))
    return found.select(F.col("_id").alias("query_id"), F.explode(F.when(F.size("_xs") > 0, F.col("_xs")).otherwise(F.col("_rest"))).alias("x")).select("query_id", "x.nbr", (-F.col("x.r")).cast("int").alias("relevance"))


def guidance(contexts: DataFrame, nodes: DataFrame, nbrs: DataFrame, schema: str = "education", cap: int | None = None) -> DataFrame:
    """``query_id, rank, id, role, relation, distance, relevance`` for each anchored context.

    Rules by priority: confused, clarify, practice, what comes next; the
    supporting context only where all of them together found nothing.
    """
    q = contexts.withColumns({"cap": F.lit(cap) if cap is not None else _level(0), "depth": _level(1), "floor": _level(2)})
    facts = nodes.select(F.col("id").alias("nbr"), "grounded")
    near = q.join(nbrs, F.col("anchor") == F.col("node")).filter(~F.array_contains("excluded", F.col("nbr"))).join(facts, "nbr")

    def rows(df: DataFrame, rule: int, role: str, relation, distance=1, relevance=None, pos=None) -> DataFrame:
        out = df.select("query_id", F.col("nbr").alias("id"), F.lit(rule).alias("rule"), (pos if pos is not None else F.col("seq")).cast("long").alias("pos"), F.lit(role).alias("role"), relation.alias("relation"), (F.lit(distance) if isinstance(distance, int) else distance).alias("distance"), (F.lit(None).cast("int") if relevance is None else relevance).alias("relevance"))
        return out

    of = lambda kind, way=None: near.filter((F.col("type") == kind) & (F.lit(True) if way is None else F.col("direction") == way))
    confused, clarify, quiz = F.col("learner_state") == "confused", F.col("intent") == "clarify", F.col("intent") == "practice_quiz"
    onward = (F.col("learner_state") == "normal") & (F.col("intent") == "summarize_review")
    text = F.lit
    parts = []
    if schema == "education":
        deep = bfs(q.filter(confused).select(F.col("anchor").alias("start")), nbrs, ["prerequisite_of"], 2).filter("direction = 'in'")
        gap = q.filter(confused).join(deep, F.col("anchor") == F.col("start")).filter((F.col("distance") <= F.col("depth")) & ~F.array_contains("mastered", F.col("node")) & ~F.array_contains("excluded", F.col("node")))
        order = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "node"))
        parts.append(gap.withColumn("_p", order).select("query_id", F.col("node").alias("id"), F.lit(2).alias("rule"), F.col("_p").cast("long").alias("pos"), F.lit("prerequisite_gap").alias("role"), F.col("relation"), "distance", F.lit(None).cast("int").alias("relevance")))
        others = near.filter(clarify & F.col("type").isin("refines", "supersedes", "same_as"))
        parts.append(rows(others, 3, "alternative_explanation", F.col("type")))
        first = Window.partitionBy("query_id").orderBy("seq")
        parent = q.filter(clarify).join(nbrs, F.col("anchor") == F.col("node")).filter("type = 'part_of' and direction = 'out'").withColumn("k", F.row_number().over(first)).filter("k = 1").join(others.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "anchor", "excluded", F.col("nbr").alias("up"))
        sib = parent.join(nbrs.filter("type = 'part_of' and direction = 'in'"), F.col("up") == F.col("node")).filter((F.col("nbr") != F.col("anchor")) & ~F.array_contains("excluded", F.col("nbr")))
        parts.append(rows(sib, 3, "alternative_explanation", text("part_of sibling"), 2))
        examples = of("example_of", "in").filter(quiz)
        by_ground = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grounded"), "seq"))
        parts.append(rows(examples.withColumn("_p", by_ground), 4, "practice_target", text("example_of"), relevance=F.col("relevance"), pos=F.col("_p")))
        nxt = of("prerequisite_of", "out").filter(onward).withColumn("k", F.row_number().over(first)).filter("k = 1")
        parts.append(rows(nxt, 5, "next_challenge", text("prerequisite_of")))
        base = rows(of("part_of", "out"), 6, "supporting_context", text("part_of (broader topic)")).unionByName(rows(of("example_of", "in"), 7, "supporting_context", text("example_of")))
    else:
        first = Window.partitionBy("query_id").orderBy("seq")
        up = of("part_of", "out").filter(confused).withColumn("k", F.row_number().over(first)).filter("k = 1")
        parts.append(rows(up, 2, "prerequisite_gap", text("part_of (broader concept, proxy)")))
        rest = _floored(of("related_to").filter(confused).join(up.select("query_id"), "query_id", "left_anti")).withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).filter("k = 1")
        parts.append(rows(rest, 2, "prerequisite_gap", text("related_to (proxy)"), relevance=F.col("relevance")))
        alt = _floored(of("related_to").filter(clarify))
        parts.append(rows(alt, 3, "alternative_explanation", text("related_to"), relevance=F.col("relevance"), pos=F.col("pos")))
        child = of("part_of", "in").filter(quiz)
        other = of("related_to").filter(quiz).join(child.select("query_id").distinct(), "query_id", "left_anti")
        by_ground = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grounded"), "seq"))
        for df, name in ((child, "part_of (child)"), (other, "related_to")):
            parts.append(rows(df.withColumn("_p", by_ground), 4, "practice_target", text(name), relevance=F.col("relevance"), pos=F.col("_p")))
        base = rows(_floored(of("related_to")), 6, "supporting_context", text("related_to"), relevance=F.col("relevance"), pos=F.col("pos"))
    found = reduce(DataFrame.unionByName, parts)
    every = found.unionByName(base.join(found.select("query_id").distinct(), "query_id", "left_anti"))
    seen = Window.partitionBy("query_id", "id").orderBy("rule", "pos")
    once = every.withColumn("k", F.row_number().over(seen)).filter("k = 1").join(q.select("query_id", "cap"), "query_id")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rule", "pos", "id")))
    return ranked.filter(F.col("rank") <= F.col("cap")).select("query_id", "rank", "id", "role", "relation", "distance", "relevance")


def rerank(chosen: DataFrame, roster: DataFrame, top: int) -> DataFrame:
    """A model's choice of ids against the roster: unknown and repeated ones go; without any the roster stands."""
    ok = chosen.join(roster.select("query_id", "id"), ["query_id", "id"], "left_semi").groupBy("query_id", "id").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("query_id").orderBy("pos")
    picked = ok.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("query_id", "id", "rank")
    rest = roster.join(picked.select("query_id").distinct(), "query_id", "left_anti").filter(F.col("rank") <= top).select("query_id", "id", "rank")
    return picked.unionByName(rest)
