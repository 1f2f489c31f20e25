"""Strongly connected components by forward and backward colouring."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import graph
from .components import hot_keys, join_spread

#: Peeling by joins stops once one leaves more than this share of the edges; the rest is left to the search.
PEEL = 0.95


def strong_components(edges: DataFrame, local: int | None = None) -> DataFrame:
    """``node, root`` of every node on a cycle of two nodes or more: root is the least node of its component.

    What is no part of a cycle is peeled off first (``core_edges``).  Then every
    node takes the least node that reaches it as its colour, and from each node
    that is its own colour the nodes of that colour that lead back to it are found:
    they are its component.  Components and edges between colours go, and the rest
    starts again.  A round of either search is one join; only nodes that changed
    speak, and ways without a choice are taken in leaps (``_leaps``), so that rounds
    grow with the choices of the longest shortest way, not with its nodes.  With at
    most ``local`` edges left they are searched on the driver.
    """
    local = graph.LOCAL if local is None else local
    left = graph.core_edges(edges.filter("source <> target"), local, PEEL)
    kind = edges.schema["source"].dataType.simpleString()
    found = edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    while True:
        n = left.count()
        if n <= local:
            after = defaultdict(set)
            for a, b in left.collect() if n else ():  # local edges at most
                after[a].add(b)
            rows = [(x, min(group)) for group in graph._strong(after, list(after)) for x in group]
            return found.unionByName(edges.sparkSession.createDataFrame(rows, found.schema))
        ways = _leaps(left)
        inside = _same(ways, _colours(ways))
        back = _leading_back(inside)
        found = cut(found.unionByName(back))
        gone = back.select(F.col("node").alias("source"))
        left = graph.core_edges(inside.filter("not leap").select("source", "target").join(gone, "source", "left_anti"), local)


def _leaps(edges: DataFrame) -> DataFrame:
    """``source, target, leap``: the edges, and ones from a node to those 2, 4, 8.. steps on while no node between has a choice.

    Steps without a choice go forward from nodes with one way out and backward from nodes
    with one way in.  A leap goes where a way leads already, so no component changes.
    """
    ways = [edges.select("source", "target", F.lit(False).alias("leap"))]
    for out, into in (("source", "target"), ("target", "source")):
        one = edges.groupBy(F.col(out).alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.min(into).alias("up")).filter("_n = 1").select("node", "up")
        now = cut(one)
        n = total = now.count()
        far = 1
        while n and far < total:  # on a ring without a choice leaps go round for ever
            now = cut(join_spread(now, now.select(F.col("node").alias("up"), F.col("up").alias("_next")), ["up"], hot_keys(now, ["up"], n)).select("node", F.col("_next").alias("up")))
            n, far = now.count(), 2 * far
            ways.append(now.filter("node <> up").select(F.col("node").alias(out), F.col("up").alias(into), F.lit(True).alias("leap")).select("source", "target", "leap"))
    return cut(reduce(DataFrame.unionByName, ways).groupBy("source", "target").agg(F.min("leap").alias("leap")))


def _colours(edges: DataFrame) -> DataFrame:
    """``node, colour``: the least node that reaches each node, itself included."""
    state = cut(edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumns({"colour": F.col("node"), "moved": F.lit(True)}))
    hot = hot_keys(edges, ["source"])
    while True:
        speak = state.filter("moved").select(F.col("node").alias("source"), "colour")
        heard = join_spread(edges, speak, ["source"], hot).groupBy(F.col("target").alias("node")).agg(F.min("colour").alias("heard"))
        less = F.coalesce(F.col("heard") < F.col("colour"), F.lit(False))
        state = cut(state.join(heard, "node", "left").select("node", F.when(less, F.col("heard")).otherwise(F.col("colour")).alias("colour"), less.alias("moved")))
        if not state.filter("moved").take(1):
            return state.select("node", "colour")


def _same(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """Edges within a colour, with it; colours only fall along a way, so a leap within one does not leave it."""
    one = join_spread(edges, colour.select(F.col("node").alias("source"), "colour"), ["source"], hot_keys(edges, ["source"]))
    two = join_spread(one, colour.select(F.col("node").alias("target"), F.col("colour").alias("other")), ["target"], hot_keys(edges, ["target"]))
    return cut(two.filter("colour = other").select("source", "target", "colour", "leap"))


def _leading_back(inside: DataFrame) -> DataFrame:
    """``node, root``: nodes from which the node that gave them their colour can be reached."""
    seen = cut(inside.filter("target = colour").select(F.col("source").alias("node"), F.col("colour").alias("root")).distinct())
    seen = cut(seen.unionByName(seen.select(F.col("root").alias("node"), "root")).distinct())
    front = seen
    hot = hot_keys(inside, ["target"])
    while True:
        step = join_spread(inside, front.select(F.col("node").alias("target")), ["target"], hot).select(F.col("source").alias("node"), F.col("colour").alias("root")).distinct()
        front = cut(step.join(seen, "node", "left_anti"))
        if not front.take(1):
            return seen
        seen = cut(seen.unionByName(front))


def cycle_edges(edges: DataFrame, local: int | None = None) -> DataFrame:
    """``source, target, root`` of the edges that lie on a cycle: those within a component, and loops."""
    e = cut(edges.select("source", "target").distinct())
    roots = cut(strong_components(e, local))
    n = e.count()
    one = join_spread(e, roots.select(F.col("node").alias("source"), "root"), ["source"], hot_keys(e, ["source"], n))
    within = join_spread(one, roots.select(F.col("node").alias("target"), F.col("root").alias("other")), ["target"], hot_keys(e, ["target"], n)).filter("root = other").select("source", "target", "root")
    alone = e.filter("source = target").join(roots.select(F.col("node").alias("source")), "source", "left_anti").select("source", "target", F.col("source").alias("root"))
    return within.unionByName(alone)


def some_cycles(on_cycles: DataFrame, limit: int) -> DataFrame:
    """``path``: up to ``limit`` simple cycles of each component of ``cycle_edges``, of any length.

    A component is searched by one task; its cycles are not more than ``limit``, its edges are its own.
    """
    kind = on_cycles.schema["source"].dataType.simpleString()

    def run(df: pd.DataFrame) -> pd.DataFrame:
        paths = []
        for path in graph.simple_cycles(zip(df["source"].tolist(), df["target"].tolist())):
            paths.append(path)
            if len(paths) == limit:
                break
        return pd.DataFrame({"path": paths})

    return on_cycles.filter("source <> target").groupBy("root").applyInPandas(run, f"path array<{kind}>")
