"""Integrity gates over proposed edges and validation of stored graphs."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def stateless_gates(edges: DataFrame, nodes: DataFrame, types: DataFrame) -> DataFrame:
    """``gate``: the first that an edge fails (null: none), whatever the others are."""
    ids = nodes.select("id").distinct()
    e = edges.join(F.broadcast(types), "type", "left")
    e = e.join(ids.select(F.col("id").alias("source"), F.lit(True).alias("_s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(True).alias("_t")), "target", "left")
    scored = F.col("scored") & (F.col("relevance").isNull() | ~F.col("relevance").between(0, 100))
    unscored = ~F.col("scored") & F.col("relevance").isNotNull()
    gate = F.coalesce(
        F.when(F.col("scored").isNull(), F.lit("out_of_schema")),
        F.when(scored | unscored, F.lit("relevance")),
        F.when(F.col("source") == F.col("target"), F.lit("self_edge")),
        F.when(F.col("_s").isNull() | F.col("_t").isNull(), F.lit("dangling")),
    )
    return e.withColumn("gate", gate).drop("_s", "_t")


def with_duplicates(gated: DataFrame) -> DataFrame:
    """Marks repeats among the edges that pass the other gates, symmetric ones either way."""
    a = F.when(F.col("symmetric"), F.least("source", "target")).otherwise(F.col("source"))
    b = F.when(F.col("symmetric"), F.greatest("source", "target")).otherwise(F.col("target"))
    w = Window.partitionBy("type", a, b, F.col("gate").isNull()).orderBy("seq")
    again = F.col("gate").isNull() & (F.row_number().over(w) > 1)
    return gated.withColumn("gate", F.when(again, F.lit("duplicate_edge")).otherwise(F.col("gate")))


def gate_edges(edges: DataFrame, nodes: DataFrame, types: DataFrame, group: str | None = None) -> DataFrame:
    """All gates in order; an edge that would close a cycle with edges accepted before it fails ``dag``.

    Only an edge on a cycle of all proposed edges can close one, and only with
    edges of its own strongly connected component.  So each component of a graph
    (``group``) and relation is taken in input order by itself; all other edges
    are judged by joins.  A repeat of an accepted edge fails ``duplicate_edge``,
    one of a refused edge ``dag`` as well.
    """
    from .strong import cycle_edges

    gated = stateless_gates(edges, nodes, types)
    by = [group] if group else []
    low = F.when(F.col("symmetric"), F.least("source", "target")).otherwise(F.col("source"))
    high = F.when(F.col("symmetric"), F.greatest("source", "target")).otherwise(F.col("target"))
    ranked = cut(gated.withColumns({"_a": low, "_b": high}).withColumn("_k", F.row_number().over(Window.partitionBy(*by, "type", "_a", "_b", F.col("gate").isNull()).orderBy("seq"))))
    # a symmetric relation without cycles would look at both directions of a repeat: all its edges are taken in order
    open_edges = ranked.filter("gate is null and dag and (_k = 1 or symmetric)")
    name = lambda c: F.to_json(F.struct(*by, "type", F.col(c).alias("_n")))
    core = cycle_edges(open_edges.select(name("source").alias("source"), name("target").alias("target"))).select(F.col("source").alias("_s"), F.col("target").alias("_t"), "root")
    suspects = open_edges.join(core, (name("source") == F.col("_s")) & (name("target") == F.col("_t"))).select("root", "source", "target", "symmetric", "seq")
    kind = gated.schema["seq"].dataType.simpleString()

    def run(df: pd.DataFrame) -> pd.DataFrame:
        order, seen, refused = _Order(), set(), []
        for a, b, sym, seq in df.sort_values("seq")[["source", "target", "symmetric", "seq"]].itertuples(index=False):
            k = tuple(sorted((a, b))) if sym else (a, b)
            if k in seen:
                continue
            if order.add(a, b):
                seen.add(k)
            else:
                refused.append(seq)
        return pd.DataFrame({"_refused": refused})

    refused = cut(suspects.groupBy("root").applyInPandas(run, f"_refused {kind}").distinct())
    judged = ranked.join(refused, F.col("seq") == F.col("_refused"), "left").withColumn("_dag", F.col("_refused").isNotNull())
    # the verdict of the first of equal edges holds for its repeats
    first = F.max(F.when(F.col("_k") == 1, F.col("_dag"))).over(Window.partitionBy(*by, "type", "_a", "_b", F.col("gate").isNull()))
    odd = F.col("symmetric") & F.col("dag")
    kept_before = F.min(F.when(~F.col("_dag"), F.col("seq"))).over(Window.partitionBy(*by, "type", "_a", "_b", F.col("gate").isNull()))
    plain = F.when(first, F.lit("dag")).when(F.col("_k") > 1, F.lit("duplicate_edge"))
    ordered = F.when(F.col("_dag"), F.lit("dag")).when(F.col("seq") > kept_before, F.lit("duplicate_edge"))
    gate = F.when(F.col("gate").isNotNull(), F.col("gate")).when(F.coalesce(odd, F.lit(False)), ordered).otherwise(plain)
    return judged.withColumn("_gate", gate).drop("gate").withColumnRenamed("_gate", "gate").select(*gated.columns)


class _Order:
    """Accepted edges of one component and an order of its nodes along them, repaired where an edge breaks it."""

    def __init__(self) -> None:
        self.place: dict = {}
        self.after: dict = defaultdict(set)
        self.before: dict = defaultdict(set)

    def _within(self, start, step: dict, ok) -> list | None:
        """Nodes reached from ``start`` among those whose place is ``ok``; None if one of them is refused outright."""
        met, stack = {start}, [start]
        while stack:
            for x in step[stack.pop()]:
                verdict = ok(self.place[x])
                if verdict is None:
                    return None
                if verdict and x not in met:
                    met.add(x)
                    stack.append(x)
        return sorted(met, key=self.place.__getitem__)

    def add(self, a, b) -> bool:
        """Whether the edge closes no cycle; it is kept then."""
        for x in (a, b):
            self.place.setdefault(x, len(self.place))
        low, high = self.place[b], self.place[a]
        if a == b:
            return False
        if low < high:  # only nodes between the two can be out of order
            forward = self._within(b, self.after, lambda p: None if p == high else p < high)
            if forward is None:
                return False
            backward = self._within(a, self.before, lambda p: p > low)
            moved = backward + forward
            for x, p in zip(moved, sorted(self.place[x] for x in moved)):
                self.place[x] = p
        self.after[a].add(b)
        self.before[b].add(a)
        return True


def mirror(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Symmetric edges that the other end lacks or scores otherwise, one row a pair."""
    e = edges.join(F.broadcast(types.filter("symmetric").select("type")), "type", "left_semi")
    o = e.select("type", F.col("source").alias("target"), F.col("target").alias("source"), F.col("relevance").alias("other"), F.lit(True).alias("there"))
    bad = e.join(o, ["type", "source", "target"], "left").filter(F.col("there").isNull() | ~F.col("relevance").eqNullSafe(F.col("other")))
    kind = F.when(F.max(F.col("there").isNull()), F.lit("missing")).otherwise(F.lit("unequal"))
    return bad.groupBy("type", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(kind.alias("finding"))


def registry_drift(registry: DataFrame, notes: DataFrame) -> DataFrame:
    """``id, finding`` where an active registry row and the notes disagree (id, title)."""
    r = registry.select("id", F.col("title").alias("r"), "status")
    n = notes.select("id", F.col("title").alias("n"), F.lit(True).alias("there"))
    j = r.join(n, "id", "full_outer")
    finding = F.coalesce(
        F.when(F.col("status").isNull(), F.lit("not_registered")),
        F.when((F.col("status") == "active") & F.col("there").isNull(), F.lit("note_missing")),
        F.when((F.col("status") == "retired") & F.col("there"), F.lit("retired_but_present")),
        F.when(F.col("there") & (F.col("r") != F.col("n")), F.lit("title_differs")),
    )
    return j.select("id", finding.alias("finding")).filter("finding is not null")


def validate_graph(edges: DataFrame, nodes: DataFrame, types: DataFrame) -> DataFrame:
    """All findings of a stored graph: gates, mirrors and duplicate ids."""
    gates = stateless_gates(edges, nodes, types).filter("gate is not null").select(F.concat_ws(" ", "source", "type", "target").alias("where"), F.col("gate").alias("finding"))
    pairs = mirror(edges, types).select(F.concat_ws(" ", "a", "type", "b").alias("where"), F.concat(F.lit("mirror_"), "finding").alias("finding"))
    twice = nodes.groupBy("id").count().filter("count > 1").select(F.col("id").cast("string").alias("where"), F.lit("duplicate_id").alias("finding"))
    return gates.unionByName(pairs).unionByName(twice)


def validate_map(nodes: DataFrame, edges: DataFrame, relations: tuple[str, ...], longest: int = 4) -> DataFrame:
    """``code, severity, location``: every problem of a course map.

    KL003 duplicate node, KL005 unknown relation, KL006 unknown end, KL007 self
    edge, KL008 both directions, KL009 prerequisite cycle of any length (up to
    five are reported, those of at most ``longest + 1`` nodes first); KL100
    duplicate edge and KL101 isolated node warn.
    """
    from .graph import reported_cycles

    where = F.concat_ws(" ", "source", "type", "target")
    ids = nodes.select("id").distinct()

    def found(df: DataFrame, code: str, location, severity: str = "error") -> DataFrame:
        return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), location.alias("location"))

    ends = edges.select("source", "type", "target", F.explode(F.array("source", "target")).alias("id"))
    known = edges.filter(F.col("type").isin(*relations) & (F.col("source") != F.col("target")))
    valid = known.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    both = valid.select("source", "type", "target").distinct()
    flipped = both.select(F.col("target").alias("source"), "type", F.col("source").alias("target"))
    parts = [
        found(nodes.groupBy("id").count().filter("count > 1"), "KL003", F.col("id").cast("string")),
        found(edges.filter(~F.col("type").isin(*relations)), "KL005", where),
        found(ends.join(ids, "id", "left_anti").distinct(), "KL006", where),
        found(edges.filter("source = target"), "KL007", where),
        found(both.join(flipped, ["source", "type", "target"]).filter("source < target"), "KL008", where),
        found(reported_cycles(valid.filter("type = 'prerequisite_of'"), longest), "KL009", F.concat_ws(" > ", "path")),
        found(edges.groupBy("source", "type", "target").count().filter("count > 1"), "KL100", where, "warning"),
        found(ids.join(ends.select("id").distinct(), "id", "left_anti"), "KL101", F.col("id").cast("string"), "warning"),
    ]
    return reduce(DataFrame.unionByName, parts)


def severity(issues: DataFrame) -> DataFrame:
    """The worse severity at each location."""
    rank = F.max(F.when(F.col("severity") == "error", 2).otherwise(1))
    return issues.groupBy("location").agg(F.when(rank == 2, F.lit("error")).otherwise(F.lit("warning")).alias("severity"))


def first_direction(edges: DataFrame) -> DataFrame:
    """Per relation and unordered pair the first direction seen; ``kept`` false for the others."""
    w = Window.partitionBy("type", F.least("source", "target"), F.greatest("source", "target")).orderBy("seq")
    first = F.first("source").over(w) == F.col("source")
    return edges.withColumn("kept", first & (F.row_number().over(w) == 1)).withColumn("conflict", ~first)
