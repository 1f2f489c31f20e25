"""Concept graphs as node and edge tables.

nodes: id, title, aliases array<string>, definition, grounded boolean, pos
edges: source, target, type, relevance int, seq (input order)
edge_types: type, symmetric boolean, scored boolean, dag boolean
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: fixed values: the edge vocabularies (type, symmetric, scored, dag)
EDUCATION = (("prerequisite_of", False, False, True), ("part_of", False, False, True), ("example_of", False, False, False), ("refines", False, False, False), ("supersedes", False, False, False), ("same_as", True, False, False))
GENERAL = (("part_of", False, False, True), ("related_to", True, True, False))
#: edges that one process peels or layers in memory; larger tables take a join a round until they are as small
LOCAL = 200_000
RELATIONS = ("prerequisite_of", "related_to", "next_topic", "part_of", "uses")


def edge_types(spark, rows: tuple = EDUCATION) -> DataFrame:
    return spark.createDataFrame(list(rows), "type string, symmetric boolean, scored boolean, dag boolean")


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both known."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def canonical(edges: DataFrame, types: DataFrame) -> DataFrame:
    """One row per edge; symmetric ones as (least, greatest), the smaller owner's relevance wins."""
    e = edges.join(F.broadcast(types.select("type", "symmetric")), "type")
    a = F.when(F.col("symmetric"), F.least("source", "target")).otherwise(F.col("source"))
    b = F.when(F.col("symmetric"), F.greatest("source", "target")).otherwise(F.col("target"))
    key = e.withColumn("a", a).withColumn("b", b)
    return key.groupBy("type", "a", "b").agg(F.min_by("relevance", F.struct("source", "seq")).alias("relevance"), F.min("seq").alias("seq")).select(F.col("a").alias("source"), F.col("b").alias("target"), "type", "relevance", "seq")


def neighbours(edges: DataFrame, types: DataFrame) -> DataFrame:
    """``node, nbr, type, relevance, direction, seq``: out and in, or sym both ways."""
    e = edges.join(F.broadcast(types.select("type", "symmetric")), "type")
    out = e.select(F.col("source").alias("node"), F.col("target").alias("nbr"), "type", "relevance", F.when(F.col("symmetric"), F.lit("sym")).otherwise(F.lit("out")).alias("direction"), "seq")
    into = e.select(F.col("target").alias("node"), F.col("source").alias("nbr"), "type", "relevance", F.when(F.col("symmetric"), F.lit("sym")).otherwise(F.lit("in")).alias("direction"), "seq")
    return out.unionByName(into)


def degree(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each node, whatever the types."""
    pairs = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    return pairs.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def with_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degree(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def graph_meta(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts and each type's number of edges."""
    by_type = edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    types = by_type.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("edges_by_type"), F.coalesce(F.sum("n"), F.lit(0)).alias("edge_count"))
    return nodes.agg(F.count(F.lit(1)).alias("node_count")).join(types, how="cross")  # two rows of totals


def majority(df: DataFrame, value: str, seq: str) -> DataFrame:
    """The most frequent value; the first seen among equals."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first")).orderBy(F.desc("n"), "first").limit(1).select(value, "n")


def bfs(starts: DataFrame, nbrs: DataFrame, types: list[str] | None, depth: int) -> DataFrame:
    """``start, node, distance, direction, relation`` up to ``depth`` hops from each start.

    Levels are joins, so the number of joins is the depth; a node keeps its
    least distance and, among hops of that level, the first edge by input order.
    The direction is that of the last hop.
    """
    step = nbrs if types is None else nbrs.filter(F.col("type").isin(types))
    first = starts.select("start", F.col("start").alias("node")).distinct()
    reached = first.withColumns({"distance": F.lit(0), "direction": F.lit(None).cast("string"), "relation": F.lit(None).cast("string")})
    front = first
    for d in range(1, depth + 1):
        hop = front.join(step, "node").select("start", F.col("nbr").alias("node"), F.struct("seq", F.col("direction").alias("direction"), F.col("type").alias("type")).alias("via"))
        new = hop.groupBy("start", "node").agg(F.min("via").alias("via")).join(reached.select("start", "node"), ["start", "node"], "left_anti")
        level = new.select("start", "node", F.lit(d).alias("distance"), F.col("via.direction").alias("direction"), F.col("via.type").alias("relation"))
        reached = reached.unionByName(level)
        front = level.select("start", "node")
    return reached.filter("distance > 0")


def walk(starts: DataFrame, edges: DataFrame, relation: str, mode: str, depth: int) -> DataFrame:
    """Directed walk: ``backward`` to sources, ``forward`` to targets, or ``both``."""
    e = edges.filter(F.col("type") == relation)
    fwd = e.select(F.col("source").alias("node"), F.col("target").alias("nbr"), "type", "relevance", F.lit("out").alias("direction"), "seq")
    back = e.select(F.col("target").alias("node"), F.col("source").alias("nbr"), "type", "relevance", F.lit("in").alias("direction"), "seq")
    nbrs = {"forward": fwd, "backward": back, "both": fwd.unionByName(back)}[mode]
    return bfs(starts, nbrs, None, depth)


def neighbourhood(starts: DataFrame, edges: DataFrame, state: str = "normal", depth: int = 1) -> DataFrame:
    """Prerequisites, next topics and related ones of each start as one bundle.

    A confused learner's prerequisites reach two hops at least.
    """
    before = walk(starts, edges, "prerequisite_of", "backward", max(depth, 2) if state == "confused" else depth)
    after = walk(starts, edges, "next_topic", "forward", depth)
    beside = walk(starts, edges, "related_to", "both", depth)

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("distance", "node"))).alias(name))

    out = starts.select("start").distinct()
    for df, name in ((before, "prerequisites"), (after, "next_topics"), (beside, "related")):
        out = out.join(packed(df, name), "start", "left")
    return out


def closure(edges: DataFrame, depth: int) -> DataFrame:
    """``a, b, hops``: reachable pairs within ``depth`` hops, least hops each."""
    now = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct()
    step = now.select(F.col("a").alias("b"), F.col("b").alias("c"))
    found = now.withColumn("hops", F.lit(1))
    for d in range(2, depth + 1):
        now = now.join(step, "b").select("a", F.col("c").alias("b")).distinct()
        found = found.unionByName(now.withColumn("hops", F.lit(d)))
    return found.groupBy("a", "b").agg(F.min("hops").alias("hops"))


def cycles(edges: DataFrame, longest: int = 4, limit: int | None = 5) -> DataFrame:
    """Simple cycles as paths that start at their least node, shortest first."""
    e = edges.select("source", "target").distinct()
    path = e.filter("source < target").select(F.array("source", "target").alias("path"))
    found = e.filter("source = target").select(F.array("source").alias("path"))
    for _ in range(longest - 1):
        last = F.element_at("path", -1)
        step = path.join(e, last == F.col("source"))
        found = found.unionByName(step.filter(F.col("target") == F.get("path", F.lit(0))).select("path"))
        # a path only visits nodes above its start: each cycle is met once
        path = step.filter((F.col("target") > F.get("path", F.lit(0))) & ~F.array_contains("path", F.col("target"))).select(F.concat("path", F.array("target")).alias("path"))
    found = found.unionByName(path.join(e, (F.element_at("path", -1) == F.col("source")) & (F.col("target") == F.get("path", F.lit(0)))).select("path")).distinct()
    out = found.select("path", F.size("path").alias("length")).orderBy("length", "path")
    return out.limit(limit) if limit else out


def core_edges(edges: DataFrame, local: int | None = None, share: float = 1.0) -> DataFrame:
    """Edges ``source, target`` left when sources and sinks are peeled until nothing changes; none if acyclic.

    With a ``share`` below 1 joins stop early, after one that leaves more than that.

    Above ``local`` edges a round is a join; below, the rest is peeled on the
    driver.  What stays when a join changes nothing is never collected.
    """
    local = LOCAL if local is None else local
    e = cut(edges.select("source", "target").distinct())
    n = e.count()
    while n > local:
        sources, targets = e.select(F.col("source").alias("target")).distinct(), e.select(F.col("target").alias("source")).distinct()
        e = cut(e.join(targets, "source", "left_semi").join(sources, "target", "left_semi").select("source", "target"))
        was, n = n, e.count()
        if n > local and n >= was * share:
            return e
    after, before = defaultdict(set), defaultdict(set)
    for a, b in e.collect():  # local edges at most
        after[a].add(b)
        before[b].add(a)
    for go, back in ((after, before), (before, after)):
        ends = [x for x in back if not go.get(x)]
        while ends:
            x = ends.pop()
            for y in back.pop(x, ()):
                go[y].discard(x)
                if not go[y]:
                    ends.append(y)
    return edges.sparkSession.createDataFrame([(a, b) for a, bs in after.items() for b in bs], e.schema)


def cyclic_core(edges: DataFrame, local: int | None = None) -> list[tuple]:
    """``core_edges`` as a list: what has cycles and lies between them goes to the driver whole."""
    return [tuple(r) for r in core_edges(edges, local).collect()]


def _strong(after: dict, nodes: Iterable) -> list[set]:
    """Strongly connected components of more than one node among ``nodes``."""
    nodes = set(nodes)
    before, order, seen = defaultdict(set), [], set()
    for root in sorted(nodes):
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(sorted(after.get(root, ()))))]
        while stack:
            node, rest = stack[-1]
            for x in rest:
                if x in nodes:
                    before[x].add(node)
                    if x not in seen:
                        seen.add(x)
                        stack.append((x, iter(sorted(after.get(x, ())))))
                        break
            else:
                order.append(node)
                stack.pop()
    out, taken = [], set()
    for root in reversed(order):
        if root in taken:
            continue
        taken.add(root)
        group, stack = {root}, [root]
        while stack:
            for x in before[stack.pop()] - taken:
                taken.add(x)
                group.add(x)
                stack.append(x)
        if len(group) > 1:
            out.append(group)
    return out


def simple_cycles(edges: Iterable[tuple]) -> Iterator[list]:
    """Simple cycles of two nodes or more, of any length, from their least node (Johnson).

    The time between two cycles is linear in the edges.
    """
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    groups = _strong(after, list(after))
    while groups:
        groups.sort(key=min, reverse=True)
        group = groups.pop()
        start = min(group)
        steps = lambda x: iter(sorted(after[x] & group))  # noqa: B023, E731
        path, blocked, closed, waits = [start], {start}, set(), defaultdict(set)
        stack = [(start, steps(start))]
        while stack:
            node, rest = stack[-1]
            nxt = next(rest, None)
            if nxt is None:
                stack.pop()
                path.pop()
                if node in closed:
                    free = [node]
                    while free:
                        x = free.pop()
                        if x in blocked:
                            blocked.discard(x)
                            free.extend(waits.pop(x, ()))
                    if path:
                        closed.add(path[-1])
                else:
                    for x in after[node] & group:
                        waits[x].add(node)
            elif nxt == start:
                if len(path) > 1:
                    closed.add(node)
                    yield list(path)
            elif nxt not in blocked:
                path.append(nxt)
                blocked.add(nxt)
                closed.discard(nxt)
                stack.append((nxt, steps(nxt)))
        groups += _strong(after, group - {start})


def reported_cycles(edges: DataFrame, longest: int = 4, limit: int = 5) -> DataFrame:
    """``path, length`` of ``limit`` simple cycles, fewer only if there are fewer.

    The shortest come first as in ``cycles``; where those are fewer than
    ``limit``, cycles of any length fill up, ``limit`` of each strongly connected
    component at most.  Only the paths that are reported reach the driver.
    """
    from .strong import cycle_edges as on_cycles
    from .strong import some_cycles

    inside = cut(on_cycles(edges))
    spark, kind = edges.sparkSession, edges.schema["source"].dataType.simpleString()
    paths = [x.path for x in cycles(inside, longest, limit).collect()]
    if len(paths) < limit:
        known = spark.createDataFrame([(p,) for p in paths], f"path array<{kind}>")
        more = some_cycles(inside, limit).join(known, "path", "left_anti").orderBy(F.size("path"), "path").limit(limit - len(paths))
        paths += [x.path for x in more.collect()]
    return spark.createDataFrame([(p, len(p)) for p in paths], f"path array<{kind}>, length int")


def cycle_edges(paths: DataFrame) -> DataFrame:
    """The edges that cycle paths run over."""
    e = paths.select("path", F.posexplode("path").alias("k", "source"))
    return e.withColumn("target", F.get("path", (F.col("k") + 1) % F.size("path"))).select("source", "target").distinct()


def back_edges(edges: list[tuple], nodes: list) -> list[tuple]:
    """Edges into a node that is still open in a depth-first visit in node order."""
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    state: dict = {}
    found = []
    for root in nodes:
        if root in state:
            continue
        state[root] = 1
        stack = [(root, iter(after.get(root, ())))]
        while stack:
            node, rest = stack[-1]
            nxt = next(rest, None)
            if nxt is None:
                state[node] = 2
                stack.pop()
            elif state.get(nxt) == 1:
                found.append((node, nxt))
            elif nxt not in state:
                state[nxt] = 1
                stack.append((nxt, iter(after.get(nxt, ()))))
    return found


def layers(nodes: DataFrame, edges: DataFrame, local: int | None = None) -> DataFrame:
    """Longest-path layer of each node of an acyclic edge table; cycles are refused.

    Up to ``local`` edges are layered in memory, more by relaxation until nothing changes.
    """
    local = LOCAL if local is None else local
    e = cut(drop_dangling(edges.select("source", "target").distinct(), nodes).select("source", "target"))
    level = nodes.select("id").withColumn("layer", F.lit(0))
    if e.count() <= local:
        after, left = defaultdict(list), defaultdict(int)
        for a, b in e.collect():
            after[a].append(b)
            left[b] += 1
        layer = dict.fromkeys(after, 0)
        front = [x for x in after if not left.get(x)]
        while front:
            x = front.pop()
            for y in after.get(x, ()):
                layer[y] = max(layer.get(y, 0), layer[x] + 1)
                left[y] -= 1
                if not left[y]:
                    front.append(y)
        if any(left.values()):
            raise ValueError("layers need an acyclic edge table; take out back_edges first")
        found = nodes.sparkSession.createDataFrame(list(layer.items()), f"id {nodes.schema['id'].dataType.simpleString()}, up int")
        return level.join(found, "id", "left").select("id", F.coalesce("up", "layer").alias("layer"))
    if core_edges(e, local).take(1):
        raise ValueError("layers need an acyclic edge table; take out back_edges first")
    while True:
        up = e.join(level.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg((F.max("layer") + 1).alias("up"))
        new = cut(level.join(up, "id", "left").select("id", F.greatest("layer", F.coalesce("up", F.lit(0))).alias("layer"), (F.col("up") > F.col("layer")).alias("_moved")))
        level = new.select("id", "layer")
        if new.filter("_moved").isEmpty():
            return level


def describe(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A sentence per edge by relation."""
    names = nodes.select("id", "title")
    e = edges.join(names.select(F.col("id").alias("source"), F.col("title").alias("a")), "source").join(names.select(F.col("id").alias("target"), F.col("title").alias("b")), "target")
    words = {"prerequisite_of": "%s comes before %s.", "next_topic": "After %s comes %s.", "part_of": "%s is part of %s.", "uses": "%s uses %s.", "related_to": "%s is related to %s."}
    say = F.coalesce(*[F.when(F.col("type") == t, F.format_string(s, "a", "b")) for t, s in words.items()])
    return e.select("source", "target", "type", say.alias("sentence")).distinct()


def view(nodes: DataFrame, edges: DataFrame, search: str = "", least: int = 0, types: list[str] | None = None, hide_isolated: bool = False) -> DataFrame:
    """Ids shown in a graph view: hits and their visible neighbours."""
    shown = edges.filter(F.coalesce("relevance", F.lit(100)) >= least)
    if types is not None:
        shown = shown.filter(F.col("type").isin(types))
    hit = F.lower("title").contains(search.lower()) | F.exists("aliases", lambda a: F.lower(a).contains(search.lower()))
    hits = nodes.filter(hit).select("id")
    out = hits
    if search:
        ends = shown.select("source", "target").unionByName(shown.select(F.col("target").alias("source"), F.col("source").alias("target")))
        out = hits.unionByName(ends.join(hits.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))).distinct()
    if hide_isolated:
        linked = reduce(DataFrame.unionByName, [shown.select(F.col(c).alias("id")) for c in ("source", "target")]).distinct()
        out = out.join(linked, "id", "left_semi")
    return out


def related_titles(edges: DataFrame, nodes: DataFrame, key) -> DataFrame:
    """related_to edges by sorted normalised titles, the first of each pair."""
    names = nodes.select("id", key(F.col("title")).alias("t"))
    e = edges.filter("type = 'related_to'").join(names.select(F.col("id").alias("source"), F.col("t").alias("s")), "source").join(names.select(F.col("id").alias("target"), F.col("t").alias("u")), "target")
    return e.groupBy(F.least("s", "u").alias("a"), F.greatest("s", "u").alias("b")).agg(F.min_by("relevance", "seq").alias("relevance"))


def relations_of(edges: DataFrame, nodes: DataFrame, node) -> DataFrame:
    """A node's edges in both directions, strongest first, then by title."""
    out = edges.filter(F.col("source") == node).select(F.col("target").alias("id"), "type", "relevance", F.lit("out").alias("direction"))
    into = edges.filter(F.col("target") == node).select(F.col("source").alias("id"), "type", "relevance", F.lit("in").alias("direction"))
    return out.unionByName(into).join(nodes.select("id", "title"), "id").orderBy(F.coalesce("relevance", F.lit(-1)).desc(), "title")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an unknown end."""
    ids = nodes.select("id").distinct()
    lost = [edges.join(ids.withColumnRenamed("id", c), c, "left_anti") for c in ("source", "target")]
    return lost[0].unionByName(lost[1]).distinct()
