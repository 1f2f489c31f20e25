"""Connected components of an edge table by alternating star contractions, and joins on hot keys."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: A key of more rows than this is spread over ``SALTS`` tasks; that adds at most SALTS / HUB rows per row.
HUB = 256
SALTS = 64
#: Bits of the table of such keys: at most 2**14 rows of 64 bits are broadcast, whatever the input.
HUB_BITS = 20
#: Copies of the one side where all its keys are spread.
COPIES = 16
#: A key of up to this many rows is joined by one task.
PLAIN = 1_000_000
#: Up to this many edges a component search is ended by one task.
LOCAL = 200_000


def hot_keys(many: DataFrame, keys: list[str], rows: int | None = None) -> list[tuple]:
    """Keys with more than ``PLAIN`` rows: one in a million rows at most.  ``rows`` spares the look where there are no more in all."""
    if rows is not None and rows <= PLAIN:
        return []
    return [tuple(r) for r in many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > PLAIN).select(*keys).collect()]


def join_spread(many: DataFrame, one: DataFrame, keys: list[str], hot: list[tuple] | None = None, how: str = "inner") -> DataFrame:
    """``many`` joined with the small ``one``, which has a row per key: every key is dealt over ``COPIES`` tasks.

    For tables of links and groups, far smaller than the corpus, where a look for hubs would cost more.
    Where ``hot`` names the keys with very many rows only those are dealt and copied, for loops over whole tables.
    Nothing is broadcast, however small it looks: loops of such joins would fill the driver.
    """
    salt = F.pmod(F.xxhash64(*many.columns), F.lit(COPIES)).cast("int")
    every = F.sequence(F.lit(0), F.lit(COPIES - 1))
    if hot is not None:
        if not hot:
            return many.join(one.hint("merge"), keys, how)
        marked = F.coalesce(reduce(or_, (reduce(and_, (F.col(c) == F.lit(v) for c, v in zip(keys, key))) for key in hot)), F.lit(False))
        salt, every = F.when(marked, salt).otherwise(0), F.when(marked, every).otherwise(F.array(F.lit(0)))
    return many.withColumn("_salt", salt).join(one.withColumn("_salt", F.explode(every)).hint("merge"), [*keys, "_salt"], how).drop("_salt")


def join_hubs(many: DataFrame, one: DataFrame, keys: list[str], size: str = "n", how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has a row per key and in ``size`` how many rows of ``many`` have it.

    Hashes of the keys with over ``HUB`` rows are marked in a bitmap.  Both sides
    look there: rows of marked keys get one of ``SALTS`` numbers in ``many`` and
    all of them in ``one``, so no key's rows meet in one task.  A key marked by
    accident is merely spread as well.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(1 << HUB_BITS))
    mask = F.expr("shiftleft(1L, cast(_bit % 64 as int))")
    hubs = one.filter(F.col(size) > HUB).select(bit.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.bit_or(mask).alias("_mask"))

    def looked_up(df: DataFrame, hub, other) -> DataFrame:
        found = df.withColumn("_bit", bit).join(F.broadcast(hubs), F.shiftright("_bit", 6) == F.col("_word"), "left")
        return found.withColumn("_salt", F.when(F.coalesce(F.col("_mask"), F.lit(0)).bitwiseAND(mask) != 0, hub).otherwise(other)).drop("_bit", "_word", "_mask")

    spread = looked_up(many, F.pmod(F.xxhash64(*many.columns), F.lit(SALTS)).cast("int"), F.lit(0))
    copied = looked_up(one, F.sequence(F.lit(0), F.lit(SALTS - 1)), F.array(F.lit(0))).withColumn("_salt", F.explode("_salt"))
    return spread.join(copied, [*keys, "_salt"], how).drop("_salt")


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Link each larger neighbour of a node to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.max("b").alias("most")).filter("most > a").drop("most")
    up = both.filter("b > a")
    return join_spread(up, least, ["a"], hot_keys(up, ["a"], rows)).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Link a node's smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = join_spread(down, least, ["a"], hot_keys(down, ["a"], rows)).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _pruned(edges: DataFrame, rows: int) -> DataFrame:
    """``a, b, leaf`` for edges with ``a > b``: a leaf is the greater end of its only edge, so no root and on no way between others."""
    ends = edges.select("a", F.col("b").alias("up")).unionByName(edges.select(F.col("b").alias("a"), F.lit(None).cast(edges.schema["b"].dataType).alias("up")))
    leaves = ends.groupBy("a").agg(F.count(F.lit(1)).alias("_n"), F.min("up").alias("_up")).filter("_n = 1 and _up is not null").select("a", F.lit(True).alias("_leaf"))
    return join_spread(edges, leaves, ["a"], hot_keys(edges, ["a"], rows), "left").select("a", "b", F.col("_leaf").isNotNull().alias("leaf"))


def _least_reachable(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``node, root`` for the nodes of a few edges that aren't roots."""
    up: dict = {}

    def end(x):
        while x in up:
            up[x] = x = up.get(up[x], up[x])
        return x

    for df in frames:
        for a, b in zip(df["a"].tolist(), df["b"].tolist()):
            x, y = end(a), end(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    yield pd.DataFrame({"node": list(up), "root": [end(x) for x in list(up)]}, dtype=None if up else object)


def _below_roots(edges: DataFrame, local: int | None = None) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)`` from which a lesser one is reachable: root is the least."""
    local = LOCAL if local is None else local
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    leaves = []
    while (n := now.count()) > local:
        stars = cut(_small_star(cut(_large_star(now, n)), n).filter("a <> b").distinct())  # each step reads the one before more than once
        marked = cut(_pruned(stars, n))
        leaves.append((marked.filter("leaf").select(F.col("a").alias("node"), F.col("b").alias("up")), n))
        now = marked.filter("not leaf").select("a", "b")
    kind = edges.schema["a"].dataType.simpleString()
    found = cut(now.coalesce(1).mapInPandas(_least_reachable, f"node {kind}, root {kind}"))  # local edges at most
    for cast, n in reversed(leaves):
        onward = found.select(F.col("node").alias("up"), "root")
        hung = join_spread(cast, onward, ["up"], hot_keys(cast, ["up"], n), "left").select("node", F.coalesce("root", "up").alias("root"))
        found = found.unionByName(cut(hung))
    return found


def connected_components(edges: DataFrame, local: int | None = None) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``: root is the least node reachable.

    A round links nodes to lesser ones by stars and takes off the leaves, which get the root
    of what they hung on at the end, so that rounds read fewer edges each time.  The number of
    rounds is logarithmic in the number of nodes at most; with at most ``local`` edges left, one
    task ends the search.  A round only moves two longs per edge; hubs are pre-aggregated and
    their edges spread over tasks, and only counts reach the driver.
    """
    below = _below_roots(edges, local)
    return below.unionByName(below.select(F.col("root").alias("node"), "root").distinct())


def extend_components(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Rows ``node, root`` to write over a stored ``roots`` when a new batch of ``links(a, b)`` arrives.

    The batch is contracted to the stored roots of its ends before its components are
    found, so the work grows with the batch; of the stored table only the members of
    roots that change are read into the result.  Any split of links into batches ends
    with the table of one batch: root is the least node that is reachable.
    """
    ends = cut(links.select("a", "b").distinct())
    stored = roots.select(F.col("node"), F.col("root"))
    owner = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(stored, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.col("root").isNull().alias("fresh"))
    owner = cut(owner)
    n = ends.count()
    put = lambda df, c: join_spread(df, owner.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")), [c], hot_keys(ends, [c], n))
    moved = _below_roots(put(put(ends, "a"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    touched = join_spread(stored, moved.select(F.col("node").alias("root"), F.col("root").alias("_new")), ["root"], hot_keys(stored, ["root"])).select("node", F.col("_new").alias("root"))
    fresh = owner.filter("fresh").select("node").join(moved, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return touched.unionByName(fresh)


def last_of(ups: DataFrame) -> DataFrame:
    """``node, up`` with ``up`` the end of the way that ``up`` begins; ``node`` is unique and no way is a cycle.

    Each round joins the steps taken so far, so rounds are logarithmic in the longest way.
    """
    now = cut(ups.select("node", "up"))
    n = now.count()
    while True:
        onward = now.select(F.col("node").alias("up"), F.col("up").alias("_next"))
        ahead = join_spread(now, onward, ["up"], hot_keys(now, ["up"], n), "left")
        moved = cut(ahead.select("node", F.coalesce("_next", "up").alias("up"), F.col("_next").isNotNull().alias("_moved")))
        now = moved.select("node", "up")
        if not moved.filter("_moved").take(1):
            return now
