"""Matching, components, concepts and numbers against plain sequential forms."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import components, concepts, gates, graph, matching, ordering, strong


def greedy(pairs, least):
    x_used, y_used, out = set(), set(), []
    for s, x, y in sorted(((-s, x, y) for x, y, s in pairs if s >= least)):
        if x not in x_used and y not in y_used:
            x_used.add(x), y_used.add(y)
            out.append((x, y, -s))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_matching_by_rounds_is_the_sequential_rule(spark, seed):
    r = random.Random(seed)
    pairs = [(f"x{r.randrange(25)}", f"y{r.randrange(25)}", r.choice([0.7, 0.8, 0.85, 0.9, 0.95])) for _ in range(200)]
    best = {}
    for x, y, s in pairs:
        best[x, y] = max(s, best.get((x, y), 0))
    got = matching.greedy_matching(spark.createDataFrame(pairs, "x string, y string, score double").repartition(3), 0.8)
    assert sorted(map(tuple, got.collect())) == greedy([(*k, s) for k, s in best.items()], 0.8)


def test_matching_along_a_chain_and_of_nothing(spark):
    chain = [(f"x{k:02}", f"y{k + d:02}", 0.8 + k / 1000 + d / 2000) for k in range(12) for d in (0, 1)]
    df = spark.createDataFrame(chain, "x string, y string, score double")
    assert sorted(map(tuple, matching.greedy_matching(df).collect())) == greedy(chain, 0.8)
    assert matching.greedy_matching(df.limit(0)).count() == 0
    empty = spark.createDataFrame([], "name string")
    assert tuple(matching.fuzzy_agreement(matching.match_names(empty, empty)).first()) == (0, 0, 0, 1.0)
    a, b = (spark.createDataFrame([(n,) for n in ns], "name string") for ns in (["Neural Networks", "gradient descent method", "", "Alone"], ["neural network", "gradient descent methods", "the gradient descent", "..."]))
    rows = sorted(map(tuple, matching.match_names(a, b, 0.8).collect()), key=repr)
    assert ("neural network", "neural network", 1.0) in rows and ("gradient descent method", "gradient descent method", 1.0) in rows
    assert ("alone", None, None) in rows and (None, "gradient descent", None) in rows and len(rows) == 4


def reach(pairs):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    out = {}
    for a in {x for p in pairs for x in p}:
        seen, stack = set(), [a]
        while stack:
            for x in after.get(stack.pop(), set()) - seen:
                seen.add(x)
                stack.append(x)
        out[a] = seen
    return out


@pytest.mark.parametrize("local", [0, 7, None])
def test_strong_components(spark, local):
    r = random.Random(local or 99)
    ring = [(100 + k, 100 + (k + 1) % 15) for k in range(15)]
    pairs = list({(r.randrange(40), r.randrange(40)) for _ in range(60)}) + ring + [(5, 100), (103, 60), (60, 61), (61, 61)]
    e = spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in pairs], "source string, target string").repartition(3)
    to = reach(pairs)
    want = {}
    for a in to:
        group = {b for b in to[a] if a in to.get(b, ())} | {a}
        if len(group) > 1:
            want[f"n{a:03}"] = f"n{min(group):03}"
    assert {x.node: x.root for x in strong.strong_components(e, local).collect()} == want
    on = {(f"n{a:03}", f"n{b:03}") for a, b in pairs if a == b or want.get(f"n{a:03}", 0) == want.get(f"n{b:03}", 1)}
    assert {(x.source, x.target) for x in strong.cycle_edges(e, local).collect()} == on
    assert strong.strong_components(e.limit(0), local).count() == 0


def test_gates_of_a_large_component(spark):
    """A ring and many chords in one component: every edge that points back is refused, whatever the others."""
    n, r = 400, random.Random(1)
    rows = [("g", f"n{k:04}", f"n{k + 1:04}", "before", None, k) for k in range(n)] + [("g", f"n{n:04}", "n0000", "before", None, n)]
    for k in range(3000):
        a, b = r.sample(range(n + 1), 2)
        rows.append(("g", f"n{a:04}", f"n{b:04}", "before", None, n + 1 + k))
    types = spark.createDataFrame([("before", False, False, True)], "type string, scored boolean, symmetric boolean, dag boolean")
    df = spark.createDataFrame(rows, "g string, source string, target string, type string, relevance int, seq int")
    got = {x.seq: x.gate for x in gates.gate_edges(df, spark.createDataFrame([(f"n{k:04}",) for k in range(n + 1)], "id string"), types, "g").collect()}
    seen = set()
    for _, a, b, _, _, seq in rows:
        assert got[seq] == ("dag" if a > b else "duplicate_edge" if (a, b) in seen else None)
        seen.add((a, b))


@pytest.mark.parametrize("seed", range(3))
def test_components_in_batches(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(70, 70)]
    whole = components.connected_components(spark.createDataFrame(links, "a long, b long"))
    want = {x.node: x.root for x in whole.collect()} | {x: x for p in links for x in p if p[0] == p[1] and p[0] not in {y for q in links if q[0] != q[1] for y in q}}
    roots, size = {}, r.choice([1, 10, 25])
    table = spark.createDataFrame([], "node long, root long")
    for k in range(0, len(links), max(size, 12)):
        change = components.extend_components(table, spark.createDataFrame(links[k : k + max(size, 12)], "a long, b long")).collect()
        assert all(roots.get(x.node) != x.root for x in change)
        roots |= {x.node: x.root for x in change}
        table = spark.createDataFrame(list(roots.items()), "node long, root long")
    assert roots == want


def sequential(rows):
    """The consolidator, concept by concept."""
    by_key, aliases, nodes, out = {}, {}, [], {}
    for pos, raw, name, th in rows:
        if not (name or "").strip():
            out[pos] = None
            continue
        keys = [k for k in ((x or "").strip().lower() for x in (name, th)) if k]
        at = next((by_key[k] for k in keys if k in by_key), aliases.get(raw) if raw else None)
        if at is None:
            at = len(nodes) + 1
            nodes.append([at, name.strip(), (th or "").strip() or None])
        elif nodes[at - 1][2] is None and (th or "").strip():
            nodes[at - 1][2] = th.strip()
        for k in keys:
            by_key.setdefault(k, at)
        if raw:
            aliases.setdefault(raw, at)
        out[pos] = at
    return out, nodes


@pytest.mark.parametrize("sizes", [[80], [1, 30, 49], [40, 40]])
def test_concepts_do_not_depend_on_batches(spark, sizes):
    r = random.Random(7)
    names = [f"Name {k}" for k in range(18)]
    rows = [(k, r.choice([f"c{r.randrange(12)}", None, ""]), r.choice([*names, "", None, " "]) if r.random() < 0.2 else r.choice(names), r.choice([None, "", r.choice(names), f"ชื่อ {r.randrange(9)}"])) for k in range(80)]
    want, nodes_want = sequential(rows)
    tokens, nodes = concepts.empty_store(spark)
    got, at = {}, 0
    for n in sizes:
        batch = spark.createDataFrame(rows[at : at + n], "pos long, raw_id string, name string, name_th string").repartition(3)
        assigned, tokens, nodes = concepts.consolidate_concepts(batch, tokens, nodes, key=lambda c: F.lower(F.trim(c)))
        got |= {x.pos: x.canonical for x in assigned.collect()}
        at += n
    assert got == want
    assert sorted([x.canonical, x.name, x.name_th] for x in nodes.collect()) == nodes_want


def test_numbers(spark):
    r = random.Random(2)
    rows = [(r.randrange(50), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "v int, k int").repartition(7)
    got = ordering.numbered(df, F.desc("v"), "k", start=5).collect()
    assert [(x.v, x.k, x.number) for x in sorted(got, key=lambda x: x.number)] == [(v, k, 5 + i) for i, (v, k) in enumerate(sorted(rows, key=lambda x: (-x[0], x[1])))]
    assert ordering.numbered(df.limit(0), "k").count() == 0
    assert Counter(x.number for x in ordering.numbered(df, "v").collect()) == Counter(range(1, 3001))


def test_a_core_of_many_edges_stays_off_the_driver(spark, monkeypatch):
    monkeypatch.setattr(graph, "LOCAL", 50)
    r = random.Random(3)
    pairs = {(r.randrange(2000), r.randrange(2000)) for _ in range(6000)}
    e = spark.createDataFrame([(a, b) for a, b in pairs if a != b], "source int, target int")
    roots = strong.strong_components(e).groupBy("root").count().collect()
    big = max(x["count"] for x in roots)
    assert big > 1500 and len(roots) == 1
