"""Cycles and layers without a bound on their length."""

import random

import pytest

from weftgraph.operators import gates, graph


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "prerequisite_of") for a, b in pairs], "source int, target int, type string")


def brute(pairs):
    """All simple cycles of two nodes or more, from their least node."""
    after, out = {}, set()
    for a, b in pairs:
        after.setdefault(a, set()).add(b)

    def go(path):
        for x in after.get(path[-1], ()):
            if x == path[0] and len(path) > 1:
                out.add(tuple(path))
            elif x > path[0] and x not in path:
                go([*path, x])

    for a in after:
        go([a])
    return out


@pytest.mark.parametrize("n", [6, 70])
def test_a_long_cycle_is_found(spark, n):
    ring = [(k, k % n + 1) for k in range(1, n + 1)]
    nodes = spark.createDataFrame([(k,) for k in range(1, n + 3)], "id int")
    found = gates.validate_map(nodes, edges(spark, [*ring, (n, n + 1), (n + 2, 1)]), graph.RELATIONS).collect()
    assert [(x.code, x.location) for x in found] == [("KL009", " > ".join(map(str, range(1, n + 1))))]
    chain = edges(spark, ring[:-1])
    assert gates.validate_map(nodes.filter(f"id <= {n}"), chain, graph.RELATIONS).isEmpty()


def test_reports_fill_up_with_long_cycles(spark):
    short, long = [(1, 2), (2, 1)], [(k, 11 + (k - 10) % 7) for k in range(11, 18)]
    got = graph.reported_cycles(edges(spark, short + long)).collect()
    assert [(x.path, x.length) for x in got] == [([1, 2], 2), (list(range(11, 18)), 7)]


def test_simple_cycles_against_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        n = rnd.randint(2, 7)
        pairs = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randint(1, 3 * n))}
        got = [tuple(x) for x in graph.simple_cycles(pairs)]
        assert len(got) == len(set(got)) and set(got) == brute(pairs)


def test_peeling_in_memory_and_by_joins(spark):
    rnd = random.Random(4)
    pairs = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(45)}
    e = edges(spark, pairs)
    left = set(pairs)
    while True:
        sources, targets = {a for a, _ in left}, {b for _, b in left}
        kept = {(a, b) for a, b in left if a in targets and b in sources}
        if kept == left:
            break
        left = kept
    assert left and len(left) < len(pairs)
    assert set(graph.cyclic_core(e)) == set(graph.cyclic_core(e, local=0)) == left
    assert graph.cyclic_core(edges(spark, [(1, 2), (2, 3), (1, 3)]), local=0) == []


def test_layers_of_a_long_chain(spark):
    nodes = spark.createDataFrame([(k,) for k in range(101)], "id int")
    e = edges(spark, [(k, k + 1) for k in range(99)])
    assert {x.id: x.layer for x in graph.layers(nodes, e).collect()} == {k: k for k in range(100)} | {100: 0}


def test_layers_by_joins_and_refusal_of_cycles(spark):
    nodes = spark.createDataFrame([(k,) for k in range(1, 6)], "id int")
    e = edges(spark, [(1, 2), (2, 3), (1, 3), (3, 4), (9, 1)])
    assert {x.id: x.layer for x in graph.layers(nodes, e, local=0).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 0}
    for local in (0, None):
        with pytest.raises(ValueError):
            graph.layers(nodes, edges(spark, [(1, 2), (2, 1)]), local=local)
