"""The ordered gates against a plain pass in input order."""

import random
from collections import defaultdict

import pytest

from weftgraph.operators import components, entities, gates, graph

EDGE = "g string, source string, target string, type string, relevance int, seq int"


def plain(rows, kinds, ids):
    after, seen, out = defaultdict(set), set(), {}
    for g, a, b, t, _, seq in sorted(rows, key=lambda r: r[5]):
        scored, sym, dag = kinds.get(t, (None, None, None))
        if scored is None:
            out[seq] = "out_of_schema"
            continue
        if a == b or a not in ids or b not in ids:
            out[seq] = "self_edge" if a == b else "dangling"
            continue
        k = (g, t, *sorted((a, b))) if sym else (g, t, a, b)
        stack, met = [b], {b}
        while stack:
            for x in after[g, t, stack.pop()] - met:
                met.add(x)
                stack.append(x)
        if k in seen:
            out[seq] = "duplicate_edge"
        elif dag and a in met:
            out[seq] = "dag"
        else:
            seen.add(k)
            after[g, t, a].add(b)
            out[seq] = None
    return out


@pytest.mark.parametrize("local", [0, 1000])
def test_gates_in_order(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL", local)
    rnd = random.Random(local)
    kinds = {"before": (False, False, True), "like": (False, True, False), "both": (False, True, True)}
    rows = [(rnd.choice("xy"), f"n{rnd.randrange(9)}", f"n{rnd.randrange(9)}", rnd.choice([*kinds, "before", "before", "odd"]), None, k) for k in range(150)]
    ids = {f"n{k}" for k in range(8)}
    types = spark.createDataFrame([(t, *x) for t, x in kinds.items()], "type string, scored boolean, symmetric boolean, dag boolean")
    nodes = spark.createDataFrame([(x,) for x in ids], "id string")
    df = spark.createDataFrame(rows, EDGE).repartition(4)
    got = {r.seq: r.gate for r in gates.gate_edges(df, nodes, types, "g").collect()}
    assert got == plain(rows, kinds, ids)
    one = [("x", *r[1:]) for r in rows]
    got = {r.seq: r.gate for r in gates.gate_edges(spark.createDataFrame(one, EDGE), nodes, types).collect()}
    assert got == plain(one, kinds, ids)


def test_components(spark):
    edges = [(0, k) for k in range(1, 40)] + [(100 + k, 101 + k) for k in range(20)] + [(500, 400), (400, 400)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(40)} | {k: 100 for k in range(100, 121)} | {400: 400, 500: 400}


def test_entities_are_merged_in_order(spark):
    """Against a fold over all candidates of a corpus."""
    rnd = random.Random(5)
    names = [f"name{k} x" for k in range(14)]
    rows = [(c, p, rnd.choice(names), rnd.choice(["", "d"]), rnd.sample(names, rnd.randint(0, 2)), [f"s{p % 4}"]) for c in "ab" for p in range(25)]
    df = spark.createDataFrame(rows, "corpus string, pos int, title string, definition string, aliases array<string>, sources array<string>").repartition(3)
    got = {}
    for r in sorted(entities.consolidate(df).collect(), key=lambda r: (r.corpus, r.seq)):
        got.setdefault(r.corpus, []).append((r.seq, r.title, r.definition, r.aliases, r.sources, r.n_merged))
    for c in "ab":
        drafts, titles, aliases = [], {}, {}

        def unite(a, b):
            a[2] += [x for x in [b[0], *b[2]] if x not in [a[0], *a[2]]]
            a[3] += [x for x in b[3] if x not in a[3]]
            a[4] += b[4]
            a[1] = a[1] or b[1]

        for _, _, title, definition, also, sources in (r for r in rows if r[0] == c):
            met = sorted({titles.get(title), aliases.get(title), *(titles.get(a) for a in also)} - {None})
            if not met:
                met = [len(drafts)]
                drafts.append([title, definition, list(also), list(sources), 1])
            else:
                unite(drafts[met[0]], [title, definition, list(also), list(sources), 1])
                for other in met[1:]:
                    unite(drafts[met[0]], drafts[other])
                    drafts[other] = None
                    for d in (titles, aliases):
                        d.update({n: met[0] for n, k in d.items() if k == other})
            titles.setdefault(drafts[met[0]][0], met[0])
            for a in drafts[met[0]][2]:
                aliases.setdefault(a, met[0])
        assert got[c] == [(i + 1, *d) for i, d in enumerate(d for d in drafts if d)]
