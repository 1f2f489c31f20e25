"""Automata, near words and groups against all pairs and plain walks."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import queries, spelling_variants

from . import edge

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def counts(table):
    total = Counter()
    for doc, text in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def groups(n):
    """The definition; candidates by one deleted letter, so that it ends on whole tables."""
    keys = {}
    for w in n:
        for k in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            keys.setdefault(k, []).append(w)
    around = {w: sorted({x for k in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} for x in keys[k] if near(w, x)}) for w in n}
    form = {}
    for w, xs in around.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(around[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


@settings(max_examples=80, deadline=None)
@given(st.sets(st.text(alphabet="abé", min_size=1, max_size=9), min_size=1, max_size=40), st.booleans())
def test_automata_number_and_find_words(some, backward):
    w = spelling_variants.Words(pa.array(sorted(some)), backward)
    a = spelling_variants.Automaton(w)
    ordered = sorted(x[::-1] if backward else x for x in some)
    ask = np.arange(len(ordered))
    for part in (lambda s: s // 2, lambda s: s - s // 2):
        exact = part(w.size)
        q, x = spelling_variants.search(a, w, ask, exact)
        got = sorted(zip(q.tolist(), x.tolist()))
        want = sorted((i, j) for i, u in enumerate(ordered) for j, v in enumerate(ordered) if v[: exact[i]] == u[: exact[i]] and near(u, v))
        assert got == want
    # no two states accept the same endings
    def endings(s):
        return frozenset(([""] if a.final[s] else []) + [chr(a.label[e]) + t for e in range(a.first[s], a.first[s + 1]) for t in endings(a.to[e])])

    all_endings = [endings(s) for s in range(len(a.final))]
    assert len(set(all_endings)) == len(all_endings)
    assert len(all_endings[a.root]) == len(some)


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 40, "crowd": 3}, {"bucket_rows": 10_000, "crowd": 2}])
def test_groups(spark, options):
    n = {}
    for k, w in enumerate("colour color colours colors colur coloor kolour aaaaa aaaaaa aaaaaaa aaaab aaaba baaaa baaaaa abaaaa straße strasse strâße strase ærøskøb ærøskob".split()):
        n[w] = 3 + (k * 7919) % 97
    n |= {"x" * 3000 + s: 5 + k for k, s in enumerate(["", "y", "yz", "z"])}
    df = spark.createDataFrame(sorted(n.items()), "word string, n long")
    got = spelling_variants.group(df, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == groups(n)


def test_long_chains_of_forms(spark):
    n = {"abcdefgh"[:k] + "vwxyz123"[k:].replace("1", "p").replace("2", "q").replace("3", "r"): 3 * 2**k for k in range(9)}
    got = spelling_variants.group(spark.createDataFrame(sorted(n.items()), "word string, n long")).collect()
    assert {r.root for r in got} == {"abcdefgh"} and len(got) == 9


def test_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "HELD", 50)
    rows = [(i, t) for i, t, *_ in edge.rows()] + [(k % 7 or None, "Größe GRÖSSE größe Große ×÷×÷× naïve naive") for k in range(30)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, word string").repartition(3)
    got = spelling_variants.group(spelling_variants.dictionary(df, damage=97)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == groups(counts(rows))
    assert spelling_variants.group(spelling_variants.dictionary(df.limit(0))).count() == 0


def test_query_against_the_definition(spark):
    sf = "/root/testdata/sf0.001"
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op12_spelling_variants(spark, sf).collect())) == groups(counts(table))
