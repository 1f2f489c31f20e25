"""Calls of a run, versions as of a time, running sums, and white space, against plain loops."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.functions import kernels as k
from weftgraph.functions import text as tx
from weftgraph.operators import flow, ordering, rules


def run_calls(rows, cap, budget, waits):
    out, state = {}, {}
    for run, seq, limited, wait, cost in sorted(rows, key=lambda r: r[1]):
        s = state.setdefault(run, {"waited": 0, "spent": 0, "why": None})
        if s["why"] is None and s["spent"] > budget:
            s["why"] = "budget"
        if s["why"] is None and limited and ((wait or 0) > cap or s["waited"] >= waits):
            s["why"] = "rate_limit"
        if s["why"]:
            out[seq] = ("deferred", s["why"], s["spent"])
            continue
        out[seq] = ("waited" if limited else "proceed", None, s["spent"])
        s["waited"] += bool(limited)
        s["spent"] += cost or 0
    return out


@pytest.mark.parametrize("waits", [1, 2])
def test_decisions_of_calls(spark, waits):
    r = random.Random(waits)
    rows = [(r.choice([1, 1, 1, 2, 3, 4, None]), k, r.choice([True, False, False, False, False, None]), r.choice([None, 5.0, 10.0, 50.0]), r.choice([None, 1, 2, 9])) for k in range(400)]
    df = spark.createDataFrame(rows, "run long, seq long, limited boolean, wait double, cost long").repartition(5)
    got = {x.seq: (x.decision, x.reason, x.spent) for x in flow.call_decisions(df, 20, 60, waits).collect()}
    assert got == run_calls(rows, 20, 60, waits)
    assert flow.call_decisions(df.limit(0), 20, 60).count() == 0


def test_running_sums_of_a_key_over_many_ranges(spark):
    rows = [(1 if k % 10 else 2, k, k % 7) for k in range(5000)]
    df = spark.createDataFrame(rows, "g int, k int, v int").repartition(6)
    got = {x.k: x.s for x in ordering.running_sums(df, "g", "k", s=F.col("v")).collect()}
    total, want = {1: 0, 2: 0}, {}
    for g, key, v in rows:
        want[key] = total[g]
        total[g] += v
    assert got == want


def test_versions_as_of_a_time(spark):
    r = random.Random(4)
    facts = [(k, r.choice(["a", "a", "b", "c", None]), r.choice([None, *range(20)])) for k in range(300)]
    versions = [(r.choice(["a", "b", None]), r.choice([None, *range(20)]), v) for v in range(40)]
    f, v = spark.createDataFrame(facts, "k int, g string, t int").repartition(3), spark.createDataFrame(versions, "g string, t int, v int")
    got = {x.k: x.v for x in flow.as_of(f, v, "g", "t", ["v"]).collect()}
    want = {}
    for key, g, t in facts:
        met = [(vt, vv) for vg, vt, vv in versions if g is not None and t is not None and vg == g and vt is not None and vt <= t]
        want[key] = max(met)[1] if met else None
    assert got == want


ODD = st.lists(st.sampled_from(["idk", "Not sure", "no", "clue", "x = 3", "trust me", "I'm sure", "right?", "ไม่รู้", "é", "abcdefgh", " ", " ", "\r", "\x85", " ", "　", "\x1c", "\n", "?", ".", ",", "ſ", "!"]), max_size=7).map("".join)


def columns(spark, texts, *made):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [tuple(r)[1:] for r in sorted(df.select("i", *made).collect())]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ODD, min_size=30, max_size=60))
def test_columns_know_the_white_space_of_unicode(spark, texts):
    t = F.col("text")
    got = columns(spark, texts, tx.squeeze(t), tx.estimate_tokens_pieces(t), tx.has_attempt(t), F.size(tx.pieces(t)))
    for text, (squeezed, tokens, attempt, n) in zip(texts, got):
        assert squeezed == " ".join(text.split())
        want = 0
        for p in text.split():
            plain = sum(c < "\x80" for c in p)
            want += (1 + plain // 8 if plain else 0) + len(p) - plain
        assert (tokens, attempt, n) == (want, k.has_attempt(text), len(text.split())), repr(text)


def test_pressure_with_other_spaces(spark):
    pattern = re.compile("|".join(rules.PRESSURE), re.I)
    texts = ["trust me, x = 3", " I'm sure it is 4\r", "just\x85agree", "nothing here ", "Surely　x = 2, right ?"]
    got = columns(spark, texts, rules.strip_pressure(F.col("text")).alias("p"))
    for text, (p,) in zip(texts, got):
        assert p["removed"] == [m[0].strip() for m in pattern.finditer(text)]
        assert p["text"] == p["text"].strip() and not pattern.search(p["text"])
    assert got[0][0]["text"] == "x = 3" and got[3][0]["text"] == "nothing here"
