"""Conversation repair against a shortest-path search over whole edit scripts."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from weftgraph.llm import queries, turn_repair

SOLID = re.compile(r"[^\x20\x09-\x0D]")
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def search(rows):
    """Least (cost, audit, repaired turns) of rows (initial, role, text, must_go, truncated), by Dijkstra on cost and audit."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if at == len(rows) and state in (0, 3):
            return cost, audit, out
        if (at, state) in done:
            continue
        done.add((at, state))
        for letter, role in (("u", "user"), ("a", "assistant")):
            if (state, letter) in MOVES:
                to = MOVES[state, letter]
                heapq.heappush(heap, (cost + 2, audit + "I", at, to, (*out, (role, ""))))
                if at < len(rows) and not rows[at][3]:
                    heapq.heappush(heap, (cost + 2 + rows[at][4], audit + "R", at + 1, to, (*out, (role, rows[at][2]))))
        if at < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, out))
            if not rows[at][3] and (state, rows[at][0]) in MOVES:
                heapq.heappush(heap, (cost + rows[at][4], audit + "K", at + 1, MOVES[state, rows[at][0]], (*out, (rows[at][1], rows[at][2]))))


def expected(table):
    """The contract, conversation by conversation; ties in a turn are left to the caller to avoid."""
    convs = {}
    for conv, turn, role, text in table:
        s = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        rows = convs.setdefault(conv, [])
        if kind == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
        seen, marked, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            solid = SOLID.findall(text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            marked.append((role[:1], role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, turns = search(marked)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_costs_and_audits(seed):
    r = random.Random(seed)
    convs = [[(r.choice("suax"), r.random() < 0.2, r.random() < 0.3) for _ in range(r.choice([0, 1, 2, 3, 5, 8, 13, 40]))] for _ in range(150)]
    flat = [x for c in convs for x in c]
    flags = [np.array([x[k] for x in flat], bool) for k in (1, 2)]
    cost, audit = turn_repair.cheapest(np.array([len(c) for c in convs]), np.array([".sua".find(x[0]) if x[0] != "x" else 0 for x in flat]), flags[0], flags[1] & ~flags[0])
    assert list(zip(cost.tolist(), audit)) == [search([(i, i, "", go, int(t and not go)) for i, go, t in c])[:2] for c in convs]


def odd():
    r = random.Random(5)
    rows = []
    for conv in [None, *range(60)]:
        for turn in [None, *range(r.choice([0, 1, 4, 9, 30]))][:: r.choice([1, 1, 2])]:
            rows.append((conv, turn, r.choice(["user", "assistant", "system", "tool", None, ""]), r.choice(["Yes.", "no", " \t\x0b", "", None, "Why?!  ", "é" * 5000 + ".", "a\nb."])))
    return rows


def test_on_odd_rows(spark):
    df = spark.createDataFrame([(*x, 1, "y") for x in odd()], "conv_id long, turn long, role string, text string, cost long, audit string").repartition(3)
    damaged = turn_repair.damage(df)
    assert sorted((tuple(x) for x in turn_repair.digests(damaged).collect()), key=repr) == expected(odd())
    turns = turn_repair.repaired(damaged).collect()
    by_conv = {}
    for t in sorted(turns, key=lambda t: t.place):
        by_conv.setdefault(t.conv_id, []).append(t)
    assert all(re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in c)) and [t.place for t in c] == list(range(len(c))) for c in by_conv.values())
    assert turn_repair.digests(turn_repair.damage(df.limit(0))).count() == 0


def test_ties_and_repeats_do_not_depend_on_partitions(spark):
    rows = [(1, 1, role, text) for role in ("user", "assistant") for text in ("a.", "b.", "a.")] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    first, again = (turn_repair.digests(turn_repair.plain(df.repartition(k))).collect() for k in (1, 5))
    assert first == again and first[0].duplicate == 14


def test_query_against_the_definition(spark):
    sf = "/root/testdata/sf0.01"
    table = [tuple(x) for x in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(x) for x in queries.op11_turn_repair(spark, sf).collect()), key=repr) == expected(table)
