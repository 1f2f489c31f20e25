"""Each operator against brute force and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.llm import context_tree, cover_dedup, exchange, line_neighbourhood, line_rules, quality_fm, simhash_pivots, source_mix, template_decontam, token_files, toxic_segments, words
from weftgraph.operators import components

from . import edge

SPACE = r"[\x20\x09-\x0D]+"


def pairs():
    return [(r[0], r[1]) for r in edge.rows()]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def small_chunks(monkeypatch):
    monkeypatch.setattr(exchange, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(exchange, "RANGE_KEYS", 200)
    monkeypatch.setattr(exchange.chunked, "__defaults__", ("doc_id", "text", 4000))


# words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \t\nabé.ß\x0b", max_size=30), max_size=6))
def test_spans_are_the_words_of_each_text(texts):
    buf, off = words.text_buffer(pa.array(texts, pa.string()))
    s, e, first = words.spans(buf, off)
    raw = buf.tobytes()
    found = [[raw[s[k] : e[k]] for k in range(first[d], first[d + 1])] for d in range(len(texts))]
    assert found == [t.encode().split() for t in texts]
    h = words.word_hashes(buf, s, e)
    flat = [w for t in found for w in t]
    assert len(set(flat)) == len(set(h.tolist()))
    for size in (2, 3):
        ok = words.within(first, len(h), size)
        at = [k for k in range(len(h) - size + 1) if any(first[d] <= k and k + size <= first[d + 1] for d in range(len(texts)))]
        assert np.flatnonzero(ok).tolist() == at
        w = words.window_hashes(h, size)
        assert all((w[i] == w[j]) == (flat[i : i + size] == flat[j : j + size]) for i in range(len(w)) for j in range(len(w)))


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    buf, off = words.text_buffer(pa.array([edge.prose(1, 500), "x" * 5000, "a b"]))
    s, e, _ = words.spans(buf, off)
    h = words.word_hashes(buf, s, e)
    monkeypatch.setattr(words, "BLOCK", 64)
    assert (words.word_hashes(buf, s, e) == h).all()
    index = words.Index(np.unique(h))
    assert (np.unique(h)[index.find(h)] == h).all()
    assert (index.find(np.array([1, 2], np.uint64)) == -1).all()


# 1


def test_machine_matches_the_pairwise_sum():
    m = quality_fm.Machine()
    m.w[:] = np.linspace(-1, 1, len(m.w))
    at, i, v, stats = quality_fm.features(pa.array(["one two two three!", "", None]), np.array([18.0, 0.0, 0.0]))
    at, i, v = m.entries(at, i, v, stats)
    y, _, _ = m.raw(at, i, v)
    for d in range(3):
        own = range(at[d], at[d + 1])
        want = sum(m.w[i[a]] * v[a] for a in own) + sum(m.v[i[a]] @ m.v[i[b]] * v[a] * v[b] for a in own for b in own if a < b)
        assert abs(y[d] - want) < 1e-9


def test_quality_on_odd_rows(spark):
    docs, labels = edge.documents(spark), edge.labels(spark)
    r = quality_fm.score(docs, labels).collect()
    assert len(r) == len(edge.rows()) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in r)
    assert all(x.held_out == (zlib.crc32(b"" if x.doc_id is None else str(x.doc_id).encode()) % 3 == 1) for x in r)
    assert quality_fm.score(edge.nothing(spark), labels).count() == 0
    assert {x.score for x in quality_fm.score(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality_fm.accept(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(x.predicted for x in r)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = quality_fm.score(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out")
    right = r.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.97


# 2


def mixed(rows):
    """The definition, with a sorted pass per source."""
    size = [len((t or "").encode().split()) for _, t, *_ in rows]
    src = [r[3] for r in rows]
    total = Counter()
    for s, n in zip(src, size):
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free, left = {}, set(names), sum(total.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 3 * total[s]}
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 3.0 * total[s]
        free -= full
        left = sum(total.values()) - sum(target[s] for s in target)
    return size, src, total, target


def test_mix(spark):
    rows = edge.rows()
    size, src, total, target = mixed(rows)
    r = source_mix.mix(edge.documents(spark)).collect()
    assert len(r) == len(rows)
    assert Counter((x.doc_id, x["size"], x.source_size) for x in r) == Counter((row[0], n, total[s]) for row, n, s in zip(rows, size, src))
    by_size = {}
    for x in r:
        assert x.taken % max(1, x["size"]) == 0 and x.taken <= 3 * x["size"]
        by_size.setdefault(x.source_size, []).append(x)
    for s, n in total.items():
        assert any(abs(x.target - target[s]) < 1e-6 for x in by_size[n])
    again = source_mix.mix(edge.documents(spark).repartition(1)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, r))
    out = source_mix.apply_mix(edge.documents(spark))
    assert out.columns == edge.documents(spark).columns and out.count() == sum(x.times for x in r if x["size"])
    assert source_mix.mix(edge.nothing(spark)).count() == 0


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = source_mix.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(x.taken - x.target) <= x.most for x in r)


# 3


def lines_judged(text):
    w = (text or "").encode().split()
    seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    cover = {p for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
    real = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text or "")), len(real) - len(set(real)), len(cover))


def test_line_rules(spark):
    r = line_rules.judge(edge.documents(spark)).collect()
    assert Counter((x.doc_id, *x[1:6]) for x in r) == Counter((i, *lines_judged(t)) for i, t in pairs())
    assert all(x.base_failed == (x.n_words < 20 or 100 * x.n_repeat_words > 30 * x.n_words) and not (x.kept and x.base_failed) for x in r)
    assert line_rules.judge(edge.nothing(spark)).count() == 0
    text = edge.prose(1, 60) + "\nHome | About | News | Contact\nAll rights reserved.\nMenu\n" + edge.prose(2, 40)
    x = line_rules.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert x.kept and x.n_words - x.n_kept_words == 11 and "About" not in x.clean_text and "rights" not in x.clean_text


# 4


@pytest.mark.parametrize("bucket", [32, 2])
def test_simhash(spark, bucket):
    r = simhash_pivots.cluster(edge.documents(spark), bucket=bucket).select("doc_id", simhash_pivots.hexadecimal(F.col("fp")), "component_id")
    assert got(r) == sorted(simhash_pivots.brute_force(pairs()), key=repr)
    assert simhash_pivots.cluster(edge.nothing(spark)).count() == 0


def test_pivots_discard_what_blocks_propose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    n = simhash_pivots.filter_counts(simhash_pivots.fingerprints(docs).select("fp").distinct())
    assert n["lost"] == 0 and n["verified"] <= n["left_by_pivots"] < n["proposed"]
    assert n["left_by_pivots"] - n["verified"] < (n["proposed"] - n["verified"]) / 4
    row = simhash_pivots.pivot_table(spark.createDataFrame([(-5,), (7,)], "fp long")).collect()
    for r in row:
        own = [(r[1 + k // 8] >> 8 * (k % 8)) & 127 for k in range(simhash_pivots.PIVOTS)]
        assert own == [((r.fp % (1 << 64)) ^ p).bit_count() for p in simhash_pivots.pivots()]


def test_components_of_stars_and_chains(spark):
    edges = [(0, k) for k in range(1, 300)] + [(1000 + k, 1001 + k) for k in range(70)] + [(5000, 4000), (4000, 4000)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(300)} | {k: 1000 for k in range(1000, 1071)} | {4000: 4000, 5000: 4000}


def test_join_of_hubs_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 3)
    many = spark.createDataFrame([(k % 7 if k % 3 else 1, k) for k in range(200)] + [(None, 900), (50, 901)], "key long, v long")
    one = many.filter("key < 50").groupBy("key").agg(F.count("v").alias("n"))
    for how in ("inner", "left"):
        assert got(components.join_hubs(many, one, ["key"], how=how).select("key", "v", "n")) == got(many.join(one, "key", how).select("key", "v", "n"))
    assert got(components.join_spread(many, one, ["key"]).select("key", "v", "n")) == got(many.join(one, "key").select("key", "v", "n"))


@pytest.mark.parametrize("bucket", [16, 3])
def test_links_of_dense_fingerprints(spark, bucket):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(60)})
    signed = [simhash_pivots._signed(x) for x in fps]
    edges = simhash_pivots.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket=bucket)
    roots = {r.node: r.root for r in components.connected_components(edges).collect()}
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(signed[i]), find(signed[j])))
                parent[b] = a
    assert {x: roots.get(x, x) for x in signed} == {x: find(x) for x in signed}


def test_one_document_of_each_group_stays(spark):
    docs = edge.documents(spark)
    kept = simhash_pivots.representatives(docs)
    assert kept.columns == docs.columns
    groups = {x[2] for x in simhash_pivots.brute_force(pairs()) if x[2] is not None}
    found = [x.doc_id for x in kept.collect()]
    # two groups have 14 as their least id
    assert set(found) - {None} == groups and len(found) == len(set(found)) + 1 and found.count(14) == 2


# 5


def judged(spark, texts, items, **options):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {x.doc_id: [(i["item_id"], i["kind"]) for i in x["items"]] for x in template_decontam.matches(d, b, **options).collect()}


def test_decontamination(spark):
    item = "A shop in Berlin sells 12 apples for 30 dollars each day. How many apples does Tom buy when Tom pays 45 dollars for them?"
    changed = item.replace("Berlin", "Oslo").replace("12", "17").replace("Tom", "Anna").replace("45 dollars", "99 euros")
    broken = item.replace("Tom buy", "Anna buy")
    pad = edge.prose(3, 50)
    texts = [pad + "\n" + item + "\n" + pad, pad + " " + changed + " " + pad, pad, None, "", " ".join(item.split()[:8]), broken]
    r = judged(spark, texts, [(7, item), (8, "two words"), (None, None)])
    assert r[0] == [(7, "verbatim")] and r[1] == [(7, "reparameterised")] and r[2] == r[3] == r[4] == r[5] == []
    assert judged(spark, texts, [(7, item), (8, "two words"), (9, pad)], slice_windows=5) | {} == judged(spark, texts, [(7, item), (8, "two words"), (9, pad)])
    assert judged(spark, texts, []) == {k: [] for k in range(len(texts))}


def test_inconsistent_slots_are_no_match(spark):
    item = "Tom saw 5 birds then Tom saw 5 cats then Tom saw 5 dogs and Tom left 5 of them."
    bad = "Tom saw 5 birds then Ann saw 6 cats then Bob saw 7 dogs and Eve left 8 of them."
    good = "Ann saw 6 birds then Ann saw 6 cats then Ann saw 6 dogs and Ann left 6 of them."
    r = judged(spark, ["Once " + bad, "Once " + good], [(1, "Once " + item)])
    assert r == {0: [], 1: [(1, "reparameterised")]}


def test_decontamination_on_odd_rows(spark):
    docs = edge.documents(spark)
    bench = spark.createDataFrame([(1, edge.prose(9, 40))], "item_id long, text string")
    clean = template_decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert Counter(x.doc_id for x in clean.collect()) == Counter(i for i, _ in pairs() if i not in (10, 11))
    assert template_decontam.decontaminate(edge.nothing(spark), bench).count() == 0


def test_every_planted_item_is_found(spark):
    sf = "/root/testdata/sf0.01"
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    flat = lambda t: " ".join(t.split())
    docs, items = [(x.doc_id, flat(x.text)) for x in d.collect()], [(x.item_id, flat(x.text)) for x in b.collect()]
    found = {(x.doc_id, i["item_id"]) for x in template_decontam.matches(d, b).collect() for i in x["items"]}
    assert found == {(k, i) for k, t in docs for i, q in items if q in t}


# 6


def test_cover_gives_every_difference():
    assert {(a - b) % cover_dedup.PERIOD for a in cover_dedup.COVER for b in cover_dedup.COVER} == set(range(cover_dedup.PERIOD))
    with pytest.raises(ValueError):
        cover_dedup.deduplicate(None, 35, 21, (0, 1, 2))


def test_substring_dedup(spark, monkeypatch):
    small_chunks(monkeypatch)
    r = cover_dedup.digests(cover_dedup.deduplicate(edge.documents(spark)))
    want = sorted(cover_dedup.brute_force(pairs()), key=repr)
    assert got(r) == want and sum(x[2] for x in want) > 300
    assert cover_dedup.deduplicate(edge.nothing(spark)).count() == 0


def test_substring_dedup_within_a_document(spark):
    text = edge.prose(1, 50) + " mid " + edge.prose(1, 50)
    r = cover_dedup.digests(cover_dedup.deduplicate(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert got(r) == cover_dedup.brute_force([(1, text)])


# 7


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=14))
def test_segments_are_the_maximal_ones(scores):
    """Against the recursive definition: the best segment, then those left and right of it."""

    def best(lo, hi):
        options = [(sum(scores[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
        top = max(options, default=(0,))
        if top[0] <= 0:
            return []
        a, b = top[3], top[4]
        return best(lo, a) + [(a, b, top[0])] + best(b, hi)

    found = toxic_segments.maximal_segments([float(s) for s in scores])
    assert sorted(s for _, _, s in found) == sorted(float(s) for _, _, s in best(0, len(scores)))


def test_toxicity_on_odd_rows(spark):
    docs, labels = edge.documents(spark), edge.labels(spark)
    r = toxic_segments.score(docs, labels).collect()
    assert len(r) == len(edge.rows()) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in r)
    assert toxic_segments.score(edge.nothing(spark), labels).count() == 0
    assert {x.score for x in toxic_segments.score(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = toxic_segments.score(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out")
    x = r.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted").cast("double"))), F.avg(F.when(F.col("toxic") == 0, F.col("predicted").cast("double")))).first()
    assert x[0] > 0.9 and x[1] < 0.02


def test_spans_point_at_the_passage(spark):
    rows = [(k, edge.prose(k, 40) + (" you vile rotten scoundrel" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    out = toxic_segments.score(docs, labels).collect()
    text = {r[0]: r[1].encode() for r in rows}
    for x in out:
        spans = [text[x.doc_id][s["start"] : s["stop"]] for s in x["segments"]]
        assert x.predicted == int(x.doc_id % 3 == 0) and bool(spans) == (x.doc_id % 3 == 0)
        assert all(s in b"you vile rotten scoundrel" for s in spans)


def test_tail_of_simulated_nulls():
    """Scores of chance alone: the fitted tail gives the chances that fresh texts show."""
    rng = np.random.default_rng(3)
    model = toxic_segments.Model()

    def texts(count):
        n = rng.integers(50, 400, count)
        first = np.concatenate(([0], np.cumsum(n)))
        return n, model.best(first, np.where(rng.random(first[-1]) < 0.06, rng.choice([1.0, 2.0], first[-1]), -0.3))

    guess = toxic_segments.drift(np.array([1.0, 2.0]), np.array([0.03, 0.03]), -0.3)
    model.rate, model.k = toxic_segments.fit_tail(*texts(1500), guess)
    assert 0.7 * guess < model.rate < 1.4 * guess
    n, best = texts(1500)
    chance = np.array([model.tail(int(a), float(s)) for a, s in zip(n, best)])
    assert 0.05 < np.mean(chance <= 0.1) < 0.16 and np.mean(chance <= toxic_segments.SIGNIFICANT) < 0.025
    assert toxic_segments.fit_tail(n[:5], best[:5], guess)[0] == guess


def test_token_counts_and_log_odds(spark):
    texts = [("You bad bad man", 1), ("bad day", 0), ("the bad man and the man", 0), ("badge", 1), (None, 0), ("man", 1)]
    rows = spark.createDataFrame(texts, "text string, _label int")
    found = sorted((r.kind, r.toxic, r.other, r.toxic_types, r.other_types) for r in toxic_segments._counts(rows).collect())
    tokens = {(k, w): [set() for _ in range(6)] for k in (1, 2) for t, _ in texts for w in (t or "").lower().split()}
    for i, (t, y) in enumerate(texts):
        w = (t or "").lower().split()
        for j, v in enumerate(w):
            for s, value in enumerate((i, w[j - 1] if j else "", v)):
                tokens[1, v][2 * s + y].add(value)
                if len(v) >= 4:
                    tokens.setdefault((2, v[:4]), [set() for _ in range(6)])[2 * s + y].add(value)
    want = [(k, min(len(x[1]), len(x[3])), min(len(x[0]), len(x[2])), len(x[5]) * (k == 2), len(x[4]) * (k == 2)) for (k, _), x in tokens.items() if any(x)]
    assert found == sorted(want)
    odds = toxic_segments.log_odds(np.array([40, 1, 5, 0]), np.array([1, 0, 5, 60]), (1e6, 1e6))
    assert odds[0] > 1 and odds[1] == odds[2] == 0 and odds[3] < -1


def test_quality_query_is_the_pairwise_sum(spark):
    docs, labels = edge.documents(spark).filter("doc_id <> 12"), edge.labels(spark)
    m = quality_fm.train(docs, labels)
    got_ = sorted((x.doc_id, round(x.score, 8)) for x in quality_fm.score(docs, labels).collect())
    want = []
    for r in docs.select("doc_id", "text", "n_chars").collect():
        at, i, v, stats = quality_fm.features(pa.array([r.text], pa.string()), np.array([float(r.n_chars or 0)]))
        _, i, v = m.entries(at, i, v, stats)
        y = m.bias + sum(m.w[a] * x for a, x in zip(i, v)) + sum(float(m.v[i[a]] @ m.v[i[b]]) * v[a] * v[b] for a in range(len(i)) for b in range(a))
        want.append((r.doc_id, round(float(1 / (1 + np.exp(-np.clip(y, -30, 30)))), 8)))
    assert got_ == sorted(want)

# 8


def near_words(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
        return False
    p = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    s = next((k for k in range(min(len(a), len(b))) if a[-1 - k] != b[-1 - k]), min(len(a), len(b)))
    return p + s >= max(len(a), len(b)) - 1


def lines_removed(rows):
    docs = {}
    for i, t in rows:
        docs.setdefault((i, t or ""), None)
    lines = [((i is None, i or 0, t), no, x.split()) for (i, t) in docs for no, x in enumerate(t.split("\n")) if x.split()]
    out = Counter()
    keys = {d: line_key(d) for d, _, _ in lines}
    for (i, t) in docs:
        own = [(no, w) for d, no, w in lines if d == (i is None, i or 0, t)]
        me = keys.get((i is None, i or 0, t))
        exact, near = [], []
        for no, w in own:
            earlier = [v for d, n, v in lines if (keys[d], n) < (me, no)]
            if w in earlier:
                exact.append(no)
            elif any(near_words(w, v) for v in earlier):
                near.append(no)
        out[i, len(own), len(exact), len(near), tuple(sorted(exact + near))] += 1
    return out


def line_key(d):
    return (d[0], d[1], hashlib.md5(d[2].encode()).hexdigest())


def test_line_dedup(spark):
    long = "a1 b2 c3 d4 e5 f6 g7"
    texts = [long, long.replace("c3", "zz"), long + " h8", "b2 c3 d4 e5 f6 g7", "x y", "x z", "q\n" + long + "\n\n  \nq", None, "", long.replace("c3", "zz").replace("f6", "yy"), "  a1  b2\tc3 d4 e5 f6 g7 ", "a1 a1 a1 a1 a1\na1 a1 a1 a1 a1 a1"]
    rows = list(enumerate(texts)) + [(None, "unique line of five words\n" + long)]
    r = line_neighbourhood.judge(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((x.doc_id, x.n_lines, x.n_exact, x.n_near, tuple(x.removed_lines)) for x in r.collect()) == lines_removed(rows)


def test_line_dedup_on_odd_rows(spark):
    rows = [p for p in pairs() if p[0] not in (12, 14)]  # ids that differ in text alone are ordered by a hash
    d = edge.documents(spark).filter("doc_id is null or doc_id not in (12, 14)")
    r = line_neighbourhood.judge(d)
    assert Counter((x.doc_id, x.n_lines, x.n_exact, x.n_near, tuple(x.removed_lines)) for x in r.collect()) == lines_removed(rows)
    assert line_neighbourhood.judge(edge.documents(spark)).count() == len(set(pairs()))
    assert line_neighbourhood.judge(edge.nothing(spark)).count() == 0


# 9


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))


def test_token_files(spark, tmp_path):
    t = tokenizer()
    rows = sorted(pairs(), key=lambda p: (p[0] is None, p[0] or 0))
    ids = [t.encode(x or "", add_special_tokens=False).ids + [2] for _, x in rows]
    r = token_files.encode(edge.documents(spark), folder=str(tmp_path / "a"), shard_bytes=30_000)
    found = sorted(r.collect(), key=lambda x: x.start)
    assert [x.doc_id for x in found] == [i for i, _ in rows]
    assert [x.start for x in found] == np.concatenate(([0], np.cumsum([x.n_tokens for x in found])[:-1])).tolist()
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert Counter((x.doc_id, x.n_tokens, x.ids_crc32) for x in found) == Counter((i, len(x), crc(x)) for (i, _), x in zip(rows, ids))
    assert len(list((tmp_path / "a").glob("*.bin"))) > 1
    assert token_files.encode(edge.nothing(spark), folder=str(tmp_path / "b")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["Hello,", "WORLD!!", "don't", "<|endoftext|>", "été.", "É", "ß", "3.14", "á", "ﬁn", "日本", "x y"])), max_size=8))
def test_words_encode_like_whole_texts(parts):
    import public_tokenizers

    enc = token_files._encoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert enc.wordwise
    text = " ".join(parts)
    texts = [text, None, text.upper() + " tail", "", "".join(parts)]
    want = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    ids, sizes = enc.encode(pa.array(texts), 2)
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_a_full_memory_changes_nothing(monkeypatch):
    import public_tokenizers

    enc = token_files.Encoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    monkeypatch.setattr(token_files, "REMEMBERED", 40)
    monkeypatch.setattr(token_files, "LOOSE", 10)
    for seed in (1, 2, 1, 3, 1):
        r = random.Random(seed)
        text = " ".join("".join(r.choices("abcdeé", k=6)) for _ in range(200)) + " Größe don't 3.14"
        assert enc.encode(pa.array([text]), 2)[0].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids + [2]
    assert len(enc.old) and len(enc.loose) + len(enc.young) < 500


# 10


@pytest.mark.parametrize("depth", [3, 6])
def test_context_tree(spark, monkeypatch, depth):
    small_chunks(monkeypatch)
    rows = [p for p in pairs() if p[0] != 12]
    monkeypatch.setattr(context_tree, "RANGE_KEYS", 200)
    monkeypatch.setattr(context_tree, "CHUNK_BYTES", 4000)
    r = context_tree.score(edge.documents(spark).filter("doc_id is null or doc_id <> 12"), depth=depth, slice_chunks=2).collect()
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _ in rows]
    tokens = [(t or "").encode().lower().split() + [b"\n"] for _, t in rows]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    base = [sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t) for t in tokens]
    model = context_tree.brute_force(rows, held, depth)
    want = sorted((repr(i), h, len(t), sum(c[w] > 0 for w in t), n, round(b, 5), round(m, 3)) for (i, _), h, t, b, m in zip(rows, held, tokens, base, model))
    assert sorted((repr(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 5), round(x.score, 3)) for x in r) == want
    assert context_tree.score(edge.nothing(spark)).count() == 0


def test_byte_probabilities_sum_to_one():
    s = context_tree.Stream(pa.array(["the cat sat on the mat", "the dog"]), 3)
    g, n = np.unique(s.grams, return_counts=True)
    t = context_tree.Tree(g, n, 3).top()
    top = context_tree.Top(list(zip(*(t[c].tolist() for c in ("byte", "node", "zeros", "ones", "below")))))
    for context in (b"the", b"xyz", b" ca"):
        lead = int.from_bytes(context[::-1], "big") << 8
        own = np.array([lead | b for b in range(256)], np.uint64)
        keys = np.union1d(g, own)
        counts = np.zeros(len(keys))
        counts[np.searchsorted(keys, g)] = n
        p = np.exp(context_tree.Tree(keys, counts, 3).log_probability(top)[np.searchsorted(keys, own)])
        assert abs(p.sum() - 1) < 1e-9


def test_context_tree_beats_counting_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    r = context_tree.score(docs).filter("held_out").agg(F.avg((F.col("score") > F.col("base_score")).cast("double")), F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 0.9 and r[1] > r[2]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packed_numbers_come_back(values):
    x = np.array(sorted(values), np.uint64)
    assert (context_tree.unpack(context_tree.pack(x, True), np.uint64, True) == x).all()
    assert (context_tree.unpack(context_tree.pack(x[::-1]), np.uint64) == x[::-1]).all()


def test_all_rows_held_out(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    d = spark.createDataFrame([(i, "some words") for i in ids], "doc_id long, text string")
    r = context_tree.score(d).collect()
    assert len(r) == len(ids) and all(x.train_tokens == 0 and x.n_known == 0 and x.score < 0 for x in r)
