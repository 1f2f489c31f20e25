"""Steps whose work must grow no faster than their input, against brute force."""

import random

import duckdb
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftgraph import catalogue, providers
from weftgraph.functions import text as tx
from weftgraph.operators import components, concepts, entities, reasoner, retrieval, strong

def _join_rows(df):
    """Rows that came out of each join of a collected plan."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if "Join" in name and node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        kids = node.children()
        todo += [kids.apply(k) for k in range(kids.size())]
    return found


BRUTE = catalogue.ORACLES["related_parts_topk"]


def test_related_parts_topk_equals_sql_on_odd_sizes(spark, tmp_path):
    r = random.Random(5)
    rows = [(k, f"t{r.randrange(4)}", "b", r.choice([None, 1, 2, 5, 40, 44, 90, 200])) for k in range(120)]
    rows += [(200, "alone", "b", 3), (201, None, "b", 3), (202, "two", "b", 1), (203, "two", "b", 99), (204, "two", "b", None)]
    rows += [(k, "many", "b", 7) for k in range(300, 330)]
    rows += [(k, "twice", "b", s) for k, s in ((400, 1), (400, 2), (401, 2), (402, 9), (403, 60), (403, 60))]
    schema = "p_partkey long, p_type string, p_brand string, p_size int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "part.parquet"))
    got = sorted(map(tuple, catalogue.QUERIES["related_parts_topk"](spark, str(tmp_path)).collect()))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    assert got == sorted(c.execute(BRUTE).fetchall())


def test_nearest_pairs_no_item_with_its_group(spark):
    """A plan of pairs would join 6,000 parts of one size to 36 million rows."""
    p = spark.range(6000).select(F.col("id").alias("p"), F.lit("t").alias("t"), F.lit(3).alias("s"))
    near = reasoner.nearest(p, "p", ["t"], "s", 3)
    got = {}
    for x in near.collect():
        got.setdefault(x.query_id, []).append((x.nbr, x.relevance))
    assert len(got) == 6000 and sorted(got[0]) == [(1, 100), (2, 100), (3, 100)] and sorted(got[5000]) == [(0, 100), (1, 100), (2, 100)]
    joined = [m for m in _join_rows(near)]
    assert joined and max(joined) <= 10 * 6000


def _ring_with_tails(n):
    """A ring of n nodes with two chords, a tail in and a tail out, and a ring apart."""
    ring = [(k, (k + 1) % n) for k in range(n)] + [(3, n // 2), (n // 2, 3)]
    tails = [(1000 + k, 1001 + k) for k in range(40)] + [(1040, 0), (5, 2000)] + [(2000 + k, 2001 + k) for k in range(40)]
    return ring + tails + [(3000 + k, 3000 + (k + 1) % n) for k in range(n)]


def test_rounds_of_strong_components_grow_with_choices_not_with_nodes(spark, monkeypatch):
    n = 300
    e = spark.createDataFrame(_ring_with_tails(n), "source long, target long")
    cuts, real = [], strong.cut
    monkeypatch.setattr(strong, "cut", lambda df: cuts.append(1) or real(df))
    got = {x.node: x.root for x in strong.strong_components(e, 10).collect()}
    assert got == {k: 0 for k in range(n)} | {3000 + k: 3000 for k in range(n)}
    assert len(cuts) < 90  # a step a node takes some 600


def test_joins_of_hot_keys_are_joins(spark, monkeypatch):
    monkeypatch.setattr(components, "PLAIN", 5)
    many = spark.createDataFrame([(k % 3, "x" if k % 5 else "y", k) for k in range(60)] + [(None, "x", 1)], "a long, b string, v long")
    one = many.dropna().select("a", "b").distinct().withColumn("w", F.col("a") * 10)
    hot = components.hot_keys(many, ["a", "b"])
    assert sorted(hot) == [(0, "x"), (1, "x"), (2, "x")] and components.hot_keys(many, ["a"], 5) == []
    want = sorted(map(tuple, many.join(one, ["a", "b"]).select("a", "b", "v", "w").collect()))
    for h in (None, [], hot):
        assert sorted(map(tuple, components.join_spread(many, one, ["a", "b"], h).select("a", "b", "v", "w").collect())) == want


def test_star_contractions_copy_nothing_without_hot_keys(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(50)], "a long, b long")
    for star in (components._large_star, components._small_star):
        assert "_salt" not in star(edges, 50)._jdf.queryExecution().analyzed().toString()


def test_quotes_leave_the_scan_with_their_texts_only(spark, monkeypatch):
    monkeypatch.setattr(entities, "QUOTE_BYTES", 40)
    r = random.Random(4)
    words = ["é", "ab", "c", "", "ñandú"]
    texts = [" ".join(r.choices(words, k=r.randint(0, 25))) for _ in range(60)] + [None, "", "a  b"]
    quotes = [t[i : i + r.randint(1, 30)] for t in texts[:40] for i in [r.randrange(len(t) + 1)]] + ["", "x y z u v w", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string").repartition(2)
    q = spark.createDataFrame(list(enumerate(quotes)), "item_id long, q string")
    met = entities.quotes_met(q, d, "item_id", "doc_id")
    want = sorted((i, j, x, t) for i, x in enumerate(quotes) for j, t in enumerate(texts) if x is not None and t is not None and x in t)
    assert sorted(map(tuple, met.collect())) == want
    assert "xxhash64" not in met._jdf.queryExecution().optimizedPlan().toString()  # no row for each run of words


def test_hybrid_topk_of_odd_vectors_in_tiles(spark, monkeypatch):
    """Copies, missing vectors and parts, other lengths: ranked as the product of every pair ranks them, and no pair is a row."""
    monkeypatch.setattr(retrieval, "TILE", 3)
    r = random.Random(8)
    vectors = [[r.uniform(-1, 1) for _ in range(4)] for _ in range(40)]
    vectors += [vectors[0]] * 30 + [None, [0.5, None, 0.1, 0.2], [0.5, 0.5], [], [float("nan"), 0.0, 0.0, 1.0]] + vectors[5:10]
    e = spark.createDataFrame([(k, v, k % 3) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").repartition(3)
    q = e.filter("vec_id % 7 = 0 or vec_id >= 70").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"), F.col("label").alias("query_label"))
    c = e.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    same = F.when(F.col("query_label") == F.col("label"), 1.0).otherwise(0.0)
    pairs = q.crossJoin(c).select("query_id", "chunk_id", tx.dot(F.col("query_embedding"), F.col("embedding")).alias("cosine"), same.alias("keyword"))
    near = pairs.withColumn("near", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "chunk_id"))).filter("near <= 8")
    score = near.withColumn("score", F.round(F.lit(0.75) * F.col("cosine") + F.lit(0.25) * F.col("keyword"), 6))
    want = score.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "near"))).filter("rank <= 2")
    columns = ["query_id", "chunk_id", "cosine", "keyword", "score", "rank"]
    got = retrieval.hybrid_topk(q, c, 2, keyword=same)
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_overlap_topk_in_tiles_shuffles_no_pair(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CELLS", 60)
    r = random.Random(6)
    some = lambda n: sorted({r.choice("abcdefghijklmnop") for _ in range(r.randint(0, n))})
    asked = [(k, some(9)) for k in range(13)] + [(20, []), (21, None), (22, ["zz"])]
    docs = [(k, some(14)) for k in range(150)] + [(500, None), (501, ["q"])]
    q = spark.createDataFrame(asked, "item_id long, fs array<string>")
    d = spark.createDataFrame(docs, "doc_id long, fs array<string>").repartition(3)
    want = []
    for i, f in asked:
        share = sorted(((-len(set(f or ()) & set(g or ())) / len(f) if f else -0.0, k) for k, g in docs))[:3]
        want += [(i, k, -s + 0.0, n + 1) for n, (s, k) in enumerate(share)]
    got = retrieval.overlap_topk(q, d, "item_id", "doc_id", 3)
    assert sorted(map(tuple, got.select("item_id", "doc_id", "score", "rank").collect())) == sorted(want)
    assert "count(1)" not in got._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 0)
    joined = retrieval.overlap_topk(q, d, "item_id", "doc_id", 3)
    assert sorted(map(tuple, joined.select("item_id", "doc_id", "score", "rank").collect())) == sorted(want)


def test_calls_hand_replies_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(providers, "REPLY_BYTES", 300)
    asked = spark.createDataFrame([(k, f"p{k}") for k in range(40)], "id int, prompt string").repartition(2)
    calls = providers.call_stage(asked, "s", providers.Stub({"p7": "no"}), "prompt", "id", ("digest",))
    rows = sorted(map(tuple, calls.select("id", "attempt_no", "outcome").collect()))
    assert rows == sorted([(k, 1, "ok") for k in range(40) if k != 7] + [(7, 1, "invalid"), (7, 2, "invalid")])
    assert "MapInArrow" in calls._jdf.queryExecution().executedPlan().toString()  # no frame of all texts of a batch


def _least(edges):
    up = {x: x for e in edges if e[0] != e[1] for x in e}
    while True:
        was = dict(up)
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
        if up == was:
            return up


def test_few_edges_are_searched_without_rounds(spark, monkeypatch):
    edges = [((k * 37) % 301, ((k + 1) * 37) % 301) for k in range(300)] + [(400, 400), (500, 450)]
    cuts, real = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: cuts.append(1) or real(df))
    assert {x.node: x.root for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()} == _least(edges)
    assert len(cuts) <= 3  # a round of joins at a time takes some ten
    assert components.connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).collect() == []


def test_rounds_of_components_read_fewer_edges_each_time(spark, monkeypatch):
    r = random.Random(3)
    n = 600
    edges = [(k, r.randrange(n)) for k in range(n)] + [(700, 800 + k) for k in range(40)] + [(900 + k, 901 + k) for k in range(30)] + [(1000 + k, 990) for k in range(9)]
    named = [(f"é{a:04}" if a % 2 else f"z{a:04}", f"é{b:04}" if b % 2 else f"z{b:04}") for a, b in edges]
    sizes, real = [], components._pruned
    monkeypatch.setattr(components, "_pruned", lambda df, rows: sizes.append(rows) or real(df, rows))
    monkeypatch.setattr(components, "PLAIN", 20)
    for rows, kind in ((edges, "long"), (named, "string")):
        sizes.clear()
        found = components.connected_components(spark.createDataFrame(rows, f"a {kind}, b {kind}"), 0).collect()
        assert len(found) == len({x.node for x in found}) and {x.node: x.root for x in found} == _least(rows)
        assert len(sizes) > 1 and all(y <= x / 2 for x, y in zip(sizes, sizes[1:]))


def test_concepts_copy_nothing_without_hot_keys(spark, monkeypatch):
    plans = []
    for module in (components, concepts):
        monkeypatch.setattr(module, "cut", lambda df, real=module.cut: plans.append(df._jdf.queryExecution().analyzed().toString()) or real(df))
    batch = spark.createDataFrame([(k, "", f"n{k % 3}", f"m{k % 4}") for k in range(8)], "pos long, raw_id string, name string, name_th string")
    assigned, _, _ = concepts.consolidate_concepts(batch, *concepts.empty_store(spark), key=lambda c: c)
    # n0..n2 and m0..m3 are linked by positions 0, 3, 4 and on; each looks for its name first
    assert {x.pos: x.canonical for x in assigned.collect()} == {0: 1, 1: 2, 2: 3, 3: 1, 4: 2, 5: 3, 6: 1, 7: 2}
    assert plans and not any("_salt" in p for p in plans)
