from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import entities, gates, graph, metrics, reasoner, retrieval, rules, segment


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


EDGE = "source int, target int, type string, relevance int, seq int"
#: prerequisite and part_of edges of a small course
COURSE = [(1, 2, "prerequisite_of", None), (2, 3, "prerequisite_of", None), (3, 4, "part_of", None), (5, 3, "example_of", None), (3, 6, "prerequisite_of", None), (7, 3, "refines", None), (8, 4, "part_of", None)]
TOPICS = [(1, 2, "related_to", 90), (1, 3, "related_to", 70), (1, 4, "related_to", 75), (1, 5, "related_to", 85), (1, 6, "related_to", 80), (1, 8, "part_of", None), (9, 8, "part_of", None), (9, 10, "related_to", 20)]


@pytest.fixture
def course(spark):
    nodes = frame(spark, [(k, f"topic {k}", [] if k != 3 else ["topics three"], k != 6, k) for k in range(1, 9)], "id int, title string, aliases array<string>, grounded boolean, pos int")
    return nodes, frame(spark, [(*e, k) for k, e in enumerate(COURSE)], EDGE)


@pytest.fixture
def topics(spark):
    nodes = frame(spark, [(k, f"topic {k}", [], k not in (3, 4), k) for k in range(1, 11) if k != 7], "id int, title string, aliases array<string>, grounded boolean, pos int")
    return nodes, frame(spark, [(*e, k) for k, e in enumerate(TOPICS)], EDGE)


def test_bfs(spark, course):
    nodes, edges = course
    nbrs = graph.neighbours(edges, graph.edge_types(spark))
    start = frame(spark, [(3,)], "start int")
    r = {x.node: (x.distance, x.direction) for x in graph.bfs(start, nbrs, ["prerequisite_of"], 2).collect()}
    assert r == {2: (1, "in"), 6: (1, "out"), 1: (2, "in")}
    assert {x.node for x in graph.bfs(start, nbrs, ["prerequisite_of"], 1).collect()} == {2, 6}
    back = graph.walk(start, edges, "prerequisite_of", "backward", 2).collect()
    assert {(x.node, x.distance) for x in back} == {(2, 1), (1, 2)}
    bundle = graph.neighbourhood(start, edges, "confused", 1).first()
    assert [(p.distance, p.node) for p in bundle.prerequisites] == [(1, 2), (2, 1)] and bundle.related is None


def ask(spark, nodes, edges, types, schema, rows):
    q = frame(spark, rows, "query_id int, anchor int, learner_state string, intent string, student_level string, mastered array<int>, excluded array<int>")
    out = reasoner.guidance(q, nodes, graph.neighbours(edges, types), schema).collect()
    found = {}
    for x in sorted(out, key=lambda x: (x.query_id, x["rank"])):
        found.setdefault(x.query_id, []).append((x.id, x.role))
    return found


def test_guidance_in_a_course(spark, course):
    r = ask(spark, *course, graph.edge_types(spark), "education", [
        (1, 3, "confused", "explain", "intermediate", [], []), (2, 3, "confused", "explain", "advanced", [2], []), (3, 3, "normal", "clarify", "intermediate", [], []),
        (4, 8, "normal", "clarify", "intermediate", [], []), (5, 3, "normal", "practice_quiz", "intermediate", [], []), (6, 3, "normal", "summarize_review", "beginner", [], []),
        (7, 3, "normal", "explain", "advanced", [], []), (8, 1, "confused", "explain", "beginner", [], [2]),
    ])
    assert [i for i, _ in r[1]] == [2, 1] and [i for i, _ in r[2]] == [1]
    assert r[3] == [(7, "alternative_explanation")] and r[4] == [(3, "alternative_explanation")] and r[5][0] == (5, "practice_target")
    assert r[6] == [(6, "next_challenge")] and r[7] == [(4, "supporting_context"), (5, "supporting_context")] and 8 not in r


def test_guidance_in_a_general_graph(spark, topics):
    types = graph.edge_types(spark, graph.GENERAL)
    r = ask(spark, *topics, types, "general", [(1, 1, "confused", "explain", "beginner", [], []), (2, 1, "normal", "clarify", "beginner", [], []), (3, 10, "confused", "explain", "beginner", [], []), (4, 8, "normal", "practice_quiz", "advanced", [], []), (5, 1, "normal", "explain", "advanced", [], [2])])
    assert r[1] == [(8, "prerequisite_gap")] and [i for i, _ in r[2]] == [2, 5] and r[3] == [(9, "prerequisite_gap")]
    assert [i for i, _ in r[4]] == [1, 9] and [i for i, _ in r[5]] == [5, 6, 4, 3]


def test_anchor(spark, course):
    q = frame(spark, [(1, "The Topic 3"), (2, "topic 3 please"), (3, "nothing like it"), (4, "Topics Three")], "query_id int, topic string")
    assert {x.query_id: (x.anchor, x.tier) for x in reasoner.anchor(q, course[0]).collect()} == {1: (3, "exact"), 2: (3, "fuzzy"), 4: (3, "exact")}


def test_degree_and_canonical_edges(spark, topics):
    nodes, edges = topics
    types = graph.edge_types(spark, graph.GENERAL)
    twice = edges.unionByName(frame(spark, [(2, 1, "related_to", 10, 50)], EDGE))
    c = {(x.source, x.target, x.type): x.relevance for x in graph.canonical(twice, types).collect()}
    assert len(c) == 8 and c[1, 2, "related_to"] == 90
    d = {x.id: x.degree for x in graph.with_degree(nodes, twice).collect()}
    assert d[1] == 6 and d[8] == 2
    assert graph.graph_meta(nodes, edges).first().edges_by_type == {"part_of": 2, "related_to": 6}


def test_gates(spark):
    nodes = frame(spark, [(k,) for k in range(1, 5)], "id int")
    rows = [(1, 2, "part_of", None), (2, 3, "part_of", None), (3, 1, "part_of", None), (1, 2, "part_of", None), (1, 1, "part_of", None), (1, 9, "part_of", None), (1, 2, "related_to", None), (1, 2, "related_to", 50), (2, 1, "related_to", 60), (1, 2, "odd", None), (1, 3, "part_of", 5), (3, 1, "part_of", None)]
    types = graph.edge_types(spark, graph.GENERAL)
    r = {x.seq: x.gate for x in gates.gate_edges(frame(spark, [(*e, k) for k, e in enumerate(rows)], EDGE), nodes, types).collect()}
    assert [r[k] for k in range(12)] == [None, None, "dag", "duplicate_edge", "self_edge", "dangling", "relevance", None, "duplicate_edge", "out_of_schema", "relevance", "dag"]
    found = Counter(x.finding for x in gates.validate_graph(frame(spark, [(*e, k) for k, e in enumerate(rows)], EDGE), nodes, types).collect())
    assert found["mirror_unequal"] == 1 and found["dangling"] == 1


def test_map_validation(spark):
    nodes = frame(spark, [(k,) for k in (1, 2, 3, 4, 5, 5, 6)], "id int")
    e = frame(spark, [(1, 2, "prerequisite_of"), (2, 3, "prerequisite_of"), (3, 1, "prerequisite_of"), (1, 4, "odd"), (1, 9, "uses"), (4, 4, "uses"), (4, 5, "related_to"), (5, 4, "related_to"), (1, 2, "prerequisite_of")], "source int, target int, type string")
    codes = Counter(x.code for x in gates.validate_map(nodes, e, graph.RELATIONS).collect())
    assert codes == {"KL003": 1, "KL005": 1, "KL006": 1, "KL007": 1, "KL008": 1, "KL009": 1, "KL100": 1, "KL101": 1}
    cycle = graph.cycles(e.filter("type = 'prerequisite_of'"))
    assert [x.path for x in cycle.collect()] == [[1, 2, 3]]
    assert {tuple(x) for x in graph.cycle_edges(cycle).collect()} == {(1, 2), (2, 3), (3, 1)}


def test_layers_and_back_edges(spark):
    assert graph.back_edges([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], ["a", "b", "c"]) == [("c", "a")]
    nodes = frame(spark, [(k,) for k in range(1, 5)], "id int")
    e = frame(spark, [(1, 2), (2, 3), (1, 3)], "source int, target int")
    assert {x.id: x.layer for x in graph.layers(nodes, e).collect()} == {1: 0, 2: 1, 3: 2, 4: 0}


def test_segmentation(spark):
    d = frame(spark, [("a", "one\ntwo\n\n\nthree\n "), ("b", "")], "source string, text string")
    assert [(x.source, x.par, x["first"], x["last"], x.text) for x in segment.paragraphs(d).orderBy("source", "par").collect()] == [("a", 1, 1, 2, "one\ntwo"), ("a", 2, 5, 5, "three")]
    md = "intro\n# A\ntext\n## B\n```\n# no\n```\n# C\n"
    assert [(s["heading_path"], s["first"]) for s in segment.sections(md)] == [([], 1), (["A"], 2), (["A", "B"], 4), (["C"], 8)]
    chunks = segment.build_chunks([("U1", "a " * 50), ("U2", " "), ("U3", "b " * 60), ("U4", "c " * 10), ("U5", "d " * 300)], 100, 200, 20)
    assert [c[0] for c in chunks] == [["U1"], ["U3", "U4"], ["U5"], ["U5"], ["U5"]] and all(c[2] <= 200 for c in chunks)
    tail = segment.build_chunks([("U1", "a " * 95), ("U2", "b " * 10)], 100, 120, 20)
    assert [c[0] for c in tail] == [["U1", "U2"]]
    runs = segment.language_runs("ก ข Multiplication here x = 2")
    assert [r[0] for r in runs] == ["th", "en"]
    pieces = segment.overlapped([f"word{k} " * 30 for k in range(40)])
    assert all(segment.estimate_b(p) <= 500 for p in pieces) and len(pieces) > 2


def test_entities(spark):
    items = frame(spark, [(1, "graph theory basics"), (2, "graph theory"), (3, "cooking"), (4, "cookings")], "id int, name string")
    pairs = {(x.a_id, x.b_id): round(x.score, 3) for x in entities.candidate_pairs(items, 0.5).collect()}
    assert pairs == {(1, 2): 0.8, (3, 4): round(2 * 5 / 11, 3)}
    c = frame(spark, [("k", 1, "Graphs", "", ["Networks"], ["u1"]), ("k", 2, "Network", "links", [], ["u2"]), ("k", 3, "Books", "t", [], ["u1"]), ("k", 4, "graph", "", ["Book"], ["u3"])], "corpus string, pos int, title string, definition string, aliases array<string>, sources array<string>")
    out = entities.consolidate(c).collect()
    assert [(x.title, x.definition, x.n_merged) for x in out] == [("Graphs", "links", 4)]
    reg = frame(spark, [(1, "Graph", ["Net"], "active", 1), (2, "Tree", ["Graph"], "active", 2), (3, "Old", [], "retired", 3)], "id int, title string, aliases array<string>, status string, pos int")
    drafts = frame(spark, [(10, "graphs", [], 1), (11, "nets", [], 2), (12, "x", ["Net"], 3), (13, "old", [], 4)], "id int, title string, aliases array<string>, pos int")
    assert {x.draft_id: x.id for x in entities.lookup(drafts, reg).collect()} == {10: 1, 11: 1}
    assert [(x.id, x.owner) for x in entities.foreign_aliases(reg).collect()] == [(2, 1)]
    new = entities.allocate(frame(spark, [("Big Data", 1), ("Graph", 2)], "title string, pos int"), 7)
    assert sorted(x.id for x in new.collect()) == ["big-data-0007", "graph-0008"]


def test_rules(spark):
    facts = frame(spark, [(1, "explain", "normal", "beginner", "none"), (2, "hint", "confused", "beginner", "none"), (3, "other", "normal", "advanced", "none")], "turn_id int, intent string, learner_state string, student_level string, special_handling string")
    rows = frame(spark, [("A", "explain", "any", "any", "any", "S1", ["S2"], 10), ("B", "hint", "confused", "any", "any", "S3", [], 10), ("C", "hint", "any", "any", "any", "S4", [], 10), ("D", "hint", "any", "any", "any", "S4", [], 10)], "id string, intent string, learner_state string, student_level string, special_handling string, primary string, supporting array<string>, priority int")
    m = {(x.turn_id, x.row_id): (x["rank"], x.lost_on) for x in rules.trigger_matches(facts, rows).collect()}
    assert m == {(1, "A"): (1, None), (2, "B"): (1, None), (2, "C"): (2, "specificity"), (2, "D"): (3, "specificity")}
    s = {x.turn_id: (x.row_id, x.matched) for x in rules.select_trigger(facts, rows, ("Z", "S0")).collect()}
    assert s[3] == ("Z", False) and s[2] == ("B", True)
    assert [x.ids for x in rules.ambiguous(rows).collect()] == [["C", "D"]]
    plan = frame(spark, [("S6", ["S4", "S2", "S2", "S9", "S1"])], "p string, s array<string>").select(rules.combine(F.col("p"), F.col("s"), ["S4"], ["S6"], F.array(*map(F.lit, ("S1", "S2", "S3")))).alias("c")).first().c
    assert (plan.primary, plan.supporting) == ("S4", ["S2", "S1"]) and {a.rule for a in plan.actions} == {"hint_first_beats_full_answer", "not_allowed"}
    blocks = frame(spark, [(["intro", "ask", "ask2", "solve"],)], "b array<string>").select(rules.plan_blocks(F.col("b"), {"ask": "question", "ask2": "question", "solve": "solution"}, F.lit(False))).first()[0]
    assert blocks == ["intro", "ask"]
    guard = frame(spark, [("x = 3", 0, True), ("x = 3", 1, True), ("x = 3", 0, False), ("hm", 0, True)], "d string, a int, w boolean").select(rules.guard(F.col("d"), F.lit("x = 3"), F.col("a"), F.col("w")))
    assert [r[0] for r in guard.collect()] == ["regenerate", "fallback", "pass", "pass"]


def test_topics_levels_and_items(spark):
    labels = frame(spark, [("t1", 0, "linear equations", "name"), ("t2", 1, "quadratic equations", "name"), ("t1", 0, "lines", "alias")], "topic_id string, seq int, label string, kind string")
    m = frame(spark, [(1, "linear equations"), (2, "help with lines please"), (3, "equations"), (4, "dogs")], "message_id int, text string")
    r = {x.message_id: (x.topic_id, x.confidence, x.ambiguous) for x in rules.resolve_topics(m, labels).collect()}
    assert r == {1: ("t1", 1.0, False), 2: ("t1", 0.9, False), 3: ("t1", 0.3, True)}
    items = frame(spark, [("s", "a", "i1", 1), ("s", "a", "i2", 2)], "session_id string, topic string, item_id string, pos int")
    seen, none = frame(spark, [("s", "i1")], "session_id string, item_id string"), frame(spark, [], "session_id string, item_id string")
    assert rules.pick_item(items, seen, none).first().item_id == "i2" and rules.pick_item(items, seen, frame(spark, [("s", "i2")], "session_id string, item_id string")).first().item_id == "i1"
    probs = frame(spark, [("p1", "2x+4=10", ["2", "4", "10"], 1), ("p2", "x", [], 2)], "problem_id string, folded string, numbers array<string>, pos int")
    msg = frame(spark, [(1, "solve2x+4=10", []), (2, "?", ["2", "7", "4", "10"]), (3, "?", ["10", "4", "2"])], "message_id int, folded string, numbers array<string>")
    assert {x.message_id: x.problem_id for x in rules.problem_for(msg, probs).collect()} == {1: "p1", 2: "p1"}


def test_metrics(spark):
    u = frame(spark, [("a", 1, 1, 2.0, "m", 1), ("a", 2, 3, None, "n", 2), ("b", 1, 5, None, "m", 3)], "stage string, attempt_no int, input_tokens int, cost_usd double, model string, seq int")
    r = {x.stage: (x.calls, x.repairs, x.cost_usd, x.model) for x in metrics.ledger(u).collect()}
    assert r == {"a": (1, 1, 2.0, "n"), "b": (1, 0, None, "m"), None: (2, 1, 2.0, "m")}
    assert [x.n for x in metrics.histogram(frame(spark, [(5,), (-25,), (400,)], "delta int")).orderBy("bucket").collect()] == [1, 1, 0, 0, 1]
    bands = [(0, 3), (4, 6), (7, 10)]
    rows = [("0-3", "agree")] * 2 + [("0-3", "disagree")] * 4 + [("4-6", "agree")] * 4 + [("4-6", "disagree")] * 2 + [("7-10", "agree")] * 6
    assert {x.verdict for x in metrics.band_summary(frame(spark, rows, "band string, verdict string"), bands).collect()} == {"monotonic"}
    assert {x.verdict for x in metrics.band_summary(frame(spark, rows[:8], "band string, verdict string"), bands).collect()} == {"insufficient data"}
    a, b = frame(spark, [("x",), ("y",)], "name string"), frame(spark, [("y",), ("z",)], "name string")
    assert entities.set_agreement(a, b).first().jaccard == 1 / 3 and entities.set_agreement(a.limit(0), b.limit(0)).first().jaccard == 1.0
    out = metrics.running_budget(frame(spark, [(1, 1, 3.0), (1, 2, None), (1, 3, 3.0)], "k int, seq int, cost_usd double"), 5.0, "k", ["seq"]).orderBy("seq").collect()
    assert [x["over"] for x in out] == [False, False, True]


def test_retrieval(spark):
    c = frame(spark, [("a", "en", [1.0, 0.0], ["x"], "r"), ("b", "en", [0.9, 0.1], ["y"], "r"), ("c", "th", [0.0, 1.0], ["x"], "r")], "chunk_id string, lang string, embedding array<double>, features array<string>, source_ref string")
    q = frame(spark, [(1, [1.0, 0.0], ["y"])], "query_id int, query_embedding array<double>, query_features array<string>")
    assert [x.chunk_id for x in retrieval.hybrid_topk(q, c, 2).orderBy("rank").collect()] == ["b", "a"]
    assert retrieval.scan(c, lang="th").count() == 1
    assert retrieval.upsert(c, c.limit(1)).count() == 3
    with pytest.raises(ValueError):
        retrieval.upsert(c, c.withColumn("source_ref", F.lit("")))
