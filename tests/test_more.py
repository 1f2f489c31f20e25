from pyspark.sql import functions as F

from weftgraph.operators import entities, graph, metrics, rules, segment
from weftgraph.sources import readers, sinks

KINDS = {"ask": "question", "solve": "solution"}


def test_graph_views(spark):
    nodes = spark.createDataFrame([(1, "Beta", []), (2, "Alpha", ["First"]), (3, "Gamma", [])], "id int, title string, aliases array<string>")
    edges = spark.createDataFrame([(1, 2, "related_to", 40, 1), (3, 1, "related_to", 90, 2), (1, 9, "related_to", 5, 3)], "source int, target int, type string, relevance int, seq int")
    assert [(r.id, r.direction) for r in graph.relations_of(edges, nodes, 1).collect()] == [(3, "in"), (2, "out")]
    assert [(r.source, r.target) for r in graph.dangling(edges, nodes).collect()] == [(1, 9)]
    assert {r.id for r in graph.view(nodes, edges, "first").collect()} == {2, 1} and {r.id for r in graph.view(nodes, edges, least=50, hide_isolated=True).collect()} == {1, 3}
    assert graph.describe(edges, nodes).count() == 2


def test_entity_helpers(spark):
    nodes = spark.createDataFrame([("n1", "linear equation", 1), ("n2", "equation", 2)], "id string, title string, pos int")
    q = spark.createDataFrame([(1, "Linear Equation"), (2, "n2"), (3, "a linear equation please"), (4, "linaer equatoin"), (5, "zzz")], "query_id int, topic string")
    assert {r.query_id: (r.id, r.tier) for r in entities.start_nodes(q, nodes).collect()} == {1: ("n1", 0), 2: ("n2", 1), 3: ("n2", 2), 4: ("n1", 3)}
    d = spark.createDataFrame([("d", ["C1", "C2"])], "id string, chunk_ids array<string>")
    assert entities.members(spark.createDataFrame([("C1",)], "cid string"), d).count() == 1
    kept, rest = entities.first_n(spark.range(5).withColumn("g", F.lit(1)), "g", "id", 3)
    assert (kept.count(), rest.count()) == (3, 2) and entities.roster(spark.range(5), "id", 2).first().truncated
    legs = spark.createDataFrame([("a", "ok", "c", "m", 3), ("b", "failed", "c", "n", 0)], "leg string, status string, corpus string, model string, n_nodes int")
    assert {r.reason for r in entities.stability_problems(legs).collect()} == {"a leg did not finish", "different models", "a leg has no nodes"}
    assert segment.group_paragraphs([(1, 20), (22, 50), (52, 70)]) == [(1, 50), (52, 70)]


def test_rule_helpers(spark):
    one = spark.range(1)
    r = one.select(rules.coverage(F.array(F.lit("1")), F.lit("x")), rules.coverage(F.array().cast("array<string>"), F.lit("x")), rules.reconcile(F.lit("correct"), F.lit("incorrect")), rules.strip_pressure(F.lit("Trust me, x = 3"))).first()
    assert len(r[0]) == 4 and len(r[1]) == 2 and r[2].overruled and r[2].decided_by == "checker" and r[3].text == "x = 3" and r[3].removed == ["Trust me"]
    plans = spark.createDataFrame([(1, ["ask", "solve"], False, 10), (2, ["ask", "ask"], True, 10), (3, ["text"], True, 10)], "turn_id int, blocks array<string>, solution boolean, max_words int")
    assert {(x.turn_id, x.problem) for x in rules.plan_problems(plans, KINDS).collect()} == {(1, "solution withheld but planned"), (2, "more than one question")}
    assert [x[0] for x in plans.orderBy("turn_id").select(rules.may_state_solution(F.col("blocks"), KINDS, F.col("solution"))).collect()] == [False, False, False]
    t = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("s", 3, "a")], "session_id string, turn int, topic string")
    assert [x.recent_topics for x in rules.recent_topics(t).orderBy("turn").collect()] == [[], ["a"], ["b", "a"]]
    v = spark.createDataFrame([("c", "seed", 0), ("c", "draft", 2), ("d", "live", 0)], "course_id string, kind string, errors int")
    assert {x.course_id: (x.kind, x.approvable) for x in rules.live_map(v).collect()} == {"c": ("draft", False), "d": ("live", False)}
    e = spark.createDataFrame([(1, "a" * 30, ["s1"], None), (2, "", [], "boom")], "turn_id int, text string, steps array<string>, error string")
    assert [(x.turn_id, x.event) for x in rules.turn_events(e).orderBy("turn_id", "event_seq").collect()] == [(1, "trace"), (1, "token"), (1, "token"), (1, "done"), (2, "error")]


def test_metric_helpers(spark):
    b = spark.createDataFrame([(0, 3), (3, 6), (8, 9)], "low int, high int")
    assert [x.problem for x in metrics.band_gaps(b).orderBy("low").collect()] == ["overlap", "gap"]
    r = spark.sql("select timestamp'2024-01-02 03:04:05' a, timestamp'2024-01-02 03:04:06.5' b").select(metrics.run_id(F.col("a")), metrics.elapsed_ms(F.col("a"), F.col("b")), metrics.mapped_percent(F.lit(50), 10, 35)).first()
    assert tuple(r) == ("2024-01-02T03-04-05Z", 1500, 22)
    e = spark.createDataFrame([("f", "parse", 90, 1), ("f", "parse", 40, 2), ("g", "parse", 5, 3)], "file_id string, stage string, percent int, seq int")
    assert [(x.file_id, x.stages) for x in metrics.folded_progress(e).collect()] == [("g", {"parse": 5}), ("f", {"parse": 40})]


def test_sink_helpers(spark, tmp_path):
    sinks.write_map(str(tmp_path / "m.yaml"), [{"id": "a"}], [{"source": "a", "target": "b", "type": "uses"}])
    assert readers.map_file(str(tmp_path / "m.yaml")) == ([{"id": "a"}], [{"source": "a", "target": "b", "type": "uses"}])
    assert sinks.deep_replace({"a": ["xay"]}, {"a": "b"}) == {"a": ["xby"]} and sinks.safe_name("a.b") and not sinks.safe_name("../a") and sinks.reason_line("a\n\x00b") == "a b"
    n = spark.createDataFrame([("a", "A", "d"), ("b", "B", "")], "id string, title string, definition string")
    assert sinks.rag_rows(n, "c").count() == 1
