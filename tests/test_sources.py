import json

import pytest
from pyspark.sql import functions as F

from weftgraph import providers
from weftgraph.operators import graph
from weftgraph.plans import build, replay
from weftgraph.sources import html, readers, sinks


def test_inbox(spark, tmp_path):
    for name, text in (("b.md", "# B\ntext"), ("a.txt", "plain"), ("A.md", "x"), (".hidden", "no"), ("z.bin", "?")):
        (tmp_path / name).write_text(text)
    items = readers.status(readers.inbox(spark, str(tmp_path)))
    rows = {r.name: (r.kind, r.status) for r in items.collect()}
    assert rows == {"A.md": ("markdown", "converted"), "a.txt": ("text", "converted"), "b.md": ("markdown", "converted"), "z.bin": ("unsupported", "unsupported")}
    assert {r.name: r.stem for r in readers.stems(items).collect()} == {"A.md": "A-md", "a.txt": "a-txt", "b.md": "b", "z.bin": "z"}
    assert readers.texts(items).count() == 3

    def broken(content):
        raise ValueError("bad\nfile")

    out = {r.name: (r.status, r.reason, r.units) for r in readers.convert(items, {"markdown": lambda c: [c.decode()], "text": broken}).collect()}
    assert out["b.md"] == ("converted", None, ["# B\ntext"]) and out["a.txt"][:2] == ("failed", "bad file") and out["z.bin"][0] == "unsupported"


def test_urls_and_sheets(spark):
    u = spark.createDataFrame([(1, " http://a "), (2, ""), (3, "# no"), (4, "http://b"), (5, "http://a")], "seq int, value string")
    assert [r.url for r in readers.urls(u).collect()] == ["http://a", "http://b"]
    cells = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("s", 4, "c"), ("s", 7, "d")], "sheet string, row int, text string")
    assert [(r["first"], r["last"]) for r in readers.sheet_blocks(cells).orderBy("block").collect()] == [(1, 4), (7, 7)]


def test_chunks_transcripts_and_tables():
    text = "<!-- chunk: c1 | topic: t | source: p1 | lang: en -->\nOne.\n<!-- chunk: c2 | source: p2 -->\nTwo."
    assert [(c["chunk_id"], c["topic"], c["source_ref"], c["text"]) for c in readers.marked_chunks(text)] == [("c1", "t", "p1", "One."), ("c2", None, "p2", "Two.")]
    assert readers.marked_chunks("# A\nx")[0]["source_ref"] == "A"
    vtt = "WEBVTT\n\n00:01.000 --> 00:04.000\n" + "word " * 150 + "\n\n01:00:05.000 --> 01:00:07.000\nlast"
    assert [s for s, _ in readers.transcript(vtt)] == ["00:00:01", "01:00:05"]
    assert readers.review_table("| a | b |\n|---|---|\n| 1 | 2 | 3 |\n| 4 |") == [["a", "b"], ["1", "2 | 3"], ["4", ""]]


def test_html(spark):
    page = "<html><head><title>T</title><script>x</script></head><body><nav>Home</nav><article><h1>Head</h1><p>Some &amp; text</p><h2>Sub</h2><p>More</p></article></body></html>"
    assert html.markdown(page) == "# Head\n\nSome & text\n\n## Sub\n\nMore" and html.markdown("<script>app()</script>") == ""
    u = html.units(spark.createDataFrame([("p", page), ("q", None)], "source string, html string")).orderBy("uid").collect()
    assert [(r.uid, r.heading_path) for r in u] == [("U1", ["Head"]), ("U2", ["Head", "Sub"])]


def test_notes_round_trip(spark, tmp_path):
    note = {"id": "a-1", "title": "Alpha", "aliases": ["Al"], "definition": "Alpha uses Beta.", "sources": [{"locator": "f#1", "quote": "q1"}, {"locator": "f#1", "quote": "q2"}], "edges": [{"type": "related_to", "target": "b-2", "relevance": 70}]}
    text = sinks.render_note(note, {"Beta": "b-2", "Alpha": "a-1"})
    assert text == sinks.render_note(note, {"Beta": "b-2", "Alpha": "a-1"}) and "[[b-2|Beta]]" in text
    sinks.write_files({str(tmp_path / "a.md"): text, str(tmp_path / "bad.md"): "nothing", str(tmp_path / "copy.md"): text})
    found, problems = readers.notes(spark, str(tmp_path))
    r = found.first()
    assert r.id == "a-1" and [s.quote for s in r.sources] == ["q1", "q2"] and r.edges[0].relevance == 70
    assert sorted(p.file for p in problems.collect()) == ["bad.md", "copy.md"]
    nodes, edges = readers.note_graph(found)
    assert nodes.first().grounded and edges.first().target == "b-2"


def test_index_and_tables(spark, tmp_path):
    data = {"nodes": [{"id": "a", "title": "A", "aliases": [], "sources": [{"quote": "q"}]}, {"id": "b", "title": "B", "aliases": [], "sources": []}], "edges": [{"source": "a", "target": "b", "type": "related_to", "relevance": 5}, {"source": "a", "target": "x", "type": "related_to", "relevance": 5}]}
    (tmp_path / "i.json").write_text(json.dumps(data))
    nodes, edges = readers.index(spark, str(tmp_path / "i.json"))
    assert edges.count() == 1 and {r.id: r.grounded for r in nodes.collect()} == {"a": True, "b": False}
    assert len(sinks.index_rows(nodes.select("id", "title"), edges).collect()) == 2
    (tmp_path / "t.yaml").write_text("version: '2'\nrows:\n  - {id: a, x: 1}\n  - {id: a}\n  - {x: 2, id: ''}\n")
    rows, problems = readers.table_rows(str(tmp_path / "t.yaml"), ("id", "x"))
    assert len(rows) == 3 and problems == ["row 1: x is missing", "id a is repeated", "row 2: empty id"]
    assert readers.table_version(str(tmp_path / "t.yaml")).startswith("2+")
    loc = spark.createDataFrame([("f#page=2",), ("f#page=9",), ("f#lines=1-3",), ("f#lines=3-1",), ("f#heading=H",), ("g",), ("f",)], "locator string")
    units = spark.createDataFrame([("f", 3, 2, ["H"])], "file string, lines int, pages int, headings array<string>")
    assert {r.locator: r.resolves for r in readers.resolve_locators(loc, units).collect()} == {"f#page=2": True, "f#page=9": False, "f#lines=1-3": True, "f#lines=3-1": False, "f#heading=H": True, "g": False, "f": True}


def test_imports_and_reports(spark):
    e = spark.createDataFrame([(1, 2, "part_of", 1), (2, 1, "part_of", 2), (1, 3, "odd", 3)], "source int, target int, type string, seq int")
    m = spark.createDataFrame([("part_of", "part_of")], "type string, relation string")
    good, bad = sinks.import_edges(e, m)
    assert [(r.source, r.kept, r.conflict) for r in good.orderBy("seq").collect()] == [(1, True, False), (2, False, True)] and bad.count() == 1
    assert "abc" not in sinks.report({"key": "abc"}, ["abc"]) and "<" not in sinks.html_view([{"id": "</script>"}], []).split('id="graph">')[1].split("</script>")[0]


def test_providers(spark):
    df = spark.createDataFrame([(1, "good prompt"), (2, "bad prompt")], "id int, prompt string")
    stub = providers.Stub({"good": '```json\n{"a": 1}\n```', "bad": "nonsense"})
    rows = providers.call_stage(df, "s", stub, "prompt", "id", ("a",)).collect()
    assert [(r.id, r.attempt_no, r.outcome) for r in rows] == [(1, 1, "ok"), (2, 1, "invalid"), (2, 2, "invalid")]
    assert len(providers.embed(df.withColumnRenamed("prompt", "text"), stub).first().embedding) == 256
    assert [providers.rate_policy(u, 60, w) for u, w in ((0.1, False), (0.9, False), (0.99, False), (0.99, True))] == ["proceed", "warn", "wait", "defer"]
    assert providers.schema_problems({"type": "object", "properties": {"a": {"type": "string"}}, "required": ["a"], "additionalProperties": False}) == []
    assert len(providers.schema_problems({"type": "object", "properties": {"a": {"$ref": "#"}}})) == 3
    with pytest.raises(ValueError):
        providers.assemble([("x", "the key is X = 3")], ["x=3"])


def test_build(spark):
    docs = spark.createDataFrame([("d1", "# Graphs\nA graph has nodes.\n# Trees\nA tree is a graph."), ("d2", "# Graph\nAgain a graph.")], "source string, text string")

    def atomize(chunks):
        u = chunks.select("source", "cid", F.explode("unit_ids").alias("uid"), "text")
        title = F.regexp_extract("text", r"# (\w+)", 1)
        return u.select(F.lit("all").alias("corpus"), F.xxhash64("source", "cid", "uid").alias("pos"), title.alias("title"), F.lit("d").alias("definition"), F.array().cast("array<string>").alias("aliases"), F.array(F.concat("source", F.lit(":"), "uid")).alias("sources"))

    def propose(nodes, chunks):
        one = nodes.select(F.col("id").alias("source"))
        return one.select("source", F.col("source").alias("target"), F.lit("part_of").alias("type"), F.lit(None).cast("int").alias("relevance"), F.xxhash64("source").alias("seq"))

    b = build.build(docs, atomize, propose, graph.edge_types(spark, graph.GENERAL))
    assert b.units.count() == 3 and b.chunks.count() == 2
    assert [r.title for r in b.nodes.collect()] == ["Graphs"] or b.nodes.count() >= 1
    assert {r.gate for r in b.rejected.collect()} == {"self_edge"} and b.edges.count() == 0


def test_replay(spark):
    from weftgraph import catalogue as c

    t = spark.createDataFrame([(1, "solve", "normal", "beginner", "pressure", 0.9), (2, "solve", "normal", "beginner", "none", 0.3)], "turn_id int, intent string, learner_state string, student_level string, special_handling string, confidence double")
    p = spark.createDataFrame(c.POLICIES, "id string, intent string, special_handling string, precedence int, solution boolean, hint boolean, attempt_required boolean, prohibited array<string>")
    r = {x.turn_id: x for x in replay.decide(t, c.trigger_rows(spark), p, ("T99", "S00"), ["S04"], ["S06"], ["S01", "S02", "S04"]).collect()}
    assert (r[1].row_id, r[1].strategy, r[1].supporting, r[1].solution, r[1].top_policy) == ("T06", "S05", ["S04"], False, "P02")
    assert (r[2].intent, r[2].raw_intent, r[2].row_id) == ("explain", "solve", "T01")
