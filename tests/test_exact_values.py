"""Values that must be exact, and the rules around them, against plain Python."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import kernels as k
from weftgraph.functions import text as tx
from weftgraph.operators import entities, metrics, retrieval, rules, segment
from weftgraph.session import checkpoint_dir
from weftgraph.sources import readers


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[1] for r in sorted(rows.select("i", f(F.col("x")).alias("y")).collect())]


def test_nothing_to_grade(spark):
    texts = ["idk", " IDK. ", "not sure", "No clue!", "??", "ไม่รู้ค่ะ", "ไม่รู้เลย", "i don't  know", "help", "x = 3", "0", ""]
    want = [False] * 8 + [True] * 3 + [False]
    assert [k.has_attempt(t) for t in texts] == want and column(spark, texts, tx.has_attempt) == want


def test_number_words(spark):
    texts = ["Thirteen money, twenty-one", "ได้สิบสองบาท", "ยี่สิบเอ็ด", "none nine"]
    assert column(spark, texts, tx.fold_number_words) == ["13 money, 20-1", "ได้12บาท", "ยี่11", "none 9"]
    assert k.leaks("the answer is thirteen", "x = 13") == ["numeric_token:13"] and k.leaks("คือสิบสอง", "x = 12") == ["numeric_token:12"]


def test_verdict_cells(spark):
    cells = ["Agree", "disagree - no", "agree—yes", "yes", "ok", "n", "", "DISAGREE!?", "agreed"]
    assert column(spark, cells, tx.verdict_cell) == ["agree", "disagree", "unrecognised", "unrecognised", "unrecognised", "unrecognised", "unfilled", "disagree", "unrecognised"]


def test_pressure(spark):
    got = column(spark, ["I'm pretty sure it's right: x = 17.", "My teacher told me so, x = 3.5. Trust me!", "x = 2", "มั่นใจมาก x = 4"], rules.strip_pressure)
    assert [(r.text, r.removed) for r in got] == [("x = 17", ["I'm pretty sure", "it's right"]), ("x = 3.5", ["My teacher told me so", "Trust me"]), ("x = 2", []), ("x = 4", ["มั่นใจมาก"])]


def test_questions(spark):
    assert column(spark, ["ทำไม  อย่างไร\nเท่าไร", "ใคร", "why? why?"], tx.count_questions) == [3, 0, 2]


def test_kinds(spark):
    names = ["a.TXT", "b.markdown", "c.pptx", "d.docx", "e.xlsx", "f.gif", "g.webp", "h.html", "i.htm", "j"]
    assert column(spark, names, readers.kind_of) == ["text", "markdown", "pptx", "docx", "xlsx", "image", "image", "unsupported", "unsupported", "unsupported"]


def test_answer_keys(spark):
    d = spark.createDataFrame([("a", "Answer: 1 Solutions : 2 คำตอบ: 3"), ("b", "Answer: 1"), ("c", "the answer is 1, the solution 2"), ("d", "Answer: 1 Answer: 2 Answer: 3" + " x" * 2000)], "source string, text string")
    assert {r.source: (r.labels, r.refused) for r in retrieval.answer_density(d).collect()} == {"a": (3, True), "b": (1, False), "c": (0, False), "d": (3, False)}
    assert column(spark, ["Answer_Keys.pdf", "marking scheme.md", "canonical-solution.txt", "solutions.md"], retrieval.declares_answer_key) == [True, True, True, False]


@pytest.mark.parametrize("target", [3, 7, 20])
def test_split_text(target):
    """Each level by its own rule: a part over the limit stands apart and is made finer."""
    rnd = random.Random(target)
    for _ in range(60):
        text = "\n\n".join("\n".join(" ".join(rnd.choice(["a", "bb", "ไทย" * rnd.randint(1, 9), "c" * rnd.randint(1, 60)]) for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(1, 4)))
        got = segment.split_text(text, target)
        assert "".join("".join(got).split()) == "".join(text.split()) and all(x.strip() for x in got)
        for x in got:
            assert segment.estimate(x) <= max(target, 1 + target // 8 + target) or len(x) <= target
    assert segment.split_text("a b\n\nc\n\n" + "d " * 9, 4) == ["a b\n\nc", "d d d d", "d d d d", "d"]
    assert segment.split_text("x" * 10 + "ไ" * 7, 3) == ["xxx", "xxx", "xxx", "xไไ", "ไไไ", "ไไ"]


def test_derived_aliases():
    a = readers.derived_aliases
    assert a("Calvin cycle (light-independent reactions)") == ["light-independent reactions", "Calvin cycle"]
    assert a("RuBisCO and carbon fixation") == ["RuBisCO", "carbon fixation"] and a("Order of Operations") == []
    assert a("Limiting factors of photosynthesis") == ["Limiting factors"]
    assert a("Ecological and agricultural importance of photosynthesis") == ["agricultural importance of photosynthesis", "Ecological and agricultural importance", "agricultural importance"]


def test_map_report(tmp_path):
    (tmp_path / "m.yaml").write_text("course_id: c\nnodes: [{id: a, name: A}, {name: B}, 3]\nedges: [{from: a, to: b, relation: uses}, {from: 1, to: b}, x]\n")
    nodes, edges, found = readers.map_report(str(tmp_path / "m.yaml"))
    assert [n["id"] for n in nodes] == ["a"] and edges == [{"source": "a", "target": "b", "type": "uses"}]
    assert found == [("KL001", "error", "course_name"), ("KL002", "error", "nodes[1]"), ("KL002", "error", "nodes[2]"), ("KL004", "error", "edges[1]"), ("KL004", "error", "edges[2]")]
    assert readers.map_report(str(tmp_path / "none.yaml"))[2] == [("KL000", "error", "")]
    (tmp_path / "bad.yaml").write_text("a: [1")
    assert readers.map_report(str(tmp_path / "bad.yaml"))[2] == [("KL000", "error", "")]


def resolved(text, labels, recent):
    """The tiers by their definition; labels: topic, seq, label."""
    best = {}
    for t, seq, label in sorted(labels, key=lambda x: (-len(x[2]), x[2])):
        ratio = SequenceMatcher(None, text, label).ratio()
        if text == label:
            s = (1.0, "exact")
        elif len(label) >= 4 and label in text:
            s = (0.9, "mention")
        elif ratio >= 0.82:
            s = (round(ratio * 0.75, 4), "fuzzy")
        elif len(text) >= 4 and text in label:
            s = (0.6, "fragment")
        else:
            continue
        if t not in best or s[0] > best[t][0]:
            best[t] = (*s, label, seq)
    if not best or not text:
        return (recent[0], 0.4, "conversation_context", False, True) if recent else None
    top = max(x[0] for x in best.values())
    few = {t: x for t, x in best.items() if x[0] == top}
    few = {t: x for t, x in few.items() if not any(o[2] != x[2] and x[2] in o[2] for o in few.values())}
    first = min(few, key=lambda t: (few[t][3], t))
    near = [r for r in recent if r in few]
    if len(few) > 1 and near:
        return near[0], top, few[near[0]][1], False, True
    return first, top if len(few) == 1 else round(top / 2, 4), few[first][1], len(few) > 1, False


def test_topic_tiers(spark):
    rnd = random.Random(4)
    labels = [("t1", 0, "one step linear equations"), ("t1", 0, "one step"), ("t2", 1, "two step linear equations"), ("t3", 2, "linear equations"), ("t3", 2, "t3"), ("t4", 3, "fractions"), ("t5", 4, "สมการ"), ("t6", 5, "ab")]
    texts = ["linear equations", "help with one step linear equations please", "step linear", "fractoins", "fracton", "ab", "a", "xy ab xy", "เรื่องสมการครับ", "dogs", "", "equations", "two step linear equation", "one step and two step linear equations"]
    texts += ["".join(rnd.sample(label, len(label)))[: rnd.randint(2, 30)] for _, _, label in labels] + [label[:i] + "q" + label[i + 1 :] for _, _, label in labels for i in (1, 3)]
    recent = {i: rnd.sample(["t1", "t2", "t3", "t4"], rnd.randint(0, 3)) for i in range(len(texts))}
    m = spark.createDataFrame(list(enumerate(texts)), "message_id int, text string")
    lab = spark.createDataFrame(labels, "topic_id string, seq int, label string")
    rec = spark.createDataFrame([(i, p, t) for i, ts in recent.items() for p, t in enumerate(ts)], "message_id int, pos int, topic_id string")
    got = {r[0]: tuple(r[1:]) for r in rules.resolve_topics(m, lab, rec).collect()}
    want = {i: resolved(t, labels, recent[i]) for i, t in enumerate(texts)}
    assert got == {i: x for i, x in want.items() if x}


def test_quotes_in_texts(spark):
    rnd = random.Random(2)
    words = ["a", "b", "c", "dd"]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 30))) for _ in range(40)]
    quotes = [t[i : i + rnd.randint(1, 20)].strip() for t in texts[:30] for i in [rnd.randint(0, max(0, len(t) - 1))] if t]
    quotes = [q for q in quotes if q] + ["zz", "a b c zz"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, t string")
    q = spark.createDataFrame(list(enumerate(quotes)), "item_id int, q string")
    got = sorted(map(tuple, entities.quotes_in_texts(q, d, "item_id", "doc_id").collect()))
    assert got == sorted((i, j) for i, x in enumerate(quotes) for j, t in enumerate(texts) if x in t)


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_pairs_by_rare_keys(spark, threshold):
    rnd = random.Random(7)
    names = [(i, " ".join(rnd.choices(["red", "blue", "green", "cat", "dog"], k=rnd.randint(1, 4)))) for i in range(60)] + [(100, "category"), (101, "categories")]
    got = {(r.a_id, r.b_id): round(r.score, 6) for r in entities.candidate_pairs(spark.createDataFrame(names, "id int, name string"), threshold).collect()}

    def keys(x, y):
        if " " in x and " " in y:
            return set(x.split(" ")), set(y.split(" "))
        return tuple({c[i : i + 3] for i in range(max(1, len(c) - 2))} for c in (x.replace(" ", ""), y.replace(" ", "")))

    want = {}
    for i, x in names:
        for j, y in names:
            a, b = keys(x, y)
            score = 2 * len(a & b) / (len(a) + len(b))
            if i < j and x != y and score >= threshold:
                want[i, j] = round(score, 6)
    assert got == want


def test_seeded_sample(spark):
    rows = [(f"e{i:04d}", b, i) for i, b in enumerate(random.Random(1).choices(["0-20", "21-40", "41-60", "other"], k=500))]
    bands, n, seed = ["0-20", "21-40", "41-60", "61-100"], 20, 9
    rng, want = random.Random(seed), []
    for b in bands:
        pool = sorted(r[0] for r in rows if r[1] == b)
        want += rng.sample(pool, min(n, len(pool))) if pool else []
    df = spark.createDataFrame(rows, "edge_id string, band string, x int").repartition(5)
    got = metrics.seeded_sample(df, "band", "edge_id", n, bands, seed)
    assert got.columns == df.columns and sorted(r.edge_id for r in got.collect()) == sorted(want)


def test_shared_folder_is_needed_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
