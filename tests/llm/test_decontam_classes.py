"""Items of one template as one class: against a plain matcher, and how the work grows."""

import random
import re
import time

import pyarrow as pa
from weftgraph.llm import template_decontam as td


def slots(text):
    """Words as (code, value): numbers, units after them, capitalised words inside a sentence."""
    out, opens, unit = [], True, False
    for raw in text.split():
        word = re.sub("[^0-9A-Za-z]", "", raw)
        if word:
            code = word.lower()
            if unit and code in td.UNITS:
                code = "<unit>"
            elif word[0].isdigit():
                code = "<number>"
            elif word[0].isupper() and not opens:
                code = "<name>"
            unit = word[0].isdigit()
            out.append((code, word.lower()))
        opens = raw[-1] in ".!?:"
    return out


def holds(item, text, own):
    """Whether enough windows of ``item`` stand in ``text``, slots agreeing along alignments; ``own``: with its own values."""
    n = min(5, len(item))
    windows = {p: tuple(c for c, _ in item[p : p + n]) for p in range(len(item) - n + 1)}
    windows = {p: w for p, w in windows.items() if not all(c.startswith("<") for c in w)}
    seen = set()
    for start in range(-len(item), len(text)):
        bound, good = {}, set()
        for p, w in windows.items():
            part = text[start + p : start + p + n] if start + p >= 0 else []
            if tuple(c for c, _ in part) != w:
                continue
            new = dict(bound)
            if all(new.setdefault(i, t[1]) == t[1] for i, t in zip(item[p : p + n], part) if i[0].startswith("<")):
                bound = new
                good.add(w)
        if not own or all(i[1] == v for i, v in bound.items()):
            seen |= good
    return bool(windows) and len(seen) / len(set(windows.values())) >= 0.8


def holds_words(item, text):
    n = min(5, len(item))
    cut = lambda s: {tuple(w for _, w in s[p : p + n]) for p in range(len(s) - n + 1)}
    want = {tuple(w for _, w in x) for x in (item[p : p + n] for p in range(len(item) - n + 1)) if not all(c.startswith("<") for c, _ in x)}
    return bool(want) and len(want & cut(text)) / len(want) >= 0.8


def family(rnd):
    a, b = rnd.choice(["Ann", "Bob", "Eve"]), rnd.choice(["Ann", "Bob", "Eve"])
    n, m = rnd.randint(1, 4), rnd.randint(1, 4)
    return f"We know that {a} has {n} red apples and that {b} has {m} green pears so how many fruits do {a} and {b} have?"


def test_families_against_a_plain_matcher(spark):
    rnd = random.Random(5)
    items = [(k, family(rnd)) for k in range(60)] + [(60, "one two three four five six seven"), (61, "They paid 30 dollars for it")]
    texts = []
    for _ in range(50):
        t = family(rnd).split()
        if rnd.random() < 0.4:
            t[rnd.randrange(1, len(t))] = rnd.choice(["Ann", "7", "odd"])
        if rnd.random() < 0.3:
            t = t[: rnd.randint(12, len(t))]
        texts.append(" ".join(["some words before."] * rnd.randint(0, 2) + t + ["after it"] * rnd.randint(0, 1)))
    texts += ["They paid 45 euros for it", items[60][1], " ".join(x for _, x in items[:3])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    of = {r.item_id: r.class_id for r in td.item_classes(bench).collect()}
    coded = {i: slots(q) for i, q in items}
    for r in td.matches(docs, bench).collect():
        t = slots(texts[r.doc_id])
        found = {i for i in coded if holds(coded[i], t, False)}
        same = {i for i in found if holds(coded[i], t, True)}
        want = set()
        for c in {of[i] for i in found}:
            mine = {i for i in same if of[i] == c}
            want.add((c, min(mine), len(mine), "verbatim") if mine else (c, c, sum(x == c for x in of.values()), "reparameterised"))
        # in other form: the plain words of an item whose template is not there
        plain = {}
        for i in coded:
            if of[i] not in {of[j] for j in found} and holds_words(coded[i], t):
                plain.setdefault((of[i], tuple(coded[i])), []).append(i)
        want |= {(c, min(m), len(m), "verbatim") for (c, _), m in plain.items()}
        assert {(x["class_id"], x["item_id"], x["n_items"], x["kind"]) for x in r["items"]} == want, texts[r.doc_id]
    assert len(set(of.values())) < 10


def test_a_template_is_met_once_whatever_its_items():
    def made(k):
        return f"A shop sells {k} apples for {k + 7} dollars each day so how much does it take in {k % 50} days?"

    texts = pa.array(["filler words here. " + made(10_000 + k) for k in range(10_000)])
    bench = td.Benchmark(list(range(1000)), [0] * 1000, pa.array([made(k) for k in range(1000)]))
    began = time.time()
    got = td._judge(bench, texts)
    assert time.time() - began < 10
    # 50 items say their first number again: another class, whose other windows are enough
    assert all(sorted(y["n_items"] for y in x) == [50, 950] and {y["kind"] for y in x} == {"reparameterised"} for x in got)
