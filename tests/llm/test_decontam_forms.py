"""Copies of benchmark items whose name slots depend on the text around them."""

from weftgraph.llm import template_decontam

ITEMS = [(1, "Which rivers cross the old town?"), (2, "Name the capital"), (3, "Please ask Maria whether Peter lives near Berlin or Madrid today."), (4, "12 34 56 78 90")]


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {r.doc_id: [(x["item_id"], x["kind"]) for x in r["items"]] for r in template_decontam.matches(docs, bench).collect()}


def test_copies_inside_sentences_and_in_other_case(spark):
    got = found(spark, [
        "then they asked Which rivers cross the old town? and left",
        "and so Name the capital was the task",
        "we heard please ask maria whether peter lives near berlin or madrid today. indeed",
        "Please ask Anna whether Paul lives near Berlin or Madrid today.",
        "so they said Seven rivers cross the old town and we left",
        "12 34 56 78 90",
    ])
    assert got == {0: [(1, "verbatim")], 1: [(2, "verbatim")], 2: [(3, "verbatim")], 3: [(3, "reparameterised")], 4: [], 5: []}
