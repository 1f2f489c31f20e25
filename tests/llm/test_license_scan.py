"""The license scan against word lists, and on planted notices."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import license_scan, queries

from . import edge

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}


def base(text):
    """n_words, n_base, first_word, last_word, base_labels of the contract."""
    w = WORD.findall((text or "").translate(LOWER))
    places = [(k, label) for label, p in BASE.items() for k in range(len(w)) if w[k : k + len(p)] == p]
    at = [k for k, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r[1:] for r in sorted(license_scan.summary(license_scan.scan(df)).collect())]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from("cc by CC By, nc general public license License. all rights reserved\n the under mit é ß 2.0 x@y \x85 GENERAL-PUBLIC ccby".split(" "))).map(" ".join)), max_size=5))
def test_base_places(texts):
    import numpy as np
    import pyarrow as pa

    library = license_scan.Library()
    out = license_scan._scan(library, np.linspace(1, 2, len(library.words)), pa.array(texts, pa.string()))
    got = [(x["n_words"], len(x["places"]), min((p["word"] for p in x["places"]), default=None), max((p["word"] for p in x["places"]), default=None), ",".join(sorted({p["label"] for p in x["places"]}))) for x in out]
    assert got == [base(t) for t in texts]


def test_planted_notices(spark):
    fill = edge.prose(3, 200)
    alone = [text.upper() + "." for _, text, _ in license_scan.TEMPLATES]
    for (label, text, _), r in zip(license_scan.TEMPLATES, scanned(spark, alone)):
        assert label in r[5].split(",") and r[6] > 0.99, text
    every = [f"{fill}\n{text.capitalize()}.\n{fill}" for _, text, _ in license_scan.TEMPLATES]
    for (label, _, _), r in zip(license_scan.TEMPLATES, scanned(spark, every)):
        assert label in r[5].split(",")


def test_a_missing_key_phrase_or_other_place_is_no_match(spark):
    rows = scanned(spark, [
        "released under the license of mit",  # the words, not the phrase
        "the mit license",  # without the words around it: share decides
        "apache version 2 0 license licensed under the",
        "permission is hereby granted free of charge " + "x " * 60 + "deal in the software without restriction",  # phrases too far apart
        "released as is under the mit license",  # two words inserted
        "software the of license public general version",
        "", None,
    ])
    labels = [r[5] for r in rows]
    assert labels[0] == labels[2] == labels[3] == labels[5] == labels[6] == labels[7] == ""
    assert labels[4] == "mit" and rows[6][0] == rows[7][0] == 0 and rows[6][6] == 0.0


def test_every_place_counts_in_a_long_text(spark):
    text = "the license " * 20000 + "licensed under the apache license version 2 0 " + "all rights reserved " * 3000
    r = scanned(spark, [text])[0]
    assert r[1] == 3000 and r[5] == "apache-2.0,reserved" and r[3] == 40000 + 8 + 3 * 2999


def test_on_odd_rows(spark):
    df = edge.documents(spark)
    got = sorted((tuple(r)[:6] for r in license_scan.summary(license_scan.scan(df)).collect()), key=repr)
    assert got == sorted(((i, *base(t)) for i, t, *_ in edge.rows()), key=repr)
    assert license_scan.summary(license_scan.scan(edge.nothing(spark))).count() == 0


def test_query_against_the_definition(spark):
    sf = "/root/testdata/sf0.01"
    docs = dict(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    got = queries.op13_license_scan(spark, sf).collect()
    assert len(got) == len(docs) and all(tuple(r)[1:6] == base(docs[r.doc_id]) for r in got)
    lines = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc"}
    for r in got:
        own = set(r.labels.split(",")) - {""}
        assert own == {x for line, x in lines.items() if line in docs[r.doc_id]} | set(r.base_labels.split(",")) - {""}
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(own)
