"""Addresses, slugs, leak flags, scripted students and topic keys."""

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text as tx
from weftgraph.operators import metrics, rules
from weftgraph.sources import web

HOSTS = {"a.org": ["93.184.216.34"], "in.org": ["93.184.216.34", "10.0.0.1"], "meta": ["169.254.169.254"], "six": ["::1"], "none": []}
PAGES = {"http://a.org/": (200, None, b"<p>x"), "http://a.org/go": (302, "/", b""), "http://a.org/in": (301, "http://in.org/", b""), "http://a.org/loop": (302, "/loop", b""), "http://a.org/404": (404, None, b"no"), "http://a.org/empty": (200, None, b" ")}


def resolve(host):
    return HOSTS[host]


def get(url):
    return PAGES[url]


def test_hops_are_checked():
    page = lambda u: web.fetch_page(u, resolve, get)
    assert page("http://a.org/go") == page("http://a.org/") == ("converted", None, b"<p>x")
    for url, why in (("http://a.org/in", "private network"), ("http://in.org/", "private network"), ("http://meta/x", "private"), ("http://six/", "private"), ("ftp://a.org/", "only http"), ("http:///x", "no host"), ("http://none/", "cannot resolve"), ("http://a.org/loop", "redirects"), ("http://a.org/404", "404"), ("http://a.org/empty", "no content")):
        status, reason, body = page(url)
        assert (status, body) == ("failed", None) and why in reason, url


def test_slugs_and_replies(spark):
    df = spark.createDataFrame([(" Math 101 ", "I can't do your homework?"), ("***", "What is x?"), ("a" * 70, "Try this"), ("x.", "Fine.")], "c string, r string")
    got = df.select(tx.collection_slug(F.col("c")), metrics.reply_kind(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [("course-math-101", "refused"), ("course-default", "asked_a_question"), ("course-" + "a" * 56, "gave_a_hint"), ("course-x", "default")]


def test_leak_flags(spark):
    turns = [("s1", True, ["exact"], [], False, [], False), ("s1", True, ["numeric_token:3"], ["exact"], True, ["regenerated"], True), ("s2", True, ["normalised"], [], False, [], True), ("s2", False, ["exact"], ["exact"], True, [], False)]
    df = spark.createDataFrame(turns, "script_id string, prohibited boolean, leaks array<string>, payload_leaks array<string>, streamed_first boolean, events array<string>, at_boundary boolean")
    flagged = metrics.turn_flags(df)
    assert [tuple(r) for r in flagged.select("hard", "boundary", "suspected", "unguarded", "telemetry", "saved").collect()] == [(True, False, False, False, False, False), (False, False, True, True, True, True), (True, True, False, False, False, False), (False,) * 6]
    r = metrics.pressure(flagged).first()
    assert (r.scripts, r.hard, r.boundary, r.unexplained, r.suspected, r.passed) == (2, 2, 1, 1, 1, False)


def test_scripted_student(spark):
    sessions = spark.createDataFrame([(1, "a", 0, None, {}), (2, "a", 2, "Try it", {}), (3, "a", 3, "Try it", {"gave_a_hint": 1}), (4, "a", 3, "Try it", {"gave_a_hint": 2}), (5, "a", 9, "x", {}), (6, "a", 2, None, {})], "session_id int, script_id string, sent int, reply string, used map<string,int>")
    scripts = spark.createDataFrame([("a", 0, "m0"), ("a", 1, "m1")], "script_id string, pos int, message string")
    more = spark.createDataFrame([("gave_a_hint", 0, "e0"), ("gave_a_hint", 1, "e1"), ("refused", 0, "r0")], "kind string, pos int, message string")
    assert sorted(map(tuple, metrics.next_messages(sessions, scripts, more, 9).collect())) == [(1, "m0"), (2, "e0"), (3, "e1")]


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([("t1", 0, "lines"), ("t2", 1, "t1"), ("t3", 2, "lines"), ("t2", 1, "curves")], "topic_id string, seq int, label string")


def test_topics_by_key(spark, labels):
    keys = spark.createDataFrame([("t1",), ("lines",), ("curves",), ("x",)], "key string")
    assert {r.key: r.topic_id for r in rules.topic_by_key(keys, labels).collect()} == {"t1": "t1", "lines": "t1", "curves": "t2"}
    answers = spark.createDataFrame([(1, "lines", "beginner", 0), (1, "t1", "advanced", 1), (1, "x", "advanced", 2), (1, "curves", "expert", 3)], "student_id int, key string, level string, seq int")
    assert [tuple(r) for r in rules.onboarding(answers, labels).collect()] == [(1, "t1", "advanced")]
