"""Result tables that spare calls, and queues that drop their oldest, against plain forms."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from weftgraph import catalogue
from weftgraph.plans import cached
from weftgraph.providers import Stub
from weftgraph.streaming import fanout


def test_only_what_changed_is_asked(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = [(k, f"text {k % 7}") for k in range(20)] + [(20, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    one, calls = cached.cached_stage(df, path, "atomize", Stub(), "text", "id", ("digest",))
    assert calls.count() == 7 and one.filter("result is not null").count() == 20
    first = {r.id: r.result for r in one.collect()}
    changed = df.withColumn("text", F.when(F.col("id") == 3, "other").otherwise(F.col("text")))
    two, calls = cached.cached_stage(changed, path, "atomize", Stub(), "text", "id", ("digest",))
    assert [r.outcome for r in calls.collect()] == ["ok"]
    assert {r.id: (r.result, r.from_version) for r in two.collect() if r.id not in (3, 20)} == {k: (v, 1) for k, v in first.items() if k not in (3, 20)}
    assert two.filter("id = 3").first().from_version == 2
    assert cached.cached_stage(changed, path, "atomize", Stub(), "text", "id", ("digest",))[1].count() == 0
    # another model, stage, instruction or wanted key is another address
    for more in ({"model": "b"}, {"system": "s"}):
        assert cached.cached_stage(changed, path, "atomize", Stub(), "text", "id", ("digest",), **more)[1].count() == 8
    # replies that fail are not stored and are asked for again
    for _ in range(2):
        bad, calls = cached.cached_stage(df, path, "edges", Stub(), "text", "id", ("absent",))
        assert calls.count() == 14 and bad.filter("result is not null").count() == 0
    assert cached.cached_stage(df.limit(0), path, "atomize", Stub(), "text", "id", ("digest",))[0].count() == 0


def test_two_runs_that_both_stored(spark, tmp_path):
    path = str(tmp_path / "results")
    spark.createDataFrame([("h", "s", 2, "b"), ("h", "s", 1, "d"), ("h", "s", 1, "c"), ("i", "s", 3, "e")], cached.STORE).write.parquet(path)
    assert sorted(map(tuple, cached.stored(spark, path).collect())) == [("h", 1, "c"), ("i", 3, "e")]


def test_cached_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = dict(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    got = catalogue.QUERIES["cached_results"](spark, sf).collect()
    assert len(got) == len(texts)
    known = {t for t in texts.values() if len(t) % 2 == 0}
    for r in got:
        assert r.digest == hashlib.sha256(("\0" + texts[r.doc_id]).encode()).hexdigest()[:16] and r.from_version == (1 if texts[r.doc_id] in known else 2)


def queues(log, size):
    held, lost, out = {}, {}, []
    for sub, seq, reads in sorted(log, key=lambda x: x[1]):
        if reads:
            out.append((sub, seq, held.get(sub, []), lost.get(sub, 0)))
            held[sub], lost[sub] = [], 0
            continue
        queue = [*held.get(sub, []), seq]
        lost[sub] = lost.get(sub, 0) + (len(queue) > size)
        held[sub] = queue[-size:]
    return sorted(out)


@pytest.mark.parametrize("size", [1, 3, 512])
def test_stream_and_batch_agree(spark, tmp_path, size):
    r = random.Random(size)
    log = [(r.choice([1, 1, 1, 2, 3]), k, r.random() < 0.1) for k in range(600)]
    schema = "subscriber long, seq long, reads boolean"
    want = queues(log, size)
    got = fanout.deliveries(spark.createDataFrame(log, schema).repartition(4), size)
    assert sorted(map(tuple, got.collect())) == want
    box = tmp_path / "in"
    name = f"fanout_{size}"
    for part in (log[:250], log[250:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(box))
        q = fanout.delivery_stream(spark.readStream.schema(schema).json(str(box)), size).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).collect())) == want


def test_replay_shows_the_newest_state(spark):
    events = spark.createDataFrame([("a", 1, "queued"), ("a", 3, "done"), ("b", 2, "queued"), ("c", 9, "queued")], "job_id string, seq int, status string")
    asked = spark.createDataFrame([(7, 2), (8, 5)], "subscriber int, since int")
    assert sorted(map(tuple, fanout.replay(events, asked).collect())) == [(7, "a", 1, "queued"), (7, "b", 2, "queued"), (8, "a", 3, "done"), (8, "b", 2, "queued")]
