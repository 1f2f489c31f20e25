from pyspark.sql import functions as F

from weftgraph.streaming import jobs


def run(df, name, mode="update"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_inbox_is_read_once(spark, tmp_path):
    box, seen = tmp_path / "in", []
    box.mkdir()
    (box / "a.md").write_text("one")
    for more in (None, "two"):
        if more:
            (box / "b.md").write_text(more)
        jobs.ingest(jobs.inbox_stream(spark, str(box)), lambda df, i: seen.extend(r.file for r in df.collect()), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(seen) == ["a.md", "b.md"]


def stream(spark, path, rows, schema):
    spark.createDataFrame(rows, schema.replace("timestamp", "string")).coalesce(1).write.json(str(path))
    return spark.readStream.schema(schema).json(str(path))


def test_job_states(spark, tmp_path):
    s = stream(spark, tmp_path / "j", [("a", 1, "queued", 0), ("a", 2, "running", 50), ("a", 3, "queued", 0), ("a", 4, "done", 100), ("b", 1, "queued", 0)], "job_id string, seq int, status string, percent int")
    run(jobs.job_states(s), "job_states")
    assert {r.job_id: (r.status, r.percent, r.ignored) for r in spark.table("job_states").collect()} == {"a": ("done", 100, 1), "b": ("queued", 0, 0)}


def test_session_states(spark, tmp_path):
    s = stream(spark, tmp_path / "s", [("s", 1, "p1", None), ("s", 2, None, "correct"), ("s", 3, "p2", None)], "session_id string, turn int, problem_id string, evaluation string")
    run(jobs.session_states(s), "session_states")
    r = spark.table("session_states").first()
    assert (r.active_problem_id, r.asked, r.solved, r.turns) == ("p2", ["p1", "p2"], ["p1"], 3)


def test_latest_and_windows(spark, tmp_path):
    s = stream(spark, tmp_path / "l", [("a", 1, "x"), ("a", 2, "y")], "job_id string, seq int, status string")
    run(jobs.latest_events(s), "latest_events")
    assert spark.table("latest_events").orderBy(F.desc("seq")).first().status == "y"
    e = stream(spark, tmp_path / "w", [("2024-01-01 00:10:00", "c"), ("2024-01-01 00:20:00", "c")], "ts timestamp, event_type string")
    run(jobs.windowed_counts(e), "windowed")
    assert spark.table("windowed").agg(F.max("n")).first()[0] == 2
