"""Streaming forms: inbox, latest job states, session folds, windows over events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery


def inbox_stream(spark: SparkSession, path: str, archive: str | None = None) -> DataFrame:
    """New text files of a folder as ``file, text``; done files move to ``archive`` if given."""
    r = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", "100")
    if archive:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return r.load(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def ingest(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes through ``batch`` once; the checkpoint keeps the books."""
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_events(events: DataFrame, key: str = "job_id", order: str = "seq") -> DataFrame:
    """The newest event per key, in update mode."""
    cols = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("event")).select(key, "event.*")


#: fixed values: allowed moves of a job
MOVES = {"queued": {"running", "error"}, "running": {"running", "done", "error"}, "done": set(), "error": {"queued"}}


def job_states(events: DataFrame) -> DataFrame:
    """``job_id, status, percent, ignored``: moves that the state machine forbids are counted.

    Input: job_id, seq, status, percent.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, percent, ignored = state.get if state.exists else ("", 0, 0)
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            if status == "" or row.status in MOVES.get(status, set()):
                status, percent = row.status, int(row.percent)
            else:
                ignored += 1
        state.update((status, percent, ignored))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "percent": [percent], "ignored": [ignored]})

    out, kept = "job_id string, status string, percent int, ignored int", "status string, percent int, ignored int"
    return events.groupBy("job_id").applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.NoTimeout)


def session_states(turns: DataFrame) -> DataFrame:
    """Per session the active problem, asked and solved sets and the number of turns.

    Input: session_id, turn, problem_id, evaluation.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active, asked, solved, n = state.get if state.exists else (None, "", "", 0)
        a, s = [x for x in asked.split("\n") if x], [x for x in solved.split("\n") if x]
        for row in pd.concat(list(frames)).sort_values("turn").itertuples():
            n += 1
            if isinstance(row.problem_id, str):
                active = row.problem_id
                a += [active] if active not in a else []
            if row.evaluation == "correct" and active and active not in s:
                s.append(active)
        state.update((active, "\n".join(a), "\n".join(s), n))
        yield pd.DataFrame({"session_id": [key[0]], "active_problem_id": [active], "asked": [a], "solved": [s], "turns": [n]})

    out = "session_id string, active_problem_id string, asked array<string>, solved array<string>, turns int"
    return turns.groupBy("session_id").applyInPandasWithState(step, out, "active string, asked string, solved string, turns int", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per type and window with a watermark (an extension)."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), "event_type").agg(F.count(F.lit(1)).alias("n"))
