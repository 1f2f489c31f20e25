"""Events fanned out to subscribers whose queues drop their oldest event when full."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Events that a subscriber's queue holds.
QUEUE = 512
OUT = "subscriber long, read_seq long, delivered array<long>, dropped long"


def deliveries(log: DataFrame, size: int = QUEUE) -> DataFrame:
    """``subscriber, read_seq, delivered, dropped`` of each read in a log of ``subscriber, seq, reads``.

    A read empties the queue: it gets the newest ``size`` events since the
    subscriber's last read, oldest first; the others were dropped.  Events are
    numbered back from their read by counts over ranges, so that a subscriber's whole log is
    no task's work; only what is delivered, ``size`` events at most, is gathered.
    """
    from ..operators.ordering import running_sums

    placed = running_sums(log.select("subscriber", "seq", "reads"), "subscriber", "seq", _segment=F.col("reads").cast("long"), _events=(~F.col("reads")).cast("long"))
    reads = placed.filter("reads").select("subscriber", "_segment", F.col("seq").alias("read_seq"), F.col("_events").alias("_end"))
    ends = Window.partitionBy("subscriber").orderBy("_segment")
    reads = reads.withColumn("_begin", F.coalesce(F.lag("_end").over(ends), F.lit(0)))
    kept = placed.filter("not reads").join(reads, ["subscriber", "_segment"]).filter(F.col("_events") >= F.col("_end") - size)
    got = kept.groupBy("subscriber", "_segment").agg(F.array_sort(F.collect_list("seq")).alias("delivered"))
    every = reads.join(got, ["subscriber", "_segment"], "left")
    return every.select("subscriber", "read_seq", F.coalesce("delivered", F.array().cast("array<long>")).alias("delivered"), F.greatest(F.col("_end") - F.col("_begin") - size, F.lit(0)).alias("dropped"))


def delivery_stream(log: DataFrame, size: int = QUEUE) -> DataFrame:
    """``deliveries`` of a stream: a subscriber's state is its queue, ``size`` numbers at most, and its count of dropped events.

    Rows of a micro-batch are taken by ``seq``; a subscriber's rows come in that order from batch to batch.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, dropped = state.get if state.exists else ("", 0)
        queue = deque((int(x) for x in held.split(",") if x), maxlen=size)
        out = []
        for seq, reads in pd.concat(list(frames)).sort_values("seq")[["seq", "reads"]].itertuples(index=False):
            if reads:
                out.append((key[0], int(seq), list(queue), dropped))
                queue.clear()
                dropped = 0
            else:
                dropped += len(queue) == size
                queue.append(int(seq))
        state.update((",".join(map(str, queue)), dropped))
        yield pd.DataFrame(out, columns=["subscriber", "read_seq", "delivered", "dropped"])

    return log.groupBy("subscriber").applyInPandasWithState(step, OUT, "held string, dropped long", "append", GroupStateTimeout.NoTimeout)


def replay(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """What a new subscriber is shown first: for each of ``subscriber, since`` the newest event of every job before it.

    ``events``: job_id, seq, status.  Jobs without an event by then are not shown.
    """
    from ..operators.flow import as_of

    jobs = events.select("job_id").distinct()
    asked = subscriptions.join(jobs, how="cross").select("subscriber", F.col("since").alias("seq"), "job_id")  # the result has these rows
    return as_of(asked, events.select("job_id", "seq", F.col("seq").alias("event_seq"), "status"), "job_id", "seq", ["event_seq", "status"]).filter("event_seq is not null").select("subscriber", "job_id", "event_seq", "status")
