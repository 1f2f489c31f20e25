"""Decisions along a run's calls, and dimensions that change while facts arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running_sums

#: Copies of a version, so that a key's facts are dealt over as many tasks.
SALTS = 16


def call_decisions(calls: DataFrame, cap: float, budget: int, waits: int = 1, run: str = "run", order: str = "seq") -> DataFrame:
    """``decision, reason, spent`` of each call of a run (columns run, seq, limited, wait, cost).

    A call that meets a rate limit waits if the wait is at most ``cap`` and the run
    has waited fewer than ``waits`` times; else it and all later calls of the run are
    deferred.  A call that finds more than ``budget`` spent stops the run likewise.
    All other calls proceed and their ``cost`` is spent.

    Before a run stops, each limited call has waited and each call has spent, so
    sums over all earlier calls tell where it stops first; no state is carried from
    row to row and a long run is no single task's work.  A null limit is none, a null
    wait is no time, a null cost is nothing.
    """
    limited, wait = F.coalesce(F.col("limited"), F.lit(False)), F.coalesce(F.col("wait"), F.lit(0.0))
    summed = running_sums(calls, run, order, _waits=limited.cast("long"), spent=F.col("cost"))
    why = F.when(F.col("spent") > budget, F.lit("budget")).when(limited & ((wait > cap) | (F.col("_waits") >= waits)), F.lit("rate_limit"))
    judged = summed.withColumn("_why", why)
    stops = judged.filter("_why is not null").groupBy(F.col(run).alias("_run")).agg(F.min_by(F.struct(F.col(order).alias("at"), F.col("_why").alias("why"), F.col("spent").alias("spent")), order).alias("_stop"))
    joined = judged.join(stops, F.col(run).eqNullSafe(F.col("_run")), "left")
    stopped = F.col("_stop").isNotNull() & (F.col(order) >= F.col("_stop.at"))
    decision = F.when(stopped, F.lit("deferred")).when(limited, F.lit("waited")).otherwise(F.lit("proceed"))
    return joined.select(*calls.columns, decision.alias("decision"), F.when(stopped, F.col("_stop.why")).alias("reason"), F.when(stopped, F.col("_stop.spent")).otherwise(F.col("spent")).alias("spent"))


def as_of(facts: DataFrame, versions: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """``facts`` with ``columns`` of the newest version of their key at or before ``at`` (null: none yet).

    Both tables are sorted together and the last version seen is carried on; versions
    come before facts of the same time, and of versions of one time the greatest by
    ``columns`` counts.  Each version goes to ``SALTS`` tasks and each fact to one of
    them, so a key that very many facts have is spread.  Facts without a time get none.
    """
    v = versions.filter(F.col(at).isNotNull()).select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.struct(*columns).alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.lit(0).alias("_kind"))
    f = facts.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.pmod(F.xxhash64(*facts.columns), F.lit(SALTS)).cast("int").alias("_salt"), F.lit(1).alias("_kind"), F.struct(*facts.columns).alias("_f"))
    seen = Window.partitionBy("_key", "_salt").orderBy(F.col("_at").asc_nulls_first(), "_kind", "_v").rowsBetween(Window.unboundedPreceding, 0)
    carried = v.unionByName(f, allowMissingColumns=True).withColumn("_last", F.last("_v", ignorenulls=True).over(seen)).filter("_kind = 1")
    value = lambda c: F.when(F.col("_key").isNotNull(), F.col("_last")[c]).alias(c)
    return carried.select("_f.*", *map(value, columns))

