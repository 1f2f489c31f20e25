"""Numbers in a global order without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

_IN_RANGE = (1 << 33) - 1


def numbered(df: DataFrame, *order: Column | str, name: str = "number", start: int = 1) -> DataFrame:
    """``df`` with ``name``: its place in ``order``, counted from ``start``.

    Rows are dealt into ranges of the order and sorted within them; a row's
    number is its place in its range after the rows of the ranges before.  One
    count a range reaches the driver.  ``order`` should name each row: rows that
    tie in it stay together and are numbered as they lie.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_row", F.monotonically_increasing_id())
    sizes = ranged.groupBy(F.shiftright("_row", 33).cast("int").alias("_range")).agg(F.count(F.lit(1)).alias("n")).collect()
    begins, total = [], start
    for r in sorted(sizes, key=lambda r: r["_range"]):
        begins.append((r["_range"], total))
        total += r.n
    starts = df.sparkSession.createDataFrame(begins, "_range int, _begin long")
    placed = ranged.join(F.broadcast(starts), F.shiftright("_row", 33).cast("int") == F.col("_range"))
    return placed.withColumn(name, F.col("_begin") + F.col("_row").bitwiseAND(F.lit(_IN_RANGE))).select(*df.columns, name)


def running_sums(df: DataFrame, by: str, order: str, **sums: Column) -> DataFrame:
    """``df`` with, for each name, the sum of its column over the earlier rows of the same ``by``.

    A key's rows need not fit a task: rows are dealt into ranges of key and order,
    each range adds up its rows, and what the earlier ranges of a key sum to is
    carried into the next.  Only one row a key and range is gathered by key.
    ``order`` is unique within a key; nulls count as zero.
    """
    valued = df.select("*", *(F.coalesce(c, F.lit(0)).alias(f"_v_{n}") for n, c in sums.items()))
    ranged = cut(valued.repartitionByRange(by, order).sortWithinPartitions(by, order)).withColumn("_range", F.shiftright(F.monotonically_increasing_id(), 33).cast("int"))
    before = Window.partitionBy("_by").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_r")).agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums))
    carried = totals.withColumnRenamed("_r", "_range").select("_by", F.col("_range").alias("_r"), *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums))
    joined = ranged.join(carried, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")))
    own = Window.partitionBy(by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(*df.columns, *((F.coalesce(F.sum(f"_v_{n}").over(own), F.lit(0)) + F.col(f"_c_{n}")).alias(n) for n in sums))
