"""Mixing sources to target weights by hash-threshold histograms.

Sources in code point order (null last) weigh 1, 2, 3, repeating, and share
all words by weight; no source's target exceeds ``REPEATS`` times its size, and
what it can't use is shared again among the others.  A source takes each of
its documents ``floor(target / size)`` times, and once more those whose hash is
at most the source's threshold.

The threshold is found without sorting: words are summed by source and hash
bucket (the hash's leading bits), the running sum finds the bucket in which
the budget ends, and only that bucket's documents are summed again by the
next bits, until one hash value is left; that value is taken if this brings
the sum nearer to the budget.  Thresholds are nested: what a budget takes, a
larger one takes as well; documents of equal hashes are taken together or not.

Null texts have no words and are never taken.  Rows that repeat both id and
text hash alike and are taken alike.  An empty table gives no rows.  Internal
columns have names of their own, so other columns pass through.  Of a very long
text only its number of words is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

WORD = r"[^\x20\x09-\x0D]+"
REPEATS = 3
WEIGHTS = 3
BITS, STEP = 60, 10
#: Sources up to which the table of thresholds (under 100 bytes each) is broadcast.
BROADCAST_SOURCES = 50_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column, text: Column) -> Column:
    """60 uniform bits of id and text."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, h``: the narrow table that all sums are made from."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_in(text).alias("size"), document_hash(F.col(id_col), text).alias("h"))


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target, full, rest`` from ``source, source_size`` (a row per source).

    Sources fill up in the order of limit / weight; the first that its share
    does not fill sets the common share of all after it.  The comparisons are
    of whole numbers.
    """
    big = "decimal(38,0)"
    every = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", (F.row_number().over(every) - 1) % WEIGHTS + 1).withColumn("limit", F.col("source_size") * REPEATS)
    filling = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = ranked.select(
        "source", "source_size", "weight", "limit",
        F.row_number().over(filling).alias("rank"),
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(after).alias("weights"),
    )
    fits = F.col("left").cast(big) * F.col("weight") <= F.col("limit").cast(big) * F.col("weights")
    chosen = shared.withColumn("at", F.min(F.when(fits, F.col("rank"))).over(whole))
    common = chosen.withColumns({k: F.max(F.when(F.col("rank") == F.col("at"), F.col(k))).over(whole) for k in ("left", "weights")})
    full = F.col("rank") < F.col("at")
    target = F.when(full, F.col("limit").cast("double")).otherwise(F.col("left").cast("double") * F.col("weight").cast("double") / F.col("weights").cast("double"))
    size = F.col("source_size").cast("double")
    times = F.when(size > 0, F.least(F.floor(F.col("target") / size), F.lit(REPEATS))).otherwise(F.lit(0)).cast("long")
    out = common.withColumn("target", target).withColumn("full", times)
    rest = F.when(F.col("full") >= REPEATS, F.lit(0.0)).otherwise(F.col("target") - F.col("full") * size)
    return out.withColumn("rest", rest).select("source", "source_size", "target", "full", "rest")


def thresholds(base: DataFrame) -> DataFrame:
    """``source, source_size, target, full, threshold``: a row per source of ``base`` (see ``sized``)."""
    goals = cut(targets(base.groupBy("source").agg(F.sum("size").alias("source_size"))))
    known = None
    open_ = goals.select("source", "rest", F.lit(0.0).alias("below"), F.lit(0).cast("long").alias("prefix"))
    for depth in range(STEP, BITS + 1, STEP):
        within = open_.select(F.col("source").alias("_s"), "rest", "below", "prefix")
        same = F.col("source").eqNullSafe(F.col("_s"))
        # all rows at first, then those of the boundary buckets only
        part = base if depth == STEP else base.join(within, same & (F.shiftright(F.col("h"), BITS - depth + STEP) == F.col("prefix"))).select(*base.columns)
        sums = part.groupBy("source", F.shiftright(F.col("h"), BITS - depth).alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.join(within, same).withColumn("upto", F.col("below") + F.sum("words").over(running)).withColumn("from", F.col("upto") - F.col("words"))
        ends = cut(sums.filter((F.col("from") < F.col("rest")) & (F.col("rest") <= F.col("upto"))))
        done = (F.col("low") == F.col("high")) | (F.col("rest") == F.col("upto"))
        nearer = F.col("from") + F.col("upto") <= 2 * F.col("rest")
        found = ends.filter(done).select(F.col("source").alias("_s"), F.when(nearer, F.col("high")).otherwise(F.col("low") - 1).alias("threshold"))
        known = found if known is None else known.unionByName(found)
        open_ = ends.filter(~done).select("source", "rest", F.col("from").alias("below"), F.col("bucket").alias("prefix"))
        if open_.isEmpty():
            break
    # no words are left over where a source has no boundary
    joined = goals.join(known, F.col("source").eqNullSafe(F.col("_s")), "left")
    return joined.select("source", "source_size", "target", "full", F.coalesce("threshold", F.lit(-1).cast("long")).alias("threshold"))


def _limits(base: DataFrame) -> DataFrame:
    """The thresholds, named apart, and broadcast where the number of sources allows."""
    table = cut(thresholds(base).select(F.col("source").alias("_mix_source"), F.col("source_size").alias("_mix_size"), F.col("target").alias("_mix_target"), F.col("full").alias("_mix_full"), F.col("threshold").alias("_mix_threshold")))
    return F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table


def _times(h: Column) -> Column:
    return F.col("_mix_full") + (h <= F.col("_mix_threshold")).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken, times`` for each row of ``docs``."""
    base = cut(sized(docs, id_col, text_col, source_col))
    out = base.join(_limits(base), F.col("source").eqNullSafe(F.col("_mix_source")))
    times = _times(F.col("h"))
    return out.select("doc_id", "size", F.col("_mix_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("size") * times).alias("taken"), times.alias("times"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows that the mix takes, each as often as it is taken, columns unchanged.

    Documents without words weigh nothing in a mix and are left out.
    """
    base = cut(sized(docs, id_col, text_col, source_col))
    text = F.col(text_col).cast("string")
    joined = docs.join(_limits(base), F.col(source_col).cast("string").eqNullSafe(F.col("_mix_source")))
    times = _times(document_hash(docs[id_col], text))
    repeated = joined.filter(F.coalesce(text, F.lit("")).rlike(WORD)).withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
    return repeated.select(*[docs[c] for c in docs.columns])


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS lim FROM s),
r AS (SELECT *, row_number() OVER f AS rank,
             CAST(sum(source_size) OVER () - coalesce(sum(lim) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest_all,
             CAST(sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weights
      FROM w WINDOW f AS (ORDER BY CAST(lim AS DOUBLE) / weight, source NULLS LAST)),
k AS (SELECT rank AS cut_rank, rest_all AS rest_k, weights AS weights_k FROM r
      WHERE CAST(rest_all AS HUGEINT) * weight <= CAST(lim AS HUGEINT) * weights ORDER BY rank LIMIT 1),
t AS (SELECT source, source_size,
             CASE WHEN rank < cut_rank THEN CAST(lim AS DOUBLE) ELSE CAST(rest_k AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(weights_k AS DOUBLE) END AS target FROM r, k),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS BIGINT) ELSE 0 END AS times FROM t),
v AS (SELECT *, CASE WHEN times >= 3 THEN 0.0 ELSE target - times * CAST(source_size AS DOUBLE) END AS rest FROM u),
c AS (SELECT d.*, CAST(sum(size) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) AS DOUBLE) AS upto,
             CAST(sum(size) OVER (PARTITION BY source, h) AS DOUBLE) AS own FROM d)
SELECT c.doc_id, c.size, v.source_size, v.target,
       c.size * (v.times + CASE WHEN 2 * c.upto - c.own <= 2 * v.rest THEN 1 ELSE 0 END) AS taken
FROM c JOIN v ON c.source IS NOT DISTINCT FROM v.source
"""
