"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut


def remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id: of the empty text)."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with ``_label``: ``per_class`` distinct texts of each class at most.

    Ids and texts are taken in the order of a hash, so the sample is the same
    each time and does not depend on partitions.  Ids with the held-out remainder,
    without a label, or null are not used; an id labelled twice counts by its
    larger label; of equal texts of one class one row is used.  Ids and text keys
    are few by construction and are broadcast.
    """
    usable = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), modulus) != held))
    one = usable.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    ids = reduce(DataFrame.unionByName, [one.filter(F.col("_label") == c).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for c in (0, 1)])
    named = docs.join(F.broadcast(ids), docs[id_col] == ids["_id"]).drop("_id")
    # an id may have any number of rows: of each class and text one is kept, and per_class texts in all; rows
    # are numbered as they were written, so that only numbers are grouped and texts stay where they are
    rows = cut(named.withColumn("_key", F.xxhash64(F.col(text_col).cast("string")))).withColumn("_n", F.monotonically_increasing_id())
    first = rows.groupBy("_label", "_key").agg(F.min("_n").alias("_first"))
    most = reduce(DataFrame.unionByName, [first.filter(F.col("_label") == c).orderBy("_key").limit(per_class).select("_first") for c in (0, 1)])
    return rows.join(F.broadcast(most), F.col("_n") == F.col("_first"), "left_semi").drop("_n", "_key")
