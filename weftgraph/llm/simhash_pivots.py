"""SimHash near-dedup with a pivot distance table.

Fingerprints: the whole text, A-Z lower-cased, as 3-word shingles (repeats
included; fewer words: the whole sequence; none: zero); each shingle's XXH64
votes per bit and a bit is one where over half the votes are.

Search: each distinct fingerprint gets its row of the *pivot distance table*, the
Hamming distances to ``PIVOTS`` scattered reference fingerprints, once; the row
goes with it wherever it goes.  By the triangle inequality a pair within
``radius`` bits differs by ``radius`` at most in every coordinate, so

* pairs are proposed by equal keys: a pair within 3 bits agrees on 3 of 6 blocks
  of bits.  (Coordinates alone could propose pairs by neighbouring cells only: a
  cell of ``radius + 1`` holds a third of all fingerprints and each would be in
  two of them per pivot.)
* a proposed pair is discarded where the maximum difference of the stored
  coordinates is over ``radius``, and
* survivors are verified bit by bit.  ``filter_counts`` tells how many pairs
  each step left.

A bucket with more than ``bucket`` fingerprints does not form its pairs: its
members are keyed again with the remaining bits in four parts, one of which
must be equal too, until buckets are small or only ``radius`` bits are left
(then all members are linked to the least).  No pair is lost by this.

Null texts have no words; null ids sort after all others; rows of one id are
documents of their own; an empty table gives no rows; other columns are
ignored.  A very long text takes 24 bytes a word while its task hashes it.
Fingerprints, keys and components of which very many rows have the same one are
spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..operators.components import connected_components, join_hubs, join_spread
from .storage import cut, new_folder

RADIUS = 3
BLOCKS = (11, 11, 11, 11, 10, 10)
BUCKET = 32
PIVOTS = 16
SEED = 42


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w)) + 1
    ends = np.cumsum(size) - 1
    if len(w) < 3:
        starts, stops = [0], [len(joined)]
    else:
        starts, stops = (ends[: len(w) - 2] - size[: len(w) - 2] + 1).tolist(), ends[2:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * votes > len(h)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row_key, fp`` for each row: a hash of id and text, and the fingerprint as a signed long."""
    ship(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py()) for x in b.column(2)), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fp.view(np.int64))], schema=out)

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text).alias("row_key"), text.alias("text")).mapInArrow(run, "doc_id long, row_key long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split(bits: list[int], parts: int) -> list[int]:
    """``parts`` masks that cover ``bits`` between them."""
    return [sum(1 << b for b in bits[k::parts]) for k in range(parts)]


def first_masks(blocks: tuple[int, ...] = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Masks of all choices of ``len(blocks) - radius`` blocks."""
    made, at = [], 0
    for n in blocks:
        made.append(((1 << n) - 1) << at)
        at += n
    return [sum(c) for c in combinations(made, len(blocks) - radius)]


def finer_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """``mask`` with one of ``radius + 1`` parts of the other bits added."""
    return [mask | m for m in _split([b for b in range(64) if not mask >> b & 1], radius + 1)]


def pivots(n: int = PIVOTS) -> list[int]:
    """Scattered reference fingerprints: XXH64 of their numbers."""
    import xxhash

    return [xxhash.xxh64_intdigest(str(k).encode(), SEED) for k in range(n)]


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivot_table(fps: DataFrame) -> DataFrame:
    """``fp`` and its distances to all pivots, eight to a long: columns ``c0, c1, ...``."""
    away = [_apart(F.col("fp"), F.lit(_signed(p))).cast("long") for p in pivots()]
    packed = []
    for k in range(0, len(away), 8):
        long = away[k]
        for i, x in enumerate(away[k + 1 : k + 8], 1):
            long = long.bitwiseOR(F.shiftleft(x, 8 * i))
        packed.append(long.alias(f"c{k // 8}"))
    return fps.select("fp", *packed)


_COORDINATES = [f"c{k}" for k in range(-(-PIVOTS // 8))]


def _largest_difference() -> Column:
    """The maximum difference of the stored coordinates of a pair (l, r)."""
    each = [F.abs(F.shiftrightunsigned(f"l.{c}", 8 * i).bitwiseAND(F.lit(127)) - F.shiftrightunsigned(f"r.{c}", 8 * i).bitwiseAND(F.lit(127))) for c in _COORDINATES for i in range(8)]
    return F.greatest(*each)


def _proposed(small: DataFrame) -> DataFrame:
    """Pairs ``l, r`` of members of one bucket."""
    own = small.select("mask", "key", "fp", *_COORDINATES)
    return own.alias("l").join(own.alias("r"), (F.col("l.mask") == F.col("r.mask")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.fp")))


def _buckets(keyed: DataFrame) -> DataFrame:
    """Members of keys that two fingerprints or more have, with their number and the least."""
    keyed = keyed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("low")).filter("n > 1")
    return join_spread(keyed, sizes, ["mask", "key"])


def _first_keys(table: DataFrame, radius: int) -> DataFrame:
    return table.select("fp", *_COORDINATES, F.explode(F.array(*[F.lit(_signed(m)) for m in first_masks(radius=radius)])).alias("mask"))


def filter_counts(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> dict[str, int]:
    """How many pairs (one per key that they share) small buckets propose, the pivots leave, and are within ``radius``."""
    pairs = _proposed(_buckets(_first_keys(pivot_table(fps), radius)).filter(F.col("n") <= bucket))
    near, verified = _largest_difference() <= radius, _apart(F.col("l.fp"), F.col("r.fp")) <= radius
    return pairs.agg(F.count(F.lit(1)).alias("proposed"), F.count_if(near).alias("left_by_pivots"), F.count_if(verified).alias("verified"), F.count_if(verified & ~near).alias("lost")).first().asDict()


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges ``a, b`` that connect what pairs of distinct ``fp`` within ``radius`` connect."""
    spark = fps.sparkSession
    keyed = _first_keys(cut(pivot_table(fps)), radius)
    path = new_folder(spark, "links")
    while True:
        members = cut(_buckets(keyed))
        last = F.bit_count(F.col("mask")) >= 64 - radius
        small = members.filter((F.col("n") <= bucket) & ~last)
        pairs = _proposed(small).filter(_largest_difference() <= radius).filter(_apart(F.col("l.fp"), F.col("r.fp")) <= radius)
        new = pairs.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b")).unionByName(members.filter(last & (F.col("fp") != F.col("low"))).select(F.col("fp").alias("a"), F.col("low").alias("b")))
        new.distinct().write.mode("append").parquet(path)
        crowded = members.filter((F.col("n") > bucket) & ~last)
        if crowded.isEmpty():
            return spark.read.parquet(path).distinct()
        # at most 20 * 4**level masks, whatever the input
        used = sorted(r.mask for r in crowded.select("mask").distinct().collect())
        finer = [[_signed(f) for f in finer_masks(m % (1 << 64), radius)] for m in used]
        # as an Arrow table: rows of a list would start Python workers of another kind
        table = spark.createDataFrame(pa.table({"mask": pa.array(used, pa.int64()), "finer": pa.array(finer, pa.list_(pa.int64()))}))
        keyed = crowded.join(F.broadcast(table), "mask").select("fp", *_COORDINATES, F.explode("finer").alias("mask")).distinct()


def _clustered(docs: DataFrame, radius: int, bucket: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, row_key, fp, component_id, head``: head is the row key of the group's kept row."""
    marked = cut(fingerprints(docs, id_col, text_col))
    # a null id comes after all others
    first = F.struct(F.col("doc_id").isNull().alias("unset"), "doc_id", "row_key")
    classes = cut(marked.groupBy("fp").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")))
    roots = connected_components(links(classes.select("fp"), radius, bucket))
    rooted = cut(classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", "n", "root"))
    alone = rooted.filter("root is null").select("fp", "n", "first")
    linked = rooted.filter("root is not null")
    owner = linked.groupBy("root").agg(F.min("first").alias("owner"))
    joined = join_spread(linked.select("fp", "n", "root"), owner, ["root"]).select("fp", "n", F.col("owner").alias("first"))
    named = alone.unionByName(joined).select("fp", "n", F.col("first.doc_id").alias("component_id"), F.col("first.row_key").alias("head"))
    return join_hubs(marked, named, ["fp"]).select("doc_id", "row_key", "fp", "component_id", "head")


def cluster(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for each row; the component is null only where no id of a group is set."""
    return _clustered(docs, radius, bucket, id_col, text_col).select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per group, columns unchanged: the least id, nulls last.

    Rows that repeat both id and text are one document.
    """
    heads = _clustered(docs, radius, bucket, id_col, text_col).filter("row_key = head").select(F.col("head").alias("_head")).distinct()
    keyed = docs.withColumn("_row", F.xxhash64(id_col, F.col(text_col).cast("string")))
    return keyed.join(heads, F.col("_row") == F.col("_head"), "left_semi").dropDuplicates(["_row"]).drop("_row")


def hexadecimal(fp: Column) -> Column:
    """A signed long as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def brute_force(rows: list[tuple[int, str | None]], radius: int = RADIUS) -> list[tuple]:
    """``(doc_id, fingerprint, component_id)`` by comparing all pairs, for tests."""
    fp = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None and (r not in least or d < least[r]):
            least[r] = d
    return [(d, f"{fp[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)]
