"""Hybrid vector and keyword retrieval over chunk tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

#: queries that are broadcast at once: some 5 MB of 64 floats
BLOCK = 20_000
#: queries whose products with a batch of chunks are held at once
TILE = 64


def scan(chunks: DataFrame, lang: str | None = None, topic: str | None = None) -> DataFrame:
    """Chunks under a metadata filter, which reaches the file scan."""
    for column, value in (("lang", lang), ("topic", topic)):
        if value is not None:
            chunks = chunks.filter(F.col(column) == value)
    return chunks


def hybrid_topk(queries: DataFrame, chunks: DataFrame, k: int = 5, over: int = 4, vector: float = 0.75, keyword: Column | None = None, block: int = BLOCK) -> DataFrame:
    """``query_id, chunk_id, cosine, keyword, score, rank``.

    The ``over * k`` nearest vectors of each query are ranked again by
    ``vector * cosine + (1 - vector) * keyword`` rounded to 6 places; ties keep
    the vector order.  Queries are broadcast in blocks of about ``block``, dealt
    by a hash of their id; each block scans the chunks once and only ``over * k``
    rows a query and batch of chunks leave the scan.  Every query meets every chunk:
    the products of a tile of both are added up in order, as ``text.dot`` adds them.
    """
    blocks = -(-queries.count() // block)
    if blocks > 1:
        b = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        return reduce(DataFrame.unionByName, [_topk(queries.filter(b == i), chunks, k, over, vector, keyword) for i in range(blocks)])
    return _topk(queries, chunks, k, over, vector, keyword)


def _vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: rows and matrix of the vectors without nulls."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    full = np.nan_to_num(lengths, nan=0).astype(np.int64)
    begins = np.cumsum(full) - full
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    holes = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    sound = column.is_valid().to_numpy(zero_copy_only=False) & (holes[begins + full] == holes[begins])
    out = {}
    for size in np.unique(full[sound]).tolist():
        rows = np.flatnonzero(sound & (full == size))
        out[size] = rows, values[begins[rows][:, None] + np.arange(size)]
    return out


def _nearest(wanted: int, table, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ``wanted`` nearest chunks of a batch to each query, ties by ``chunk_id``; missing products last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, queries = table.value
        for b in batches:
            b = b.take(pc.sort_indices(b, sort_keys=[("chunk_id", "ascending")], null_placement="at_start"))
            have = _vectors(b.column("embedding"))
            rest = b.select(names)
            covered = []
            for size, (numbers, q) in queries.items():
                covered.append(numbers)
                rows, c = have.get(size, (np.zeros(0, dtype=np.int64), np.zeros((0, size))))
                for begin in range(0, len(numbers), TILE):
                    part = q[begin : begin + TILE]
                    sums, product = np.zeros((len(part), len(rows))), np.empty((len(part), len(rows)))
                    for d in range(size):
                        np.multiply(part[:, d : d + 1], c[:, d], out=product)
                        sums += product
                    found = []
                    for i in range(len(part)):
                        cosine = np.full(len(b), -np.inf)
                        cosine[rows] = sums[i]
                        found.append((numbers[begin + i], *_first(cosine, wanted)))
                    yield _batch(found, rest, np.isin(np.arange(len(b)), rows))
            blank = np.setdiff1d(np.arange(total), np.concatenate(covered) if covered else [])
            for begin in range(0, len(blank), TILE):  # queries without a whole vector
                head = np.arange(min(wanted, len(b)))
                yield _batch([(i, head, np.zeros(len(head))) for i in blank[begin : begin + TILE]], rest, np.zeros(len(b), dtype=bool))

    return run


def _first(cosine: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.where(np.isnan(cosine), np.inf, cosine)
    at = np.arange(len(key))
    if wanted < len(key):
        at = np.flatnonzero(key >= np.partition(key, len(key) - wanted)[len(key) - wanted])
    at = at[np.argsort(-key[at], kind="stable")][:wanted]
    return at, cosine[at]


def _batch(found: list, rest: pa.RecordBatch, sound: np.ndarray) -> pa.RecordBatch:
    at, cosine = (np.concatenate([f[k] for f in found]) for k in (1, 2))
    number = np.repeat(np.array([f[0] for f in found], dtype=np.int64), [len(f[1]) for f in found])
    rows = rest.take(pa.array(at))
    return pa.RecordBatch.from_arrays([pa.array(number), pa.array(cosine, mask=~sound[at]), *rows.columns], names=["_q", "cosine", *rest.schema.names])


def _topk(queries: DataFrame, chunks: DataFrame, k: int, over: int, vector: float, keyword: Column | None) -> DataFrame:
    spark = chunks.sparkSession
    asked = queries.toArrow().combine_chunks()  # a block
    asked = asked.append_column("_q", pa.array(np.arange(len(asked))))
    column = asked.column("query_embedding").combine_chunks()
    table = spark.sparkContext.broadcast((len(asked), _vectors(column) if len(asked) else {}))
    names = [c for c in chunks.columns if c != "embedding"]
    schema = T.StructType([T.StructField("_q", T.LongType()), T.StructField("cosine", T.DoubleType()), *(chunks.schema[c] for c in names)])
    met = chunks.repartition(spark.sparkContext.defaultParallelism, "chunk_id").mapInArrow(_nearest(over * k, table, names), schema)
    facts = spark.createDataFrame(asked.drop_columns(["query_embedding"]), T.StructType([*(f for f in queries.schema if f.name != "query_embedding"), T.StructField("_q", T.LongType())]))
    near = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "chunk_id")
    first = met.join(F.broadcast(facts), "_q").withColumn("near", F.row_number().over(near)).filter(F.col("near") <= over * k)
    word = keyword if keyword is not None else tx.overlap(F.col("query_features"), F.col("features"))
    scored = first.select("query_id", "chunk_id", "cosine", word.cast("double").alias("keyword"), "near")
    blended = scored.withColumn("score", F.round(F.lit(vector) * F.col("cosine") + F.lit(1 - vector) * F.col("keyword"), 6))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "near")
    return blended.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("near")


#: Rows of a table that is broadcast once it has been counted.
BROADCAST_ROWS = 500_000
#: Counts of shared features that are held at once.
CELLS = 1 << 21


def overlap_topk(queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, k: int) -> DataFrame:
    """The ``k`` documents with the largest share of each query's distinct features ``fs``; ties by id.

    Queries of up to ``BROADCAST_ROWS`` features in all are broadcast after they are
    counted; documents meet them in tiles of at most ``CELLS`` counts, and a batch of
    documents sends its ``k`` best a query, so that no row of a pair is kept or
    shuffled.  More are joined by shuffling both.  Among the ``2 * k`` least ids there are ``k`` that share
    nothing whenever fewer than ``k`` documents share something, so these
    stand in for all documents with score 0.
    """
    words = queries.select(query_id, F.size("fs").alias("_n"), F.explode("fs").alias("_f"))
    if words.count() <= BROADCAST_ROWS:
        shared = _shared(queries, docs, query_id, doc_id, k)
    else:
        shared = docs.select(doc_id, F.explode("fs").alias("_f")).join(words, "_f").groupBy(query_id, doc_id).agg((F.count(F.lit(1)) / F.max("_n")).alias("score"))
    none = queries.select(query_id).join(F.broadcast(docs.select(doc_id).orderBy(doc_id).limit(2 * k))).withColumn("score", F.lit(0.0))
    best = shared.unionByName(none).groupBy(query_id, doc_id).agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), doc_id))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def _shared(queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, k: int) -> DataFrame:
    """``query_id, doc_id, score`` of each batch's ``k`` documents with the largest share of a query, where it is over 0."""
    asked = queries.filter("size(fs) > 0").select(query_id, "fs").toArrow().combine_chunks()
    lists = asked.column("fs").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    code = pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    owners = np.repeat(np.arange(len(sizes)), sizes)[order]
    begins = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
    table = docs.sparkSession.sparkContext.broadcast((coded.dictionary, owners, begins, sizes, asked.column(query_id).combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, owners, begins, sizes, ids = table.value
        n = len(sizes)
        for b in batches if n else ():
            b = b.take(pc.sort_indices(b, sort_keys=[(doc_id, "ascending")], null_placement="at_start"))
            features = b.column("fs")
            lengths = np.nan_to_num(pc.list_value_length(features).to_numpy(zero_copy_only=False)).astype(np.int64)
            at = pc.fill_null(pc.index_in(features.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
            row, at = np.repeat(np.arange(len(b)), lengths)[at >= 0], at[at >= 0]
            many = begins[at + 1] - begins[at]
            sums = np.concatenate([[0], np.cumsum(many)])
            ends = np.searchsorted(row, np.arange(len(b)), side="right")
            found, begin = [], 0
            while begin < len(b):  # at most CELLS counts, and CELLS meetings or those of one document
                first = ends[begin - 1] if begin else 0
                end = min(begin + max(CELLS // n, 1), max(int(np.searchsorted(sums[ends], sums[first] + CELLS, side="right")), begin + 1), len(b))
                last = ends[end - 1]
                m = many[first:last]
                posting = np.arange(sums[last] - sums[first]) + np.repeat(begins[at[first:last]] - (sums[first:last] - sums[first]), m)
                counts = np.bincount(np.repeat(row[first:last] - begin, m) * n + owners[posting], minlength=(end - begin) * n).reshape(-1, n)
                for _ in range(min(k, end - begin)):
                    best = counts.argmax(axis=0)
                    top = counts[best, np.arange(n)]
                    asks = np.flatnonzero(top)
                    found.append(np.stack([asks, top[asks], best[asks] + begin]))
                    counts[best, np.arange(n)] = 0
                begin = end
            q, top, where = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
            order = np.lexsort([where, -top, q])
            q, top, where = q[order], top[order], where[order]
            kept = np.arange(len(q)) - np.searchsorted(q, q) < k
            q, top, where = q[kept], top[kept], where[kept]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), b.column(doc_id).take(pa.array(where)), pa.array(top / sizes[q])], names=[query_id, doc_id, "score"])

    schema = T.StructType([queries.schema[query_id], docs.schema[doc_id], T.StructField("score", T.DoubleType())])
    return docs.select(doc_id, "fs").mapInArrow(run, schema)


def upsert(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Chunks keyed by chunk_id, the batch wins; a batch with an empty source is refused whole."""
    if not batch.filter("source_ref is null or source_ref = ''").isEmpty():
        raise ValueError("every chunk needs a source_ref")
    return existing.join(batch.select("chunk_id"), "chunk_id", "left_anti").unionByName(batch)


#: fixed values: a labelled answer, and how often labels stand in an answer key
ANSWER_LABEL = r"(?iu)(?:\b(?:answers?|solutions?)\s*[:：]|(?:เฉลย|คำตอบ)\s*[:：])"
ANSWER_LABELS, CHARS_PER_LABEL = 3, 800
#: fixed values: names of answer keys
ANSWER_KEY_NAMES = (r"answer[-_\s]?keys?", r"canonical[-_\s]?(answer|solution)", r"marking[-_\s]?scheme")


def answer_density(docs: DataFrame, label: str = ANSWER_LABEL, by: str = "source", least: int = ANSWER_LABELS, chars: int = CHARS_PER_LABEL, text: str = "text") -> DataFrame:
    """Sources refused as answer keys: ``least`` labels or more and one per ``chars`` characters.

    A source's parts count as joined by one character each.
    """
    sums = docs.groupBy(by).agg(F.sum(F.regexp_count(text, F.lit(label))).alias("labels"), (F.sum(F.length(text)) + F.count(F.lit(1)) - 1).alias("chars"))
    return sums.withColumn("refused", (F.col("labels") >= least) & (F.col("labels") * chars >= F.col("chars")))


def declares_answer_key(name: Column) -> Column:
    """Whether a source's name says that it is an answer key."""
    return name.rlike("(?iu)" + "|".join(ANSWER_KEY_NAMES))
