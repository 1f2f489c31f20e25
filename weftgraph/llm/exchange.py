"""Chunks of documents that ask reducers about sets of 64-bit keys.

Operators that need corpus-wide facts about very many keys (does this window
occur elsewhere, how often does this word occur) would shuffle one row per
key occurrence.  Instead documents are dealt into chunks of a few MB by a hash
of their id and text; a chunk sends its *distinct* keys, sorted, as one
binary value per key range, and gets an answer of the same length back.  A key
that a third of all documents share thus reaches its reducer once per chunk,
and a copy of the text crosses the network once.  Everything a chunk sends is
a function of its rows, so a task that is run again after a lost executor
sends the same bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Bytes of text in a chunk, on average: bounds a Python worker's arrays.
CHUNK_BYTES = 6 << 20
#: Keys that one reducer holds, on average.
RANGE_KEYS = 2_000_000


def text_bytes(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Number of rows and of UTF-8 bytes of their texts (one small row)."""
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    return n, size


def chunked(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, text, row_key, chunk`` with about ``chunk_bytes`` per chunk.

    The chunk comes from a hash of id and text, so copies under different ids
    spread over all chunks and reruns deal alike.
    """
    ship(docs.sparkSession)
    n = max(1, -(-size // chunk_bytes))
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), key.alias("row_key")).withColumn("chunk", F.pmod("row_key", F.lit(n)).cast("int"))


def in_order(table: pa.Table) -> pa.Table:
    """A chunk's rows in an order that does not depend on arrival."""
    return table.sort_by([("doc_id", "ascending"), ("row_key", "ascending")]).combine_chunks()


def cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of ``ranges`` equal key ranges begins in sorted ``keys``."""
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)])).astype(np.int64)


def parcels(chunk: int, keys: np.ndarray, columns: dict[str, np.ndarray], ranges: int, schema: pa.Schema) -> pa.Table:
    """One row per key range: ``range, chunk`` and each column's bytes there."""
    at = cuts(keys, ranges)
    full = [k for k in range(ranges) if at[k + 1] > at[k]]
    rows: dict[str, list] = {"range": full, "chunk": [chunk] * len(full)}
    for name, values in columns.items():
        rows[name] = [values[at[k] : at[k + 1]].tobytes() for k in full]
    return pa.table({f.name: pa.array(rows[f.name], f.type) for f in schema}, schema=schema)


def received(table: pa.Table, name: str, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All of one column's values, and where each row's values begin."""
    parts = [np.frombuffer(x, dtype) for x in table[name].to_pylist()]
    at = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), at


def answers(table: pa.Table, name: str, dtype) -> np.ndarray:
    """A chunk's answers, in the order of the sorted keys it sent."""
    rows = sorted(zip(table["range"].to_pylist(), table[name].to_pylist()))
    return np.concatenate([np.frombuffer(x, dtype) for _, x in rows]) if rows else np.zeros(0, dtype)
