"""Substring dedup: difference-cover anchors, then extension to whole windows.

A word is removed when it lies in a window of ``window`` consecutive words of
one document whose word sequence also starts anywhere else.

With a difference cover D modulo v, two equal windows starting at any places i
and j share an offset d < v with i + d and j + d both in D (modulo v).  So it
is enough to hash shorter windows of ``window - v + 1`` words at cover
positions (5 of 21): a long match always shows two equal anchors.  Anchors
that occur once are dropped; around the others, and only there, the matches
are extended to whole windows, which are compared by 96-bit hashes.

Nulls and texts without words give n_words 0 and the digest of the empty
string; repeated rows are documents of their own and match each other (rows that
repeat id and text are dealt to one chunk); an empty table gives no rows; extra
columns are ignored.  Of equal windows all are removed, so there are no ties.  A
very long text is a chunk by itself: its arrays take some 40 times its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange, words

WINDOW = 35
PERIOD = 21
#: A perfect difference set: each residue modulo 21 is a difference of two.
COVER = (3, 6, 7, 12, 14)

_ASK = pa.schema([("range", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("multi", pa.binary())])
_ASK_SQL = "range int, chunk int, keys binary, more binary, multi binary"
_TELL = pa.schema([("range", pa.int32()), ("chunk", pa.int32()), ("hits", pa.binary())])
_TELL_SQL = "range int, chunk int, hits binary"


class _Chunk:
    """The words of a chunk and what its anchors and windows hash to."""

    def __init__(self, table: pa.Table, window: int, period: int, cover: tuple[int, ...]):
        self.table = exchange.in_order(table)
        self.chunk = self.table["chunk"][0].as_py()
        self.buf, self.off = words.text_buffer(self.table["text"])
        self.starts, self.ends, self.first = words.spans(self.buf, self.off)
        self.codes = words.word_hashes(self.buf, self.starts, self.ends)
        self.window, self.period, self.cover = window, period, cover

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the anchors and their hashes."""
        size, n = self.window - self.period + 1, len(self.codes)
        whole = words.within(self.first, n, size)
        place = np.arange(n) - np.repeat(self.first[:-1], np.diff(self.first))
        long_enough = np.repeat(np.diff(self.first) >= self.window, np.diff(self.first))
        chosen = np.isin(np.arange(self.period), self.cover)[place % self.period] & long_enough
        at = np.flatnonzero(whole & chosen[: len(whole)])
        return at, words.window_hashes(self.codes, size)[at]

    def candidates(self, hot: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a hot anchor within their first period."""
        n = len(self.codes)
        mark = np.zeros(n + 1, np.int32)
        np.add.at(mark, np.maximum(hot - self.period + 1, 0), 1)
        np.add.at(mark, hot + 1, -1)
        near = np.cumsum(mark)[:n] > 0
        whole = words.within(self.first, n, self.window)
        return np.flatnonzero(near[: len(whole)] & whole)

    def window_keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = words.window_hashes(self.codes, self.window)[at]
        b = words.window_hashes(words.mix(self.codes ^ np.uint64(0x5851F42D4C957F2D)), self.window)[at]
        return a, (b >> np.uint64(32)).astype(np.uint32)


def _distinct(keys: np.ndarray, more: np.ndarray | None):
    """Sorted distinct keys: (keys, more, occurs more than once, index of each input)."""
    order = np.argsort(keys, kind="stable") if more is None else np.lexsort((more, keys))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    m = np.zeros(0, np.uint32)
    if more is not None:
        m = more[order]
        new[1:] |= m[1:] != m[:-1]
    group = np.cumsum(new) - 1
    index = np.empty(len(k), np.int64)
    index[order] = group
    multi = np.bincount(group, minlength=int(group[-1]) + 1 if len(group) else 0) > 1
    return k[new], m[new] if more is not None else m, multi.astype(np.uint8), index


def _ask(chunk: int, keys, more, multi, ranges: int) -> pa.Table:
    wide = more if len(more) else np.zeros(len(keys), np.dtype("V0"))
    return exchange.parcels(chunk, keys, {"keys": keys, "more": wide, "multi": multi}, ranges, _ASK)


def _repeated(table: pa.Table) -> pa.Table:
    """A reducer: which of the keys each chunk sent occur more than once."""
    table = table.sort_by("chunk")
    keys, at = exchange.received(table, "keys", np.uint64)
    more, _ = exchange.received(table, "more", np.uint32)
    multi, _ = exchange.received(table, "multi", np.uint8)
    _, _, shared, index = _distinct(keys, more if len(more) else None)
    some = np.zeros(len(shared), np.uint8)
    np.maximum.at(some, index[multi > 0], 1)
    hits = ((shared > 0) | (some > 0))[index]
    rows = [np.packbits(hits[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
    return pa.table({"range": table["range"].combine_chunks(), "chunk": table["chunk"].combine_chunks(), "hits": pa.array(rows, pa.binary())}, schema=_TELL)


def _hits(told: pa.Table, keys: np.ndarray, ranges: int) -> np.ndarray:
    """Unpack a chunk's answers along the keys it sent."""
    at, out = exchange.cuts(keys, ranges), np.zeros(len(keys), bool)
    for k, bits in zip(told["range"].to_pylist(), told["hits"].to_pylist()):
        out[at[k] : at[k + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8))[: at[k + 1] - at[k]]
    return out


def deduplicate(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` for each row of ``docs``.

    ``docs`` is read again by later stages, so it should be a table or another
    plan that returns the same rows each time.  ``window`` must exceed
    ``period``, and ``cover`` must be a difference cover modulo ``period``.
    """
    if window <= period or {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("the window must exceed the period, and the cover must give every difference")
    _, size = exchange.text_bytes(docs, text_col)
    ranges = max(1, -(-size // 6 * len(cover) // period // exchange.RANGE_KEYS))
    ranges_b = max(1, -(-size // 12 // exchange.RANGE_KEYS))
    text = exchange.chunked(docs, size, id_col, text_col)
    shape = (window, period, cover)

    def send_anchors(table: pa.Table) -> pa.Table:
        c = _Chunk(table, *shape)
        keys, more, multi, _ = _distinct(c.anchors()[1], None)
        return _ask(c.chunk, keys, more, multi, ranges)

    def hot_windows(c: _Chunk, told: pa.Table):
        at, hashes = c.anchors()
        keys, _, _, index = _distinct(hashes, None)
        starts = c.candidates(at[_hits(told, keys, ranges)[index]])
        return starts, _distinct(*c.window_keys(starts))

    def send_windows(table: pa.Table, told: pa.Table) -> pa.Table:
        c = _Chunk(table, *shape)
        _, (keys, more, multi, _) = hot_windows(c, told)
        return _ask(c.chunk, keys, more, multi, ranges_b)

    result = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def remove(table: pa.Table, told: pa.Table) -> pa.Table:
        c = _Chunk(table, *shape)
        step = told["step"].to_numpy()
        starts, (keys, _, _, index) = hot_windows(c, told.filter(pa.array(step == 0)))
        starts = starts[_hits(told.filter(pa.array(step == 1)), keys, ranges_b)[index]]
        mark = np.zeros(len(c.codes) + 1, np.int32)
        np.add.at(mark, starts, 1)
        np.add.at(mark, starts + window, -1)
        gone = np.cumsum(mark)[:-1] > 0
        lost = words.totals(gone.astype(np.int64), c.first)
        raw, kept = c.buf.tobytes(), []
        for d in range(len(c.off) - 1):
            own = raw[c.off[d] : c.off[d + 1]].split()
            if lost[d]:
                own = [own[i] for i in np.flatnonzero(~gone[c.first[d] : c.first[d + 1]])]
            kept.append(b" ".join(own))
        return pa.table({"doc_id": c.table["doc_id"], "n_words": np.diff(c.first), "n_removed": lost, "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}, schema=result)

    anchors = text.groupBy("chunk").applyInArrow(send_anchors, _ASK_SQL)
    hot = anchors.groupBy("range").applyInArrow(_repeated, _TELL_SQL)
    windows = text.groupBy("chunk").cogroup(hot.groupBy("chunk")).applyInArrow(send_windows, _ASK_SQL)
    twice = windows.groupBy("range").applyInArrow(_repeated, _TELL_SQL)
    told = hot.withColumn("step", F.lit(0)).unionByName(twice.withColumn("step", F.lit(1)))
    return text.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept_text string")


def digests(kept: DataFrame) -> DataFrame:
    """The query's columns: ``kept_text`` as its SHA-256."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The definition, directly, for tests."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    seen: dict[tuple, int] = {}
    for _, w in split:
        for k in range(len(w) - window + 1):
            seen[tuple(w[k : k + window])] = seen.get(tuple(w[k : k + window]), 0) + 1
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out
