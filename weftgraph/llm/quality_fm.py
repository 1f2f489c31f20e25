"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

    y = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

The pairwise sum is taken in linear time as half of
``|sum_i v_i x_i|**2 - sum_i |v_i x_i|**2``.  Features of a document are its
words (lower-cased, hashed to ``BUCKETS``; damped counts of unit length), 14
structure statistics of the text and two of its stored length (``n_chars``),
standardised on the training rows.  Labels, language, source and id are never
read into a feature.

The machine is fitted on the driver by AdaGrad on a sample of at most
``per_class`` labelled rows of each class (``PER_CLASS``; only their sparse
features are gathered) and has a fixed size, ``(BUCKETS + 16) * (RANK + 1)``
numbers, which are broadcast.  Scoring maps over whole texts; nothing is
shuffled.

Nulls: a null text is an empty one, a null ``n_chars`` is 0, a null id is
scored and never held out unless crc32 of the empty text says so.  Without
labelled rows of both classes each score is the smoothed share of label 1.
Repeated rows are scored alike and teach once, an empty table gives no rows, extra
columns are ignored; the sample takes ids and texts in the order of their hashes,
so ties can't change it.  A very long text takes some 100 bytes a word while it
is scored and at most ``BUCKETS`` entries of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import labelled, words

BUCKETS = 1 << 16
RANK = 8
PER_CLASS = 3000
EPOCHS = 6
HOLD_OUT = (3, 1)
THRESHOLD = 0.5
#: Bytes of text scored at once: a worker keeps the pages of its largest block until it ends.
BLOCK = 256 << 10

_KINDS = np.zeros(256, np.uint8)  # kinds of bytes
_KINDS[65:91], _KINDS[97:123], _KINDS[128:], _KINDS[48:58] = 1, 2, 2, 3
_KINDS[[ord(c) for c in "#*$%&<>"]], _KINDS[ord("!")], _KINDS[ord("|")] = 4, 5, 6
_KINDS[[ord(c) for c in ".,;:?"]] = 7
STATISTICS = 16


def features(column: pa.Array, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per document: first entry; all entries' buckets and values; the statistics."""
    buf, off = words.text_buffer(column)
    starts, ends, first = words.spans(buf, off)
    codes = words.word_hashes(words.LOWER[buf], starts, ends)
    n, docs = np.diff(first), len(off) - 1
    doc = words.document_of(first)
    bucket = (codes >> np.uint64(48)).astype(np.int64) % BUCKETS
    keys, counts = np.unique(doc * BUCKETS + bucket, return_counts=True)
    at = np.searchsorted(keys, np.arange(docs + 1) * BUCKETS)
    value = 1 + np.log(counts)
    norm = np.sqrt(np.maximum(words.totals(value * value, at), 1e-9))
    value = value / np.repeat(norm, np.diff(at))

    kind = _KINDS[buf]
    share = np.maximum(np.diff(off), 1)
    of_kind = [words.totals((kind == k).astype(np.int64), off) / share for k in range(1, 8)]
    some = np.maximum(n, 1)
    length = words.totals(ends - starts, first) / some
    same = np.zeros(len(codes), np.int64)
    if len(codes) > 1:
        same[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    top = np.zeros(docs)
    np.maximum.at(top, keys // BUCKETS, counts)
    lines = words.totals((buf == 10).astype(np.int64), off)
    stats = np.stack([
        np.log1p(n), length, *of_kind, np.diff(at) / np.sqrt(some), words.totals(same, first) / some, top / some, np.log1p(lines), lines / some,
        np.log1p(np.maximum(n_chars, 0)), np.maximum(n_chars, 0) / share,
    ], axis=1)
    return at, keys % BUCKETS, value, stats


class Machine:
    """Weights of the machine and the scale of its statistics."""

    def __init__(self, seed: int = 7):
        size = BUCKETS + STATISTICS
        self.bias = 0.0
        self.w = np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.01, (size, RANK))
        self.mean, self.scale = np.zeros(STATISTICS), np.ones(STATISTICS)

    def entries(self, at: np.ndarray, index: np.ndarray, value: np.ndarray, stats: np.ndarray):
        """The sparse rows with the standardised statistics after each document's words."""
        n = len(at) - 1
        z = np.clip((stats - self.mean) / self.scale, -4, 4) / np.sqrt(STATISTICS)
        where = np.repeat(at[1:], STATISTICS)
        i = np.insert(index, where, np.tile(np.arange(BUCKETS, BUCKETS + STATISTICS), n))
        x = np.insert(value, where, z.ravel())
        return at + STATISTICS * np.arange(n + 1), i, x

    def raw(self, at: np.ndarray, index: np.ndarray, value: np.ndarray):
        """y and the factor sums of each row, by the sum-of-squares identity."""
        vx = self.v[index] * value[:, None]
        s = np.add.reduceat(vx, at[:-1], axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), at[:-1])
        y = self.bias + np.add.reduceat(self.w[index] * value, at[:-1]) + 0.5 * ((s * s).sum(axis=1) - squares)
        return y, s, vx

    def fit(self, rows: list[tuple], labels: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5, batch: int = 64) -> "Machine":
        stats = np.stack([r[2] for r in rows])
        self.mean, self.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
        g_w, g_v, g_b = np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        rng = np.random.default_rng(11)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                sizes = np.array([len(rows[k][0]) for k in pick])
                at = np.concatenate(([0], np.cumsum(sizes)))
                at, i, x = self.entries(at, np.concatenate([rows[k][0] for k in pick]), np.concatenate([rows[k][1] for k in pick]), stats[pick])
                y, s, vx = self.raw(at, i, x)
                d = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[pick]) * weight[pick] / len(pick)
                row = np.repeat(np.arange(len(pick)), np.diff(at))
                some, back = np.unique(i, return_inverse=True)
                dw = np.bincount(back, d[row] * x, len(some)) + decay * self.w[some]
                grad = (d[row] * x)[:, None] * (s[row] - vx)
                dv = np.stack([np.bincount(back, grad[:, f], len(some)) for f in range(RANK)], axis=1) + decay * self.v[some]
                g_w[some] += dw * dw
                g_v[some] += dv * dv
                g_b += d.sum() ** 2
                self.w[some] -= rate * dw / np.sqrt(g_w[some])
                self.v[some] -= rate * dv / np.sqrt(g_v[some])
                self.bias -= rate * d.sum() / np.sqrt(g_b)
        return self

    def score(self, column: pa.Array, n_chars: np.ndarray) -> np.ndarray:
        at, index, value, stats = features(column, n_chars)
        y, _, _ = self.raw(*self.entries(at, index, value, stats))
        return 1 / (1 + np.exp(-np.clip(y, -30, 30)))


def _chars(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)


def _with_length(docs: DataFrame, chars_col: str):
    return (F.col(chars_col) if chars_col in docs.columns else F.lit(0)).cast("long").alias("n_chars")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", hold_out: tuple[int, int] = HOLD_OUT, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> Machine | float:
    """A fitted machine, or the constant score where one class has no rows."""
    ship(docs.sparkSession)
    chosen = labelled.sample(docs, labels, label, *hold_out, per_class, id_col, text_col)
    plain = chosen.select(F.col(text_col).cast("string").alias("text"), _with_length(docs, chars_col), "_label")
    out = pa.schema([("label", pa.int32()), ("index", pa.binary()), ("value", pa.binary()), ("stats", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in words.slices(b.column(0), BLOCK):
                at, i, x, stats = features(b.column(0).slice(lo, hi - lo), _chars(b.column(1))[lo:hi])
                ends = list(zip(at[:-1], at[1:]))
                yield pa.record_batch([b.column(2).slice(lo, hi - lo), pa.array([i[p:q].astype(np.uint16).tobytes() for p, q in ends], pa.binary()), pa.array([x[p:q].astype(np.float32).tobytes() for p, q in ends], pa.binary()), pa.array([r.tobytes() for r in stats], pa.binary())], schema=out)

    # at most per_class rows of each class; in a fixed order
    got = sorted(plain.mapInArrow(run, "label int, index binary, value binary, stats binary").collect())
    y = np.array([r.label for r in got], float)
    if len(got) == 0 or y.min() == y.max():
        return float((y.sum() + 1) / (len(got) + 2))
    rows = [(np.frombuffer(r["index"], np.uint16).astype(np.int64), np.frombuffer(r["value"], np.float32).astype(float), np.frombuffer(r["stats"])) for r in got]
    weight = np.where(y == 1, 0.5 * len(y) / y.sum(), 0.5 * len(y) / (len(y) - y.sum()))
    return Machine().fit(rows, y, weight)


def _scored(docs: DataFrame, labels: DataFrame, label: str, hold_out: tuple[int, int], id_col: str, text_col: str, chars_col: str, **options) -> Column:
    """The score as a column of ``docs``: Python gets the text and its length and gives a number back."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, hold_out, id_col=id_col, text_col=text_col, chars_col=chars_col, **options))

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        machine = model.value
        for text, chars in batches:
            if isinstance(machine, float):
                yield pa.array(np.full(len(text), machine))
                continue
            parts = [machine.score(text.slice(lo, hi - lo), _chars(chars.slice(lo, hi - lo))) for lo, hi in words.slices(text, BLOCK)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return run(F.col(text_col).cast("string"), _with_length(docs, chars_col))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", hold_out: tuple[int, int] = HOLD_OUT, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row."""
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), _scored(docs, labels, label, hold_out, id_col, text_col, chars_col, **options).alias("score"))
    return scored.select("doc_id", (labelled.remainder(F.col("doc_id"), hold_out[0]) == hold_out[1]).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, label: str = "quality", hold_out: tuple[int, int] = HOLD_OUT, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", **options) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, columns unchanged."""
    return docs.filter(_scored(docs, labels, label, hold_out, id_col, text_col, chars_col, **options) >= threshold)
