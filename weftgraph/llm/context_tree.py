"""Language-model scoring by context-tree weighting over bytes.

A document is its words (A-Z lower-cased) with a space after each and an end
byte after the last; the context of a byte is the ``depth`` bytes before it in
its document.  Each byte is eight binary decisions; each decision at each
context of each length has a Krichevsky-Trofimov estimator, and from the
deepest contexts upwards a context weighs its own estimate against the product
of its extensions' (one half each a priori).  The probability of a byte mixes
all depths with the weights this gives on the training documents; at contexts
never seen the deepest seen one takes what weight is left.  The code length of
a text is minus the sum of the logarithms; ``bits_per_byte`` gives it per byte.

Beside it a unigram base score counts whole words over all training documents.

Nothing is held for the whole corpus in one place.  A chunk of documents sends
its distinct words and byte strings with training counts, dealt into ranges
(byte strings by their two nearest context bytes, so that a range has whole
subtrees) and into slices of ``SLICE`` chunks.  Groups of a range and a slice
add up, the sums of a range's slices are merged one after another into its
model, and the model answers each slice apart; so a context that every chunk
has never meets in one task with more than its distinct extensions and one
slice.  Lists of keys travel as compressed differences.  Only the nodes of depth
0 and 1, 2 * 255 * 256 numbers at most, and three totals reach the driver.

A null text is an empty one: the end alone.  A null id counts as the empty
text in the rule that holds documents out.  Repeated rows are documents of
their own; an empty table gives no rows; extra columns are ignored.  A very long text is a
chunk by itself: its arrays take some 40 times its bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import exchange, words
from .storage import cut

DEPTH = 6
HOLD_OUT = (5, 1)
END = 10
#: Nodes of fewer context bytes are shared by all ranges.
LOW = 2
#: Bytes of text in a chunk, on average: the larger, the fewer keys are sent twice.
CHUNK_BYTES = 8 << 20
#: Chunks that one group adds up and one model's copy answers.
SLICE = 128
#: Distinct keys of a range, on average, and the number of ranges at most (the rest is for slices to divide).
RANGE_KEYS = 500_000
MOST_RANGES = 1024
_WORD, _GRAM = 0, 1

_SENT = pa.schema([("kind", pa.int32()), ("range", pa.int32()), ("slice", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_SENT_SQL = "kind int, range int, slice int, chunk int, keys binary, counts binary"
_SUM = pa.schema([("kind", pa.int32()), ("range", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_SUM_SQL = "kind int, range int, keys binary, counts binary"
_BACK = pa.schema([("kind", pa.int32()), ("range", pa.int32()), ("chunk", pa.int32()), ("values", pa.binary())])
_BACK_SQL = "kind int, range int, chunk int, values binary"
_TOP_SQL = "byte int, node int, zeros double, ones double, below double, distinct_words long, all_words long"
_TOP = pa.schema([("byte", pa.int32()), ("node", pa.int32()), ("zeros", pa.float64()), ("ones", pa.float64()), ("below", pa.float64()), ("distinct_words", pa.int64()), ("all_words", pa.int64())])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function for x > 0 (Stirling's series at x + 8)."""
    y, product = x + 8.0, np.ones_like(x)
    for k in range(8):
        product = product * (x + k)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(product)


_SMALL = 4096
_HALVES, _WHOLES = log_gamma(np.arange(_SMALL) + 0.5), log_gamma(np.arange(_SMALL) + 1.0)


def _gamma_of_counts(n: np.ndarray, table: np.ndarray, add: float) -> np.ndarray:
    out = table[np.minimum(n, _SMALL - 1).astype(np.int64)]
    many = n >= _SMALL
    out[many] = log_gamma(n[many] + add)
    return out


def kt_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the KT estimator gives to these counts in any order."""
    return _gamma_of_counts(zeros, _HALVES, 0.5) + _gamma_of_counts(ones, _HALVES, 0.5) - math.log(math.pi) - _gamma_of_counts(zeros + ones, _WHOLES, 1.0)


class Stream:
    """The bytes of a block of documents as the model reads them, and their words."""

    def __init__(self, column: pa.Array | pa.ChunkedArray, depth: int):
        raw, off = words.text_buffer(column)
        buf = words.LOWER[raw]
        starts, ends, self.first = words.spans(buf, off)
        self.codes = words.word_hashes(buf, starts, ends)
        self.n_words = np.diff(self.first)
        size = ends - starts
        # each document: depth end bytes, then every word and a byte after it
        empty = (self.n_words == 0).astype(np.int64)
        before = np.cumsum(depth + empty) - empty
        shift = np.arange(len(size)) + np.repeat(before, self.n_words)
        at = np.cumsum(size) - size + shift
        total = int(size.sum() + len(size) + depth * len(empty) + empty.sum())
        data = np.full(total, END, np.uint8)
        data[np.repeat(shift, size) + np.arange(int(size.sum()))] = buf[~words.SEPARATOR[buf]]
        close = at + size
        data[close] = 32
        last = self.first[1:][self.n_words > 0] - 1
        data[close[last]] = END
        length = np.add.reduceat(size + 1, self.first[:-1][self.n_words > 0]) if len(last) else np.zeros(0, np.int64)
        self.length = np.ones(len(empty), np.int64)
        self.length[self.n_words > 0] = length
        real = np.ones(total, bool)
        head = np.cumsum(self.length + depth) - self.length - depth
        for k in range(depth):
            real[head + k] = False
        self.bytes_first = np.concatenate(([0], np.cumsum(self.length)))
        # the eight bytes before each place as one number: the nearest context byte leads
        padded = np.concatenate((np.zeros(8, np.uint8), data))
        before = np.ndarray((total,), "<u8", padded, strides=(1,))
        self.grams = (before >> np.uint64(8 * (8 - depth)) << np.uint64(8) | data)[real]

    def select(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and byte strings of the documents marked in ``docs``."""
        return self.codes[np.repeat(docs, self.n_words)], self.grams[np.repeat(docs, self.length)]


def _bins(grams: np.ndarray, depth: int, ranges: int) -> np.ndarray:
    """The reducer of each byte string: by a hash of the two nearest context bytes."""
    near = grams >> np.uint64(8 * (depth - 1))
    return (words.mix(near + np.uint64(1)) % np.uint64(ranges)).astype(np.int64)


def pack(values: np.ndarray, sorted_keys: bool = False) -> bytes:
    """Numbers (``sorted_keys``: their differences) as compressed planes of bytes, after their number."""
    if sorted_keys:
        values = np.diff(values, prepend=values.dtype.type(0))
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, dtype, sorted_keys: bool = False) -> np.ndarray:
    """What ``pack`` was given."""
    n, width = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    values = np.ascontiguousarray(planes.reshape(width, n).T).reshape(-1).view(dtype)
    return np.cumsum(values, dtype=dtype) if sorted_keys else values


def _rows(kind: int, chunk: int, bins: np.ndarray, keys: np.ndarray, counts: np.ndarray, ranges: int, slice_chunks: int) -> list[tuple]:
    order = np.argsort(bins, kind="stable")
    at = np.searchsorted(bins[order], np.arange(ranges + 1))
    k, c = keys[order], counts[order].astype(np.uint64)
    return [(kind, r, chunk // slice_chunks, chunk, pack(k[at[r] : at[r + 1]], True), pack(c[at[r] : at[r + 1]])) for r in np.flatnonzero(np.diff(at)).tolist()]


def _word_bins(keys: np.ndarray, ranges: int) -> np.ndarray:
    at = exchange.cuts(keys, ranges)
    return np.repeat(np.arange(ranges), np.diff(at))


def _as_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their numbers."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    at = np.flatnonzero(new)
    return values[at], np.diff(np.append(at, len(values)))


def _counted(values: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of both; how often each is in ``values``."""
    known, n = _distinct(values)
    if not len(others):
        return known, n
    keys, _ = _distinct(np.concatenate((known, _distinct(others)[0])))
    counts = np.zeros(len(keys), np.int64)
    counts[np.searchsorted(keys, known)] = n
    return keys, counts


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys)
    k, c = keys[order], counts[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return k[at], np.add.reduceat(c, at) if len(at) else c


class Tree:
    """The subtrees of depth ``low`` and more that sorted distinct byte strings and their counts make up.

    Byte strings of count 0 may be among them: they are asked for and change nothing.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int, low: int = LOW):
        self.depth, self.low = depth, low
        self.keys, self.counts = {depth: grams}, {depth: counts.astype(np.float64)}
        #: where a key's context without its farthest byte is among the shorter ones
        self.up: dict[int, np.ndarray] = {}
        for d in range(depth, low, -1):
            g = self.keys[d]
            self.keys[d - 1], self.up[d] = np.unique((g >> np.uint64(16) << np.uint64(8)) | (g & np.uint64(255)), return_inverse=True)
            self.counts[d - 1] = np.bincount(self.up[d], self.counts[d], len(self.keys[d - 1]))

    def decisions(self, k: int) -> tuple[dict[int, tuple], np.ndarray, np.ndarray]:
        """Decision ``k`` of all contexts: by length, the node of each key and the nodes' zeros, ones and own
        share; then the first key of each node of length ``low`` and its weighted estimate."""
        found: dict[int, tuple] = {}
        first = below = np.zeros(0)
        for d in range(self.depth, self.low - 1, -1):
            # keys are sorted by context and symbol, so the symbols of one node are neighbours
            node = self.keys[d] >> np.uint64(8 - k)
            new = np.ones(len(node), bool)
            new[1:] = node[1:] != node[:-1]
            run, at = np.cumsum(new) - 1, np.flatnonzero(new)
            bit = (self.keys[d] >> np.uint64(7 - k) & np.uint64(1)).astype(np.float64)
            ones = np.add.reduceat(self.counts[d] * bit, at)
            zeros = np.add.reduceat(self.counts[d], at) - ones
            block = kt_block(zeros, ones)
            if d == self.depth:
                weighted, own = block, np.zeros(len(at))
            else:
                extended = np.bincount(run[self.up[d + 1][first]], below, len(at))
                weighted = np.logaddexp(block, extended) - math.log(2)
                own = block - math.log(2) - weighted
            found[d] = (run, zeros, ones, own)
            first, below = at, weighted
        return found, first, below

    def top(self) -> dict[str, np.ndarray]:
        """Sums over the contexts of length ``low`` by nearest byte and decision."""
        code, sums = [], []
        for k in range(8) if len(self.keys[self.low]) else ():
            found, first, below = self.decisions(k)
            _, zeros, ones, _ = found[self.low]
            g = self.keys[self.low][first]
            node = (np.uint64(256) | (g & np.uint64(255))) >> np.uint64(8 - k)
            code.append((g >> np.uint64(8 * self.low) << np.uint64(8) | node).astype(np.int64))
            sums.append(np.stack([zeros, ones, below]))
        some, at = np.unique(np.concatenate(code or [np.zeros(0, np.int64)]), return_inverse=True)
        both = np.concatenate(sums, axis=1) if sums else np.zeros((3, 0))
        return {"byte": some >> 8, "node": some & 255} | {name: np.bincount(at, x, len(some)) for name, x in zip(("zeros", "ones", "below"), both)}

    def log_probability(self, top: "Top") -> np.ndarray:
        """Natural logarithm of the probability of each byte string's last byte after the others."""
        grams = self.keys[self.depth]
        out = np.zeros(len(grams))
        if not len(grams):
            return out
        symbol = (grams & np.uint64(255)).astype(np.int64)
        near = (grams >> np.uint64(8 * self.depth)).astype(np.int64)
        place = {self.depth: np.arange(len(grams))}
        for d in range(self.depth, self.low, -1):
            place[d - 1] = self.up[d][place[d]]
        for k in range(8):
            node, bit = (256 | symbol) >> (8 - k), symbol >> (7 - k) & 1
            found, _, _ = self.decisions(k)
            p, last, left = np.zeros(len(grams)), np.full(len(grams), 0.5), np.ones(len(grams))
            levels = [top.at(0, near, node), top.at(1, near, node)]
            for d in range(self.low, self.depth + 1):
                run, zeros, ones, own = found[d]
                at = run[place[d]]
                levels.append((zeros[at], ones[at], own[at]))
            for zeros, ones, own in levels:
                n = zeros + ones
                here = (np.where(bit == 1, ones, zeros) + 0.5) / (n + 1)
                # what is left goes to the deepest context that was seen
                weight = np.where(n > 0, np.exp(own), 0.0)
                p += left * weight * here
                left = left * (1 - weight)
                last = np.where(n > 0, here, last)
            out += np.log(p + left * last)
        return out


class Top:
    """The nodes of depth 0 and 1, as arrays by nearest byte and decision."""

    def __init__(self, rows: list[tuple]):
        self.zeros, self.ones, below = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
        for byte, node, zeros, ones, under in rows:
            self.zeros[byte, node], self.ones[byte, node], below[byte, node] = zeros, ones, under
        block = kt_block(self.zeros, self.ones)
        weighted = np.logaddexp(block, below) - math.log(2)
        self.own = block - math.log(2) - weighted
        self.zeros0, self.ones0 = self.zeros.sum(axis=0), self.ones.sum(axis=0)
        block0 = kt_block(self.zeros0, self.ones0)
        self.own0 = block0 - np.logaddexp(block0, weighted.sum(axis=0))

    def at(self, d: int, near: np.ndarray, node: np.ndarray):
        if d == 0:
            return self.zeros0[node], self.ones0[node], self.own0[node]
        return self.zeros[near, node], self.ones[near, node], self.own[near, node]


def held_out(id_text, hold_out: tuple[int, int] = HOLD_OUT):
    modulus, rest = hold_out
    return F.crc32(F.coalesce(id_text.cast("string"), F.lit(""))) % modulus == rest


def _ranges(size: int) -> int:
    return min(MOST_RANGES, max(1, -(-size // 24 // RANGE_KEYS)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [_sums(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))]


def add_up(asked: DataFrame) -> DataFrame:
    """``kind, range, keys, counts``: a row per range, with its distinct training keys and their sums.

    ``asked`` is grouped by range and slice first; then the sums of a range's
    slices are merged one after another, so that a task holds distinct keys only.
    """

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        waiting = 0
        for b in batches:
            for k, c in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist()):
                keys, counts = unpack(k, np.uint64, True), unpack(c, np.uint64)
                parts.append((keys[counts > 0], counts[counts > 0]))
                waiting += len(keys)
                if waiting > max(1 << 20, len(parts[0][0])):
                    parts, waiting = _merged(parts), 0
        keys, counts = _merged(parts)[0]
        yield _as_batch([(key[0].as_py(), key[1].as_py(), pack(keys, True), pack(counts))], _SUM)

    by_slice = asked.groupBy("kind", "range", "slice").applyInArrow(merge, _SUM_SQL)
    return by_slice.groupBy("kind", "range").applyInArrow(merge, _SUM_SQL)


def tops(sums: DataFrame, depth: int) -> tuple[Top, int, int]:
    """Depth 0 and 1 of the tree; the numbers of training words and of distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind, k, c in zip(*(b.column(x).to_pylist() for x in ("kind", "keys", "counts"))):
                keys, counts = unpack(k, np.uint64, True), unpack(c, np.uint64)
                if kind == _WORD:
                    yield _as_batch([(0, -1, 0.0, 0.0, 0.0, len(keys), int(counts.sum()))], _TOP)
                    continue
                top = Tree(keys, counts, depth).top()
                n = len(top["node"])
                yield pa.record_batch([pa.array(top[f.name], f.type) for f in list(_TOP)[:5]] + [pa.array(np.zeros(n, np.int64))] * 2, schema=_TOP)

    totals = [F.sum(c).alias(c) for c in ("zeros", "ones", "below", "distinct_words", "all_words")]
    rows = sums.select("kind", "keys", "counts").mapInArrow(run, _TOP_SQL).groupBy("byte", "node").agg(*totals).collect()  # 65,281 rows at most
    counted = next((r for r in rows if r.node < 0), None)
    top = Top(sorted((r.byte, r.node, r.zeros, r.ones, r.below) for r in rows if r.node >= 0))
    return top, *((counted.all_words, counted.distinct_words) if counted else (0, 0))


def score(docs: DataFrame, depth: int = DEPTH, hold_out: tuple[int, int] = HOLD_OUT, id_col: str = "doc_id", text_col: str = "text", slice_chunks: int = SLICE) -> DataFrame:
    """Base and model scores of all rows of ``docs``, learnt from those not held out.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    n_bytes, bits_per_byte``.  ``docs`` is read more than once and should be a
    table or another plan that returns the same rows each time.
    """
    if not LOW <= depth <= 7:
        raise ValueError(f"contexts have {LOW} to 7 bytes")
    spark = docs.sparkSession
    ship(spark)
    _, size = exchange.text_bytes(docs, text_col)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_ends = plain.filter(~held_out(F.col("doc_id"), hold_out)).count()
    ranges = _ranges(size)
    text = exchange.chunked(plain, size, chunk_bytes=CHUNK_BYTES).withColumn("held", held_out(F.col("doc_id"), hold_out))

    def listed(table: pa.Table):
        table = exchange.in_order(table)
        s = Stream(table["text"], depth)
        held = table["held"].combine_chunks().to_numpy(zero_copy_only=False)
        (tw, tg), (hw, hg) = s.select(~held), s.select(held)
        return table, s, held, _counted(tw, hw), _counted(tg, hg)

    def ask(table: pa.Table) -> pa.Table:
        table, s, _, (wk, wc), (gk, gc) = listed(table)
        chunk = table["chunk"][0].as_py()
        return _as_table(_rows(_WORD, chunk, _word_bins(wk, ranges), wk, wc, ranges, slice_chunks) + _rows(_GRAM, chunk, _bins(gk, depth, ranges), gk, gc, ranges, slice_chunks), _SENT)

    # written once, for the sums and for the answers
    asked = cut(text.groupBy("chunk").applyInArrow(ask, _SENT_SQL))
    sums = cut(add_up(asked))
    top, n_words, n_distinct = tops(sums, depth)
    n, v = n_words + n_ends, n_distinct + (n_ends > 0)
    shared = spark.sparkContext.broadcast(top)  # 256 x 256 nodes

    def answer(key: tuple, table: pa.Table, sums: pa.Table) -> pa.Table:
        kind, r = key[0].as_py(), key[1].as_py()
        wanted = [unpack(x, np.uint64, True) for x in table["keys"].to_pylist()]
        some, _ = _distinct(np.concatenate(wanted)) if wanted else (np.zeros(0, np.uint64), None)
        known = unpack(sums["keys"][0].as_py(), np.uint64, True) if len(sums) else np.zeros(0, np.uint64)
        counts = unpack(sums["counts"][0].as_py(), np.uint64) if len(sums) else np.zeros(0, np.uint64)
        keys, _ = _distinct(np.concatenate((known, some)))
        total = np.zeros(len(keys), np.uint64)
        total[np.searchsorted(keys, known)] = counts
        values = total if kind == _WORD else Tree(keys, total, depth).log_probability(shared.value).astype(np.float32)
        return _as_table([(kind, r, c, pack(values[np.searchsorted(keys, w)])) for c, w in zip(table["chunk"].to_pylist(), wanted)], _BACK)

    result = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()), ("bits_per_byte", pa.float64())])
    least = math.log10(n + 0.5 * (v + 1)) if n else math.log10(0.5)

    def told(replies: pa.Table, kind: int, bins: np.ndarray) -> np.ndarray:
        """A chunk's answers, put back into the order of its sorted keys."""
        mine = sorted((r, x) for k, r, x in zip(*(replies[c].to_pylist() for c in ("kind", "range", "values"))) if k == kind)
        out = np.empty(len(bins))
        out[np.argsort(bins, kind="stable")] = np.concatenate([unpack(x, np.uint64 if kind == _WORD else np.float32) for _, x in mine]) if mine else np.zeros(0)
        return out

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        table, s, held, (wk, _), (gk, _) = listed(table)
        count = told(replies, _WORD, _word_bins(wk, ranges))
        at = words.Index(wk).find(s.codes)
        known = words.totals((count > 0).astype(np.int64)[at], s.first) + (n_ends > 0)
        tokens = s.n_words + 1
        base = words.totals(np.log10(count + 0.5)[at], s.first) + math.log10(n_ends + 0.5) - tokens * least
        value = told(replies, _GRAM, _bins(gk, depth, ranges)) / math.log(10)
        model = words.totals(value[words.Index(gk).find(s.grams)], s.bytes_first)
        bits = -model / math.log10(2) / s.length
        columns = [table["doc_id"].combine_chunks(), pa.array(held), pa.array(tokens), pa.array(known), pa.array(np.full(len(held), n)), pa.array(base), pa.array(model), pa.array(s.length), pa.array(bits)]
        return pa.table(columns, schema=result)

    # a range's sums go to each slice that asks
    by, of = ("kind", "range", "slice"), ("of_kind", "of_range", "of_slice")
    slices = asked.select(*(F.col(c).alias(x) for c, x in zip(by, of))).distinct()
    models = slices.join(sums, (F.col("of_kind") == F.col("kind")) & (F.col("of_range") == F.col("range"))).select(*of, "keys", "counts")
    replies = asked.groupBy(*by).cogroup(models.groupBy(*of)).applyInArrow(answer, _BACK_SQL)
    return text.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")


def brute_force(rows: list[tuple[int, str | None]], held: list[bool], depth: int = DEPTH) -> list[float]:
    """Log10 probabilities from an explicit tree, decision by decision, for tests."""
    from functools import cache

    streams = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        streams.append(b"\n" * depth + (b" ".join(w) + b"\n"))
    counts: dict[tuple[bytes, int], list[int]] = {}
    longer: dict[tuple[bytes, int], set[bytes]] = {}
    for s, h in zip(streams, held):
        for i in range(depth, len(s)):
            for k in range(8):
                node, bit = (256 | s[i]) >> (8 - k), s[i] >> (7 - k) & 1
                for d in range(depth + 1):
                    if not h:
                        c = s[i - d : i]
                        counts.setdefault((c, node), [0, 0])[bit] += 1
                        if d < depth:
                            longer.setdefault((c, node), set()).add(s[i - d - 1 : i])

    def block(n0: int, n1: int) -> float:
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.log(math.pi) - math.lgamma(n0 + n1 + 1)

    @cache
    def weighted(c: bytes, node: int) -> float:
        own = block(*counts[c, node])
        if len(c) == depth:
            return own
        rest = sum(weighted(x, node) for x in longer[c, node])
        return math.log(0.5) + max(own, rest) + math.log1p(math.exp(-abs(own - rest)))

    @cache
    def chance(c: bytes, node: int, bit: int) -> float:
        p, left, last = 0.0, 1.0, 0.5
        for d in range(depth + 1):
            ctx = c[depth - d :]
            if (ctx, node) not in counts:
                break
            n = counts[ctx, node]
            last = (n[bit] + 0.5) / (sum(n) + 1)
            share = 1.0 if d == depth else math.exp(math.log(0.5) + block(*n) - weighted(ctx, node))
            p += left * share * last
            left *= 1 - share
        return p + left * last

    return [sum(math.log10(chance(s[i - depth : i], (256 | s[i]) >> (8 - k), s[i] >> (7 - k) & 1)) for i in range(depth, len(s)) for k in range(8)) for s in streams]
