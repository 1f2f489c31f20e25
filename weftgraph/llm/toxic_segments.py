"""Toxicity by maximum-scoring segments over token log-odds.

Tokens are runs of letters and digits, lower-cased; each has its own log-odds
and those of its first ``PREFIX`` bytes, which serve inflected and unseen forms.
The log-odds of toxic against other texts are smoothed by an informative
Dirichlet prior (the pooled frequencies, and ``FLOOR`` for each token), and a
token scores what is left of them, of either sign, after ``BOUND`` standard
errors; so what is rare or means little scores nothing, and words of harmless
texts speak against a passage.  All other tokens share one slightly negative
score.  A token counts in a class as often as it is in different texts or after
different tokens, whichever is less: neither a text with one word a hundred
times nor a text that was varied a thousand times teaches more than its share.
A prefix scores what both its occurrences and its different tokens say, so that
one common word doesn't speak for all that begin like it.  In a text the k-th
occurrence of a token scores one k-th, as words come in bursts.

A linear scan finds all maximal scoring segments of a text (every segment that
can't be improved by growing or shrinking).  Under the null model the best
segment of n tokens has the extreme-value tail 1 - exp(-K n exp(-lambda S)), a
Gumbel distribution of scale 1 / lambda around log(K n) / lambda; both numbers
are fitted by maximum likelihood to the best segments of harmless calibration
rows, of which the upper ``TAIL`` counts by value and the rest as being below.  The tails of the
significant segments are combined as in Fisher's method, and a logistic curve
fitted on calibration rows turns this into a probability.

The fit uses at most ``PER_CLASS`` labelled rows of each class; their token
counts are summed by Spark, of which ``MOST_TOKENS`` at most reach the driver,
and of each calibration row two numbers.  The model is broadcast.  Labels,
language, source and id are never inputs.  Null texts have no tokens; without
labelled rows of both classes each score is the smoothed share of label 1;
repeated rows are scored alike and teach once; equally strong tokens are taken
in the order of their hashes; an empty table gives no rows; extra columns are
ignored.  A very long text takes some 100 bytes a token while it is scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import labelled, words
from .storage import cut

PER_CLASS = 4000
MOST_TOKENS = 50_000
PREFIX = 4
PRIOR = 1000.0
FLOOR = 0.5
BOUND = 2.0
HOLD_OUT = (4, 2)
THRESHOLD = 0.3
#: A segment this likely by chance or less counts as evidence.
SIGNIFICANT = 0.01
#: Share of the harmless calibration rows whose best scores make up the tail.
TAIL = 0.1
#: Share of rows whose label may be wrong.
LAPSE = 0.003
#: One in so many rows of a class calibrates.
CALIBRATE = 4

NOT_TOKEN = np.ones(256, bool)
NOT_TOKEN[48:58] = NOT_TOKEN[65:91] = NOT_TOKEN[97:123] = NOT_TOKEN[128:] = False
_PREFIX_SALT = np.uint64(0x632BE59BD9B4E019)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First token of each text, token hashes, prefix hashes, and byte spans in the texts."""
    raw, off = words.text_buffer(column)
    buf = words.LOWER[raw]
    # capital letters of the Latin-1 supplement, as UTF-8
    high = np.flatnonzero((buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97) & (buf[:-1] == 0xC3)) + 1 if len(buf) > 1 else np.zeros(0, np.int64)
    buf[high] += 32
    starts, ends, first = words.spans(buf, off, NOT_TOKEN)
    heads = np.minimum(ends, starts + PREFIX)
    stems = np.where(ends - starts >= PREFIX, words.word_hashes(buf, starts, heads) ^ _PREFIX_SALT, np.uint64(0))
    return first, words.word_hashes(buf, starts, ends), stems, starts, ends


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, stop, score)`` in one pass.

    Candidates are kept on a stack with the running totals at their ends; a new
    positive score is merged with earlier candidates for as long as that raises
    its total, and each merge removes a candidate, so the work is linear.
    """
    stack: list[tuple[int, int, float, float]] = []  # start, stop, total before, total after
    links: list[int] = []  # nearest candidate below with a smaller total before
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, lo, hi = i, before, total
        k = len(stack) - 1
        while True:
            while k >= 0 and stack[k][2] >= lo:
                k = links[k]
            if k < 0 or stack[k][3] >= hi:
                break
            start, lo = stack[k][0], stack[k][2]
            del stack[k:], links[k:]
            k = len(stack) - 1
        stack.append((start, i + 1, lo, hi))
        links.append(k)
    return [(a, b, y - x) for a, b, x, y in stack]


class Model:
    """Scores of the tokens that matter, of all others, and the calibration."""

    def __init__(self):
        self.keys, self.scores = np.zeros(0, np.uint64), np.zeros(0)
        self.rest, self.rate, self.k = -1.0, 1.0, 1.0
        self.offset, self.slope = 0.0, 1.0

    def token_scores(self, codes: np.ndarray, stems: np.ndarray) -> np.ndarray:
        """Of each token: its own score or its prefix's, whichever says more, else the common one."""
        known = np.zeros(len(codes))
        if len(self.keys):
            for keys in (stems, codes):
                at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                here = np.where(self.keys[at] == keys, self.scores[at], 0.0)
                known = np.where(np.abs(here) > np.abs(known), here, known)
        return np.where(known == 0, self.rest, known)

    def text_scores(self, first: np.ndarray, codes: np.ndarray, stems: np.ndarray) -> np.ndarray:
        """``token_scores`` of texts, later occurrences of positive tokens damped."""
        out = self.token_scores(codes, stems)
        hot = np.flatnonzero(out > 0)
        if len(hot):
            doc = np.searchsorted(first, hot, "right") - 1
            order = np.lexsort((hot, codes[hot], doc))
            d, c = doc[order], codes[hot][order]
            new = np.ones(len(order), bool)
            new[1:] = (d[1:] != d[:-1]) | (c[1:] != c[:-1])
            begin = np.flatnonzero(new)
            out[hot[order]] /= np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order)))) + 1
        return out

    def segments(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """Maximal segments of one text; runs of the common score enter as one."""
        hot = np.flatnonzero(scores > 0)
        if not len(hot):
            return []
        sums = np.concatenate(([0.0], np.cumsum(scores)))
        compact: list[float] = []
        place: list[int] = []
        last = 0
        for h in hot.tolist():
            if h > last:
                compact.append(float(sums[h] - sums[last]))
                place.append(last)
            compact.append(float(scores[h]))
            place.append(h)
            last = h + 1
        place.append(last)
        return [(place[a], place[b - 1] + 1, s) for a, b, s in maximal_segments(compact)]

    def tail(self, n: int, score: float) -> float:
        """The chance that ``n`` tokens of harmless text have a segment of ``score`` or more."""
        return -math.expm1(-self.k * n * math.exp(-min(self.rate * score, 700.0)))

    def best(self, first: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The score of each text's best segment; 0 where no token is positive."""
        return np.array([max((s for _, _, s in self.segments(scores[a:b])), default=0.0) for a, b in zip(first[:-1], first[1:])])

    def evidence(self, first: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Combined evidence of each text and its significant segments (start, stop, chance)."""
        x, found = np.zeros(len(first) - 1), []
        hot = words.totals((scores > 0).astype(np.int64), first)
        for d in range(len(x)):
            own = []
            if hot[d]:
                n = int(first[d + 1] - first[d])
                for a, b, s in self.segments(scores[first[d] : first[d + 1]]):
                    tail = self.tail(n, s)
                    if tail <= SIGNIFICANT:
                        own.append((a, b, tail))
                        x[d] -= math.log(max(tail, 1e-300))
            found.append(own)
        return np.log1p(x), found

    def probability(self, x: np.ndarray) -> np.ndarray:
        return LAPSE + (1 - 2 * LAPSE) / (1 + np.exp(-np.clip(self.offset + self.slope * x, -30, 30)))


def log_odds(toxic: np.ndarray, other: np.ndarray, totals: tuple[float, float]) -> np.ndarray:
    """What is left of each token's log-odds after ``BOUND`` standard errors, towards zero."""
    y, n = toxic.astype(float), other.astype(float)
    prior = FLOOR + PRIOR * (y + n) / max(1.0, sum(totals))
    a, b = y + prior, n + prior
    odds = np.log(a / np.maximum(totals[0] + PRIOR - a, 1e-9)) - np.log(b / np.maximum(totals[1] + PRIOR - b, 1e-9))
    return np.sign(odds) * np.maximum(np.abs(odds) - BOUND * np.sqrt(1 / a + 1 / b), 0.0)


def drift(scores: np.ndarray, share: np.ndarray, rest: float) -> float:
    """The lambda above zero with E[exp(lambda * score)] = 1, for tokens of these scores and shares and the rest."""
    f = lambda r: np.sum(share * np.exp(np.minimum(r * scores, 500))) + (1 - share.sum()) * math.exp(r * rest) - 1
    lo, hi = 1e-6, 50.0
    if f(lo) >= 0:
        return 0.1
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return lo


def fit_tail(n: np.ndarray, best: np.ndarray, guess: float, upper: float = TAIL, least: int = 10) -> tuple[float, float]:
    """Lambda and K of best segments in texts of ``n`` tokens, by maximum likelihood on the upper share.

    For a given lambda the best K is closed; lambda itself comes from halving an
    interval.  With fewer than ``least`` scores to go by ``guess`` is taken.
    """
    use = n > 0
    n = n[use].astype(float)
    edge = float(np.quantile(best[use], 1 - upper)) if use.any() else 0.0
    seen, s = best[use] > edge, np.maximum(best[use], edge)
    m = int(seen.sum())

    def k_of(rate: float) -> float:
        return (m + 0.5) / max(float(np.sum(n * np.exp(-rate * s))), 1e-300)

    def slope(rate: float) -> float:
        e = n * np.exp(-rate * s)
        return m / rate - s[seen].sum() + m * float((s * e).sum()) / max(float(e.sum()), 1e-300)

    if m < least:
        return guess, k_of(guess)
    lo, hi = 1e-3, 50.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if slope(mid) > 0 else (lo, mid)
    return lo, k_of(lo)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Offset and slope of the likeliest curve from ``LAPSE`` to 1 - ``LAPSE``, by search on a grid.

    The lapses stand for rows with a wrong label, which would make the curve flat.
    """
    best = (-np.inf, 0.0, 1.0)
    middles = np.unique(np.quantile(x, np.linspace(0, 1, 41))) if len(x) else np.zeros(1)
    for c in np.concatenate((middles, (middles[1:] + middles[:-1]) / 2, [middles[-1] + 1])):
        for b in np.geomspace(0.25, 16, 25):
            p = LAPSE + (1 - 2 * LAPSE) / (1 + np.exp(-np.clip(b * (x - c), -30, 30)))
            # a weak preference for slopes near 2
            value = float(np.sum(y * np.log(p) + (1 - y) * np.log(1 - p))) - 0.5 * math.log(b / 2) ** 2
            best = max(best, (value, -b * c, b))
    return float(best[1]), float(best[2])


def _counts(rows: DataFrame) -> DataFrame:
    """Of each token (kind 1) and prefix (2): ``toxic, other``, in how many texts or after how many
    tokens it is, and ``toxic_types, other_types``, of how many different tokens it is the prefix."""
    out = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("by", pa.int32()), ("where", pa.int64()), ("label", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in words.slices(b.column(0), words.BLOCK):
                first, codes, stems, _, _ = tokens(b.column(0).slice(lo, hi - lo))
                n = np.diff(first)
                before = np.concatenate((np.zeros(1, np.uint64), codes))[: len(codes)].view(np.int64)
                before[first[:-1][n > 0]] = 0
                text, label = (np.repeat(b.column(k).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64), n) for k in (2, 1))
                for kind, keys, places in ((1, codes, (text, before)), (2, stems, (text, before, codes.view(np.int64)))):
                    here = keys != 0
                    for by, where in enumerate(places):
                        seen = np.unique(np.stack([keys[here].view(np.int64), where[here], label[here]]), axis=1)
                        size = seen.shape[1]
                        yield pa.record_batch([pa.array(np.full(size, kind), pa.int32()), pa.array(seen[0]), pa.array(np.full(size, by), pa.int32()), pa.array(seen[1]), pa.array(seen[2], pa.int32())], schema=out)

    pairs = rows.select("text", "_label", F.xxhash64("text")).mapInArrow(run, "kind int, key long, by int, where long, label int").distinct()
    seen = F.least(F.count_if(F.col("by") == 0), F.count_if(F.col("by") == 1)).alias("n")
    each = pairs.groupBy("kind", "key", "label").agg(seen, F.count_if(F.col("by") == 2).alias("types"))
    of = lambda c, k: F.sum(F.when(F.col("label") == k, F.col(c)).otherwise(0))
    return each.groupBy("kind", "key").agg(of("n", 1).alias("toxic"), of("n", 0).alias("other"), of("types", 1).alias("toxic_types"), of("types", 0).alias("other_types"))


def _strongest(counts: DataFrame, totals: dict[int, tuple[float, ...]]) -> DataFrame:
    """The tokens that score, ``MOST_TOKENS`` at most: those whose counts are least likely under one common rate."""
    parts = []
    for kind, (y, n, *_) in sorted(totals.items()):
        p = y / max(1.0, y + n)
        each = F.col("toxic") + F.col("other")
        term = lambda c, q: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (each * F.lit(max(q, 1e-12))))).otherwise(0.0)
        ratio = term("toxic", p) + term("other", 1 - p)
        # twice the log of the likelihood ratio of a score that stays over zero after BOUND errors
        parts.append(counts.filter(F.col("kind") == kind).withColumn("ratio", ratio).filter(F.col("ratio") > BOUND * BOUND / 2).orderBy(F.desc("ratio"), "key").limit(MOST_TOKENS // 2))
    return reduce(DataFrame.unionByName, parts)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", hold_out: tuple[int, int] = HOLD_OUT, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model | float:
    """A fitted model, or the constant score where one class has no rows."""
    spark = docs.sparkSession
    ship(spark)
    chosen = labelled.sample(docs, labels, label, *hold_out, per_class, id_col, text_col)
    text = F.col(text_col).cast("string").alias("text")
    # a class of few rows serves for both
    rows = cut(chosen.select(text, "_label", (F.pmod(F.xxhash64(F.lit(1), text), F.lit(CALIBRATE)) == 0).alias("_mine")))
    sizes = {r["_label"]: r for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n"), F.count_if("_mine").alias("mine")).collect()}
    if len(sizes) < 2:
        return float((sum(r.n for c, r in sizes.items() if c == 1) + 1) / (sum(r.n for r in sizes.values()) + 2))
    both = [c for c, r in sizes.items() if r.n < 8 or r.mine in (0, r.n)]
    learning, calibrating = rows.filter(~F.col("_mine") | F.col("_label").isin(both)), rows.filter(F.col("_mine") | F.col("_label").isin(both))

    counts = cut(_counts(learning))
    columns = ("toxic", "other", "toxic_types", "other_types")
    totals = {r.kind: tuple(float(x) for x in r[1:]) for r in counts.groupBy("kind").agg(*(F.sum(c).alias(c) for c in columns)).collect()}
    model = Model()
    if totals:
        got = sorted((r.kind, r.key % (1 << 64), *(r[c] for c in columns)) for r in _strongest(counts, totals).collect())  # MOST_TOKENS rows at most
        kind, key, y, n, y_types, n_types = (np.array(x, t) for x, t in zip(zip(*got) if got else [()] * 6, (np.int64, np.uint64, *[np.int64] * 4)))
        scores = np.zeros(len(key))
        for c, total in totals.items():
            scores[kind == c] = log_odds(y[kind == c], n[kind == c], total[:2])
        stem = kind == 2
        if stem.any():
            types = log_odds(y_types[stem], n_types[stem], totals[2][2:])
            scores[stem] = np.where(types * scores[stem] > 0, np.sign(types) * np.minimum(np.abs(types), np.abs(scores[stem])), 0.0)
        order = np.argsort(key[scores != 0])
        model.keys, model.scores = key[scores != 0][order], scores[scores != 0][order]
        # what the other tokens score: the log-odds of not being one of those that do
        own = (kind == 1) & (scores != 0)
        ty, tn = totals[1][:2]
        share = n[own] / max(1.0, tn)
        model.rest = min(-0.02, math.log(max(1 - y[own].sum() / max(1.0, ty), 1e-3) / max(1 - share.sum(), 1e-3)))
        guess = drift(scores[own], share, model.rest)
    else:
        guess = 1.0
    model.rate, model.k = guess, 1.0
    best = _calibration(calibrating, model, "best")
    harmless = best[best[:, 0] == 0]
    model.rate, model.k = fit_tail(harmless[:, 1], harmless[:, 2], guess, TAIL)
    x = _calibration(calibrating, model, "evidence")
    model.offset, model.slope = _logistic(x[:, 2], x[:, 0])
    return model


def _calibration(rows: DataFrame, model: Model, what: str) -> np.ndarray:
    """Label, number of tokens and best segment or evidence of each calibration row, in a fixed order."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("label", pa.float64()), ("n", pa.float64()), ("x", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for lo, hi in words.slices(b.column(0), words.BLOCK):
                first, codes, stems, _, _ = tokens(b.column(0).slice(lo, hi - lo))
                scores = model.text_scores(first, codes, stems)
                x = model.best(first, scores) if what == "best" else model.evidence(first, scores)[0]
                yield pa.record_batch([b.column(1).slice(lo, hi - lo).cast(pa.float64()), pa.array(np.diff(first).astype(float)), pa.array(x)], schema=out)

    got = sorted(tuple(r) for r in rows.select("text", "_label").mapInArrow(run, "label double, n double, x double").collect())  # per_class rows of each class at most
    return np.array(got).reshape(-1, 3)


def _scores(model: Model | float, column: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
    n = len(column)
    if isinstance(model, float):
        return np.full(n, model), [[] for _ in range(n)]
    first, codes, stems, starts, ends = tokens(column)
    x, found = model.evidence(first, model.text_scores(first, codes, stems))
    _, off = words.text_buffer(column)
    spans = [[{"start": int(starts[first[d] + a] - off[d]), "stop": int(ends[first[d] + b - 1] - off[d]), "chance": p} for a, b, p in own] for d, own in enumerate(found)]
    return model.probability(x), spans


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", hold_out: tuple[int, int] = HOLD_OUT, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, held_out, score, predicted, segments`` for each row.

    ``segments`` are the significant passages as byte offsets into the UTF-8
    text with their chance under the null model.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, label, hold_out, id_col=id_col, text_col=text_col, **options))
    carried = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("chance", pa.float64())]))
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("segments", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in words.slices(b.column(1), words.BLOCK):
                s, spans = _scores(model.value, b.column(1).slice(lo, hi - lo))
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array(s), pa.array(spans, kind)], schema=out)

    scored = carried.mapInArrow(run, "doc_id long, score double, segments array<struct<start: long, stop: long, chance: double>>")
    held = labelled.remainder(F.col("doc_id"), hold_out[0]) == hold_out[1]
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "segments")
