r"""Spelling variants by forward and backward minimal acyclic automata.

Words are maximal runs of letters (``A-Za-z`` and U+00C0 to U+00FF; A-Z lower-cased)
of at least ``LEAST_LETTERS`` letters and ``LEAST_COUNT`` occurrences.  Two words are
near when they differ by one letter inserted, deleted or replaced.

One error lies in the second half of a word or in its first.  A word is looked up
in an automaton of words read forwards, its first half matched exactly and the rest
completed with one error, and in one of words read backwards, its second half
matched exactly first.  Both automata are minimal (equal subtrees are one state) and
number their words by perfect hashing: along a path, what each edge skips adds up to
the word's rank.  Of the places where the same letter may be inserted or deleted only
the last is tried, so a search meets each neighbour once; a neighbour that both
searches would find is left to the forward one.

Automata are built over buckets of the dictionary.  A word of L letters goes to the
buckets of its first ``(L - 1) // 2``, ``L // 2`` and ``(L + 1) // 2`` letters, halves of
all words that may be near it (two of the three are equal), and likewise for its
ends: four rows a word.  A bucket holds some ``BUCKET_ROWS`` rows; words that share
a half with more than ``CROWD`` others are dealt over several buckets by a hash,
which the words that ask there all visit.  Only counts by word, and four rows a
dictionary word, are shuffled; tasks sum their words before they send them.

Each word's *form* is its near word of largest count (ties: the least word), if that
is twice its own count or more; *root* follows forms to the last, by doubling steps.

Null and empty texts have no words; rows that repeat count as often as they stand
there; an empty table gives no rows; extra columns are ignored.  A null id is read as
empty text where ids matter (``damaged``).  A very long text is counted by one task; a
very long word is a word like others.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .storage import cut

LEAST_LETTERS, LEAST_COUNT = 5, 3
#: Rows of a bucket, on average.
BUCKET_ROWS = 50_000
#: Words sharing a half that one bucket takes.
CROWD = 50_000
#: Words whose counts a task holds before it sends them on.
HELD = 300_000
#: Words searched at once.
BLOCK = 4096
SALTS = 16
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # the UTF-8 of the letters
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _counts(batches: Iterator[pa.RecordBatch], damage: int | None, least: int) -> Iterator[pa.RecordBatch]:
    total: dict[bytes, int] = {}

    def sent() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        total.clear()
        return out

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            head = zlib.crc32(b":" if doc is None else b"%d:" % doc)
            for word, n in Counter(_RUN.findall(text.as_py().translate(_LOWER))).items():
                if len(word) < least:
                    continue
                if damage and not (h := zlib.crc32(word, head)) % damage:
                    letters = word.decode()
                    at = h % len(letters)
                    word = (letters[:at] + letters[at + 1 :]).encode()
                total[word] = total.get(word, 0) + n
            if len(total) >= HELD:
                yield sent()
    if total:
        yield sent()


def dictionary(docs: DataFrame, damage: int | None = None, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of all documents.  With ``damage`` a run loses a letter where the crc32 of ``id:run`` is divisible by it."""
    ship(docs.sparkSession)
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = texts.mapInArrow(lambda batches: _counts(batches, damage, least_letters), "word string, n long")
    return counted.filter(F.length("word") >= least_letters).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class Words:
    """Distinct sorted words as flat letter codes (all are Latin-1), read forwards or backwards."""

    def __init__(self, column: pa.Array, backward: bool = False):
        column = pc.utf8_reverse(column) if backward else column
        self.order = pc.array_sort_indices(column).to_numpy()
        column = column.take(pa.array(self.order))
        self.letters = np.frombuffer("".join(column.to_pylist()).encode("latin-1"), np.uint8)
        self.size = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.size)))[:-1]


class Automaton:
    """The minimal acyclic automaton of some words, with the number of words that each edge skips."""

    def __init__(self, w: Words):
        parent, label, child, self_final, depth_of = [], [], [], [], [np.zeros(1, np.int64)]
        node, live, nodes = np.zeros(len(w.size), np.int64), np.arange(len(w.size)), 1
        finals, below = [np.zeros(1, bool)], [np.array([len(w.size)])]
        depth = 0
        while len(live := live[w.size[live] > depth]):  # the trie, a letter at a time
            c, up = w.letters[w.at[live] + depth], node[live]
            new = np.append(True, (c[1:] != c[:-1]) | (up[1:] != up[:-1]))
            own = np.cumsum(new) - 1
            parent.append(up[new]), label.append(c[new]), child.append(nodes + np.arange(own[-1] + 1))
            ends = np.zeros(own[-1] + 1, bool)
            ends[own[w.size[live] == depth + 1]] = True
            finals.append(ends), below.append(np.bincount(own))
            depth_of.append(np.full(len(ends), depth + 1))
            node[live] = nodes + own
            nodes, depth = nodes + len(ends), depth + 1
        final, below = np.concatenate(finals), np.concatenate(below)
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        parent, label, child = cat(parent), cat(label).astype(np.int64), cat(child)
        # edges in the order of parents, then labels; a parent's edges are neighbours
        degree = np.bincount(parent, minlength=nodes)
        first = np.concatenate(([0], np.cumsum(degree)))
        height = np.zeros(nodes, np.int64)
        starts = np.concatenate(([0], np.cumsum([len(d) for d in depth_of])))
        for k in range(len(depth_of) - 2, -1, -1):
            e = slice(first[starts[k]], first[starts[k + 1]])
            np.maximum.at(height, parent[e], height[child[e]] + 1)
        self.state = np.zeros(nodes, np.int64)
        states, chosen = 0, []
        by_height = np.argsort(height, kind="stable")
        cuts = np.searchsorted(height[by_height], np.arange(height.max() + 2))
        for lo, hi in zip(cuts[:-1], cuts[1:]):  # equal ends and equal edges: one state
            some = by_height[lo:hi]
            code, d = final[some].astype(np.int64), degree[some]
            for r in range(int(d.max(initial=0))):
                has = np.flatnonzero(d > r)
                edge = first[some[has]] + r
                _, code[has] = np.unique((code[has] << 40) | (label[edge] << 32) | self.state[child[edge]], return_inverse=True)
            _, kept, back = np.unique(code << 9 | d, return_index=True, return_inverse=True)
            self.state[some] = states + back
            chosen.append(some[kept])
            states += len(kept)
        chosen = np.concatenate(chosen)
        self.root, self.final = int(self.state[0]), final[chosen]
        self.degree = degree[chosen]
        self.first = np.concatenate(([0], np.cumsum(self.degree)))
        edge = np.repeat(first[chosen] - self.first[:-1], self.degree) + np.arange(self.first[-1])
        self.label, self.to = label[edge], self.state[child[edge]]
        before = np.concatenate(([0], np.cumsum(below[child[edge]])))
        self.skipped = before[:-1] - np.repeat(before[self.first[:-1]], self.degree) + np.repeat(self.final, self.degree)
        self.key = np.repeat(np.arange(states), self.degree) << 8 | self.label

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edge from each state by each letter, and whether there is one."""
        want = state << 8 | letter
        edge = np.minimum(np.searchsorted(self.key, want), max(0, len(self.key) - 1))
        return edge, self.key[edge] == want if len(self.key) else np.zeros(len(want), bool)

    def edges(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All edges of each state: which of the states, and the edge."""
        n = self.degree[state]
        which = np.repeat(np.arange(len(state)), n)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n - self.first[state], n)


def search(a: Automaton, w: Words, ask: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in ``ask``, word number): words with the first ``exact`` letters of an asking word and one error after them.

    The asking words are words of the automaton, given by their numbers.
    """
    at, size = w.at[ask], w.size[ask]
    state, number = np.full(len(ask), a.root), np.zeros(len(ask), np.int64)
    for depth in range(int(exact.max(initial=0))):
        q = np.flatnonzero(exact > depth)
        e, _ = a.step(state[q], w.letters[at[q] + depth])
        number[q] += a.skipped[e]
        state[q] = a.to[e]
    open_q, open_s, open_n, open_p = [], [], [], []

    def put(q: np.ndarray, s: np.ndarray, n: np.ndarray, p: np.ndarray) -> None:
        open_q.append(q), open_s.append(s), open_n.append(n), open_p.append(p)

    q, place = np.arange(len(ask)), exact.copy()
    while len(q):
        more = place[q] < size[q]
        here = np.where(more, w.letters[np.minimum(at[q] + place[q], len(w.letters) - 1)], 0)  # 0 is no letter
        which, e = a.edges(state[q])
        other = a.label[e] != here[which]
        which, e = which[other], e[other]
        owner, n = q[which], number[q[which]] + a.skipped[e]
        put(owner, a.to[e], n, place[owner])  # a letter more
        swap = more[which]
        put(owner[swap], a.to[e[swap]], n[swap], place[owner[swap]] + 1)  # another letter
        q, here = q[more], here[more]
        after = place[q] + 1
        last = (after == size[q]) | (w.letters[np.minimum(at[q] + after, len(w.letters) - 1)] != here)
        put(q[last], state[q[last]], number[q[last]], after[last])  # a letter less
        e, _ = a.step(state[q], here)
        number[q] += a.skipped[e]
        state[q], place[q] = a.to[e], after
    q, s, n, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (open_q, open_s, open_n, open_p))
    found_q, found_n = [], []
    while len(q):  # the rest must match
        done = p == size[q]
        hit = done & a.final[s]
        found_q.append(q[hit]), found_n.append(n[hit])
        q, s, n, p = (x[~done] for x in (q, s, n, p))
        e, ok = a.step(s, w.letters[at[q] + p])
        q, n, p, e = q[ok], n[ok], p[ok] + 1, e[ok]
        s, n = a.to[e], n + a.skipped[e]
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_q, found_n))


def _halves_equal(w: Words, a: np.ndarray, b: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether two words, read backwards, end in the same ``half`` letters."""
    same = np.ones(len(a), bool)
    left = np.arange(len(a))
    for k in range(1, int(half.max(initial=0)) + 1):
        left = left[(half[left] >= k)]
        same[left] = w.letters[w.at[a[left]] + w.size[a[left]] - k] == w.letters[w.at[b[left]] + w.size[b[left]] - k]
        left = left[same[left]]
    return same


def _near(table: pa.Table) -> pa.Table:
    """Near words within a bucket: each asking word's number of them and the best."""
    out = []
    for backward in (False, True):
        rows = table.filter(pc.equal(table["backward"], backward))
        if not rows.num_rows:
            continue
        coded = rows["word"].combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        distinct, own = coded.dictionary, coded.indices.to_numpy()
        w = Words(distinct, backward)
        number = np.empty(len(w.order), np.int64)  # from place in distinct to number
        number[w.order] = np.arange(len(w.order))
        own = number[own]
        here, asks = np.asarray(rows["here"]), np.asarray(rows["asks"])
        key, n = rows["key"].to_numpy(), np.zeros(len(number), np.int64)
        n[own] = rows["n"].to_numpy()
        ask, one = np.unique(own[asks], return_index=True)
        asked_key = key[asks][one]
        # a word's rows as a candidate, by number: at most two keys each
        by_word = np.flatnonzero(here)[np.argsort(own[here], kind="stable")]
        begin = np.searchsorted(own[by_word], np.arange(len(number) + 1))
        a = Automaton(w)
        size = w.size[ask]
        exact = size - size // 2 if backward else size // 2
        rank = pc.rank(distinct, "ascending").to_numpy()[w.order] if len(distinct) else np.zeros(0)
        for lo in range(0, len(ask), BLOCK):
            q, x = search(a, w, ask[lo : lo + BLOCK], exact[lo : lo + BLOCK])
            q = q + lo
            there = np.zeros(len(q), bool)  # in this bucket by the asked half, not by another
            for k in range(int(np.diff(begin).max(initial=0))):
                at = begin[x] + k
                ok = at < begin[x + 1]
                there[ok] |= key[by_word[at[ok]]] == asked_key[q[ok]]
            if backward:
                there[there] = ~_halves_equal(w, ask[q[there]], x[there], size[q[there]] // 2)
            q, x = q[there], x[there]
            order = np.lexsort((rank[x], -n[x], q))
            q, x = q[order], x[order]
            head = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
            count = np.diff(np.append(head, len(q)))
            word, best = (distinct.take(pa.array(w.order[k])) for k in (ask[q[head]], x[head]))
            out.append(pa.table([word, pa.array(count), pa.array(n[x[head]]), best], names=["word", "n_near", "best_n", "best"]))
    return pa.concat_tables(out) if out else pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "best_n": pa.array([], pa.int64()), "best": pa.array([], pa.string())})


def near(words: DataFrame, bucket_rows: int = BUCKET_ROWS, crowd: int = CROWD) -> DataFrame:
    """``word, n_near, best_n, best`` of the words that have near words; ``words`` has distinct ``word`` with ``n`` and is read twice."""
    ship(words.sparkSession)
    size = F.length("word")
    sides = []
    for backward in (False, True):
        reach = lambda length: F.expr(f"cast(({length} + {int(backward)}) div 2 as int)")  # noqa: E731  letters matched exactly
        own = reach("length(word)")
        other = F.when(reach("length(word) - 1") == own, reach("length(word) + 1")).otherwise(reach("length(word) - 1"))
        for k, asks in ((own, True), (other, False)):
            half = F.substring("word", size - k + 1, k) if backward else F.substring("word", F.lit(1), k)
            sides.append(F.struct(F.lit(backward).alias("backward"), F.xxhash64(F.lit(backward), half).alias("key"), F.lit(asks).alias("asks")))
    rows = words.select("word", "n", F.explode(F.array(*sides)).alias("s")).select("word", "n", "s.*")
    total = words.count() * len(sides)
    # at most total / crowd rows
    crowded = rows.groupBy("key").count().filter(F.col("count") > crowd).select("key", F.ceil(F.col("count") / crowd).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(crowded), "key", "left").withColumn("own", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("word"), F.col("parts"))).otherwise(0).cast("int"))
    visits = F.when(F.col("parts").isNotNull() & F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))
    spread = dealt.withColumn("part", F.explode(visits)).withColumn("here", F.col("part") == F.col("own"))
    buckets = max(1, -(-total // bucket_rows))
    bucketed = spread.withColumn("bucket", F.pmod(F.xxhash64("key", "part"), F.lit(buckets)).cast("int")).select("bucket", "backward", "key", "asks", "here", "word", "n")
    found = bucketed.groupBy("bucket").applyInArrow(_near, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.word").alias("best"))


def group(words: DataFrame, **options) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of each word of a dictionary."""
    words = cut(words)
    found = cut(words.join(near(words, **options), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("best_n") >= 2 * F.col("n"), F.col("best")).alias("form"), F.when(F.col("best_n") >= 2 * F.col("n"), F.col("best_n")).alias("form_n")))
    roots = _roots(found.filter("form is not null").select("word", F.col("form").alias("up")))
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("up", "word").alias("root"))


def _roots(ups: DataFrame) -> DataFrame:
    """``word, up`` with up the last of the words that follow it: each step joins the steps taken so far.

    Counts at least double along a way, so there are no cycles, and the number of
    rounds is the logarithm of the logarithm of the largest count.  What many words
    lead to is spread over ``SALTS`` tasks.
    """
    now = cut(ups)
    while True:
        salted = now.withColumn("_salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))
        onward = now.select(F.col("word").alias("up"), F.col("up").alias("next"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")).hint("merge")
        moved = cut(salted.join(onward, ["up", "_salt"], "left").select("word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
        now = moved.select("word", "up")
        if not moved.filter("moved").limit(1).count():
            return now
