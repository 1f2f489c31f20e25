"""Benchmark decontamination by canonical templates.

Words of texts and of benchmark items are lower-cased and stripped of marks,
and become codes of a template: words that start with a digit turn into a
number slot, units after a number into a unit slot, and capitalised words
inside a sentence into a name slot; all others stand for themselves.  Windows
of ``WINDOW`` codes are matched by hash against the windows of the items, so a
question whose numbers, names or units were changed still matches.

Items of one template are one class (``Classes``), which a text meets once,
whatever the number of its items.  A text's matches with a class are checked for slot
consistency along each alignment (one offset between the item's words and the
text's): equal slot values of the item must have equal values in the text.  A class
is found when windows whose slots agree make up ``SIMILARITY`` or more of its
distinct windows.  It is ``verbatim`` where an item's own values agree in enough of
them (``item_id``: the least such item, ``n_items``: how many), and otherwise
``reparameterised`` (the class's least item and number of items).  ``class_id`` is the
least id of the items with that template, ``item_classes`` says which those are.  An
item of fewer words than a window is one window by itself.  Windows of slots
alone are no evidence and are left out.

A name slot depends on the text around a word, so items are sought in three
forms and the first that is found counts: the template; the template with the
item's first word as a name, for a copy inside a sentence (the word itself must
be the same there); and the plain lower-cased words, for a copy in other case.

The items' windows are broadcast, ``SLICE_WINDOWS`` of each form at a time (16
bytes each); a larger benchmark is dealt with in several passes over the texts, so
nothing is dropped and texts are never shuffled.

Null texts and items have no words and match nothing; a null item id is
reported as null; repeated items are one class and counted; where the benchmark
takes several passes, a class is reported once a pass that has items of it; repeated documents
are judged alike; empty tables give no matches; extra columns are ignored; of
forms that find an item the first of the three is reported.  A very long text
takes some 60 bytes a word while its task looks through it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from . import words

WINDOW = 5
SIMILARITY = 0.8
#: Windows of the benchmark that are broadcast at once.
SLICE_WINDOWS = 2_000_000
FORMS = ("template", "named", "plain")
#: fixed values: units that may follow a number
UNITS = (
    "cents", "centimeters", "cm", "days", "dollars", "euros", "feet", "ft", "g", "gallons", "grams", "hours", "hrs",
    "inches", "kg", "kilograms", "kilometers", "km", "kmh", "l", "lb", "lbs", "liters", "m", "meters", "miles", "min",
    "minutes", "ml", "mm", "months", "mph", "ounces", "oz", "percent", "pounds", "s", "sec", "seconds", "weeks",
    "yards", "years",
)
NUMBER, UNIT, NAME = (np.uint64(k) for k in (1, 2, 3))
_SLOTS = np.array([NUMBER, UNIT, NAME])
_KEPT = np.zeros(256, bool)  # letters, digits, everything beyond ASCII
_KEPT[48:58] = _KEPT[65:91] = _KEPT[97:123] = _KEPT[128:] = True
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?:"]] = True


def _hash_words(raw: bytes) -> np.ndarray:
    buf = np.frombuffer(raw, np.uint8)
    s, e, _ = words.spans(buf, np.array([0, len(buf)]))
    return words.word_hashes(buf, s, e)


_UNIT_CODES = np.sort(_hash_words(" ".join(UNITS).encode()))


class Templates:
    """Codes of the words of a block of texts."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        raw, off = words.text_buffer(column)
        buf = words.LOWER[raw]
        if len(buf) > 1:  # capital letters of the Latin-1 supplement, as UTF-8
            high = (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)
            buf[1:][high] += 32
        starts, ends, first = words.spans(raw, off)
        # a word's letters and digits, without its marks
        kept = _KEPT[raw]
        before = np.concatenate(([0], np.cumsum(kept)))
        s, e = before[starts], before[ends]
        full = e > s
        closes = np.zeros(len(starts), bool)
        if len(starts):
            closes = _STOPS[raw[ends - 1]]
            closes |= np.append(raw[np.minimum(ends[:-1], len(raw) - 1)] == 10, True)
        opens = np.append(True, closes[:-1]) if len(starts) else closes
        opens[first[:-1][np.diff(first) > 0]] = True
        letter = raw[starts] if len(starts) else np.zeros(0, np.uint8)
        capital = (letter >= 65) & (letter <= 90)
        if len(starts) and len(raw) > 1:
            second = raw[np.minimum(starts + 1, len(raw) - 1)]
            capital |= (letter == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        self.first = np.concatenate(([0], np.cumsum(full)))[first]
        clean = buf[kept]
        self.values = words.word_hashes(clean, s[full], e[full])
        lead = clean[s[full]] if full.any() else np.zeros(0, np.uint8)
        self.codes = self.values.copy()
        name = capital[full] & ~opens[full]
        number = (lead >= 48) & (lead <= 57)
        at = np.minimum(np.searchsorted(_UNIT_CODES, self.values), len(_UNIT_CODES) - 1)
        unit = (_UNIT_CODES[at] == self.values) & np.append(False, number[:-1])[: len(number)]
        self.codes[name], self.codes[unit], self.codes[number] = NAME, UNIT, NUMBER

    def windows(self, size: int, plain: bool = False, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows inside one text that hold a word (``every``: of all).

        ``plain`` windows are of words instead of codes.
        """
        n = len(self.codes)
        ok = words.within(self.first, n, size)
        slot = np.concatenate(([0], np.cumsum(np.isin(self.codes, _SLOTS))))
        if len(ok) and not every:
            ok &= slot[size:] - slot[:-size] < size
        at = np.flatnonzero(ok)
        return at, words.window_hashes(self.values if plain else self.codes, size)[at]


def _roles(codes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each slot the first place with the same slot and value; -1 for words."""
    out = np.full(len(codes), -1, np.int32)
    first: dict[tuple[int, int], int] = {}
    for p in np.flatnonzero(codes <= NAME).tolist():
        out[p] = first.setdefault((int(codes[p]), int(values[p])), p)
    return out


def least_windows(n: int, similarity: float) -> int:
    """How many of ``n`` windows are a share of ``similarity`` at least."""
    k = max(1, int(similarity * n))
    while k / n < similarity:
        k += 1
    return k


class Classes:
    """The classes of some benchmark items in one form.

    Items with one sequence of codes whose equal slot values stand at the same
    places are one class: a text meets its windows once, and slots are checked
    once an alignment, however many items there are.  A class of a later form
    lies in one class of the form before (``above``: each item's class there).

    Of a class's n distinct windows a text must hold ``least_windows``; so the
    index has only the n - least + 1 that the fewest classes share, one of which
    a text that holds enough must have.
    """

    def __init__(self, t: Templates, size: int, similarity: float, form: str, above: np.ndarray | None = None):
        self.form, plain = form, form == "plain"
        groups: dict[tuple, list[int]] = {}
        bodies: list[tuple[np.ndarray, np.ndarray]] = []
        starts = t.first.tolist()
        for k, (a, b) in enumerate(zip(starts, starts[1:])):
            values = t.values[a:b]
            codes = values if plain else t.codes[a:b].copy()
            lead = 0
            if form == "named" and len(codes) and codes[0] > NAME:
                codes[0], lead = NAME, int(values[0])
            roles = _roles(codes, values)
            mine = groups.setdefault((-1 if above is None else int(above[k]), lead, codes.tobytes(), roles.tobytes()), [])
            if not mine:
                bodies.append((codes, roles))
            mine.append(k)
        self.of = np.zeros(len(starts) - 1, np.int32)
        self.parent = np.array([key[0] for key in groups], np.int32)
        self.lead = np.array([key[1] for key in groups], np.uint64)
        self.members = list(groups.values())
        self.code_off = np.concatenate(([0], np.cumsum([len(c) for c, _ in bodies]))).astype(np.int64)
        self.roles = _joined([r for _, r in bodies], np.int32)
        hashes, places, numbers, width = [], [], [], []
        columns: list[np.ndarray] = []
        for c, ((codes, roles), mine) in enumerate(zip(bodies, self.members)):
            self.of[mine] = c
            w = min(len(codes), size)
            h, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if w:
                slots = np.concatenate(([0], np.cumsum(np.isin(t.codes[starts[mine[0]] : starts[mine[0] + 1]] if plain else codes, _SLOTS))))
                at = np.flatnonzero(slots[w:] - slots[:-w] < w)
                h = words.window_hashes(codes, w)[at]
            distinct, number = np.unique(h, return_inverse=True)
            hashes.append(distinct)
            order = np.argsort(number, kind="stable")
            places.append(at[order])
            numbers.append(number[order])
            width.append(w)
            own = np.flatnonzero(roles == np.arange(len(roles)))
            columns.append(np.array([t.values[own + starts[k]] for k in mine], np.uint64).T.ravel())
        self.width = np.array(width, np.int32)
        self.win_off = np.concatenate(([0], np.cumsum([len(x) for x in hashes]))).astype(np.int64)
        self.place_off = np.concatenate(([0], np.cumsum([len(x) for x in places]))).astype(np.int64)
        self.windows, self.places, self.numbers = _joined(hashes, np.uint64), _joined(places, np.int32), _joined(numbers, np.int32)
        self.value_off = np.concatenate(([0], np.cumsum([len(x) for x in columns]))).astype(np.int64)
        self.values = _joined(columns, np.uint64)
        # each column's members by value, to find those with a given one
        self.order = _joined([np.argsort(x.reshape(-1, len(m)), axis=1, kind="stable").ravel() if len(x) else x for x, m in zip(columns, self.members)], np.int32)
        counts = np.diff(self.win_off)
        self.least = np.array([least_windows(n, similarity) if n else 0 for n in counts.tolist()], np.int32)
        self._index(counts)

    def _index(self, counts: np.ndarray) -> None:
        owner = np.repeat(np.arange(len(counts)), counts)
        _, back, shared = np.unique(self.windows, return_inverse=True, return_counts=True)
        by_rarity = np.lexsort((self.windows, shared[back], owner))
        rank = np.arange(len(owner)) - self.win_off[owner]
        chosen = by_rarity[rank < (counts - self.least + 1)[owner]]
        chosen = chosen[np.argsort(self.windows[chosen], kind="stable")]
        self.keys, self.owners = self.windows[chosen], owner[chosen].astype(np.int32)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def proposed(self, t: Templates, at: np.ndarray, h: np.ndarray, width: int) -> list[tuple[int, int]]:
        """Texts and classes of windows of ``width`` that share an indexed window."""
        maybe = np.flatnonzero(self.filter[(h >> np.uint64(42)).astype(np.int64)])
        lo, hi = np.searchsorted(self.keys, h[maybe]), np.searchsorted(self.keys, h[maybe], "right")
        n = hi - lo
        which = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        owner = self.owners[which].astype(np.int64)
        doc = np.searchsorted(t.first, np.repeat(at[maybe], n), "right") - 1
        fits = self.width[owner] == width
        pairs = np.unique(doc[fits] * len(self.members) + owner[fits])
        return list(zip((pairs // len(self.members)).tolist(), (pairs % len(self.members)).tolist()))

    def offsets(self, c: int, h: np.ndarray, at: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """The class's windows in one text (``h`` sorted), as (place, window number) by offset; none if too few."""
        mine = self.windows[self.win_off[c] : self.win_off[c + 1]]
        lo, hi = np.searchsorted(h, mine), np.searchsorted(h, mine, "right")
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if (hi > lo).sum() >= self.least[c]:
            part = slice(self.place_off[c], self.place_off[c + 1])
            for p, j in zip(self.places[part].tolist(), self.numbers[part].tolist()):
                for a in at[lo[j] : hi[j]].tolist():
                    out[a - p].append((p, j))
        return out

    def aligned(self, c: int, theirs: np.ndarray, start: int, met: list[tuple[int, int]]) -> tuple[list[int], dict[int, int]]:
        """Numbers of the windows of one alignment whose slots agree, and the values at the slots."""
        base, width = int(self.code_off[c]), int(self.width[c])
        bound: dict[int, int] = {}
        good = []
        for p, j in sorted(met):
            if p == 0 and self.lead[c] and theirs[start] != self.lead[c]:
                continue
            new: dict[int, int] = {}
            for q, role in enumerate(self.roles[base + p : base + p + width].tolist(), start + p):
                if role >= 0 and bound.get(role, new.setdefault(role, int(theirs[q]))) != theirs[q]:
                    break
            else:
                bound |= new
                good.append(j)
        return good, bound

    def agreeing(self, c: int, bound: dict[int, int]) -> np.ndarray | None:
        """Members that have the values at the slots; None where no slot is bound."""
        if not bound:
            return None
        base, m = int(self.code_off[c]), len(self.members[c])
        roles = self.roles[base : int(self.code_off[c + 1])]
        row = {int(r): k for k, r in enumerate(np.flatnonzero(roles == np.arange(len(roles))))}
        part = slice(self.value_off[c], self.value_off[c + 1])
        values, order = self.values[part].reshape(-1, m), self.order[part].reshape(-1, m)
        wanted = [(row[r], np.uint64(v)) for r, v in bound.items()]
        # the slot whose value the fewest members have, by bisection of its sorted column
        spans = [tuple(int(np.searchsorted(values[k], v, side, sorter=order[k])) for side in ("left", "right")) for k, v in wanted]
        best = min(range(len(spans)), key=lambda i: spans[i][1] - spans[i][0])
        left = order[wanted[best][0]][slice(*spans[best])]
        for k, v in wanted:
            left = left[values[k][left] == v]
        return np.sort(left)

    def verdict(self, c: int, parts: list[tuple[list[int], dict[int, int]]]) -> tuple[float, np.ndarray] | None:
        """Share of the class's windows that stand in the text, and the members whose own values make up enough."""
        n, least = int(self.win_off[c + 1] - self.win_off[c]), int(self.least[c])
        seen = {j for good, _ in parts for j in good}
        if len(seen) < least:
            return None
        told = [(good, self.agreeing(c, bound)) for good, bound in parts if good]
        free = sorted({j for good, m in told if m is None for j in good})
        if len(free) >= least:
            return len(seen) / n, np.arange(len(self.members[c]))
        told = [(good, m) for good, m in told if m is not None and len(m)]
        rows = np.unique(np.concatenate([m for _, m in told])) if told else np.zeros(0, np.int64)
        cover = np.zeros((len(rows), n), bool)
        cover[:, free] = True
        for good, m in told:
            cover[np.ix_(np.searchsorted(rows, m), good)] = True
        return len(seen) / n, rows[cover.sum(1) >= least]


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)


class Benchmark:
    """Some items as classes of all forms; ``classes`` are their ids' classes in the whole benchmark."""

    def __init__(self, ids: list, classes: list, column: pa.Array, size: int = WINDOW, similarity: float = SIMILARITY):
        t = Templates(column)
        self.ids, self.classes, self.forms = ids, classes, []
        above = None
        for form in FORMS:
            self.forms.append(Classes(t, size, similarity, form, above))
            above = self.forms[-1].of


def _judge(bench: Benchmark, column: pa.Array) -> list[list[dict]]:
    """Each text's classes found: the first form that finds an item counts."""
    t = Templates(column)
    out: list[list[tuple[int, dict]]] = [[] for _ in range(len(t.first) - 1)]
    known: list[set[tuple[int, int]]] = []
    for level, form in enumerate(bench.forms):
        known.append(set())
        for width in np.unique(form.width[form.least > 0]).tolist():
            at, h = t.windows(width, form.form == "plain", form.form == "plain")
            last = -1
            for d, c in form.proposed(t, at, h, width):
                up, found = c, False
                for k in range(level, 0, -1):  # found in an earlier form
                    up = int(bench.forms[k].parent[up])
                    found |= (d, up) in known[k - 1]
                if found:
                    continue
                if d != last:
                    span = slice(*np.searchsorted(at, t.first[d : d + 2]))
                    order = np.argsort(h[span], kind="stable")
                    hashes, places, last = h[span][order], at[span][order], d
                met = form.offsets(c, hashes, places)
                result = form.verdict(c, [form.aligned(c, t.values, start, x) for start, x in sorted(met.items())])
                if result:
                    known[level].add((d, c))
                    share, same = result
                    members = form.members[c]
                    first = members[int(same[0])] if len(same) else members[0]
                    out[d].append((first, {"item_id": bench.ids[first], "class_id": bench.classes[first], "n_items": len(same) or len(members), "similarity": share, "kind": "verbatim" if len(same) else "reparameterised"}))
    return [[x for _, x in sorted(row, key=lambda r: r[0])] for row in out]


_ITEMS = pa.list_(pa.struct([("item_id", pa.int64()), ("class_id", pa.int64()), ("n_items", pa.int64()), ("similarity", pa.float64()), ("kind", pa.string())]))
_ITEMS_SQL = "array<struct<item_id: bigint, class_id: bigint, n_items: bigint, similarity: double, kind: string>>"


@F.arrow_udf(T.BinaryType())
def _template(text: pa.Array) -> pa.Array:
    """A digest of an item's template: its codes and which of its slots are equal."""
    t = Templates(text)
    parts = [(t.codes[a:b], t.values[a:b]) for a, b in zip(t.first[:-1], t.first[1:])]
    return pa.array([blake2b(codes.tobytes() + _roles(codes, values).tobytes(), digest_size=16).digest() for codes, values in parts], pa.binary())


def item_classes(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, class_id, text``: the least id of the items with the same template."""
    ship(benchmark.sparkSession)
    text = F.coalesce(F.col(item_text_col).cast("string"), F.lit(""))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), text.alias("text")).withColumn("template", _template("text"))
    least = items.groupBy("template").agg(F.min("item_id").alias("class_id"))
    return items.join(least, "template").select("item_id", "class_id", "text")


def _items(docs: DataFrame, benchmark: DataFrame, text_col: str, window: int = WINDOW, similarity: float = SIMILARITY, slice_windows: int = SLICE_WINDOWS, item_col: str = "item_id", item_text_col: str = "text") -> Column:
    """The items found as a column of ``docs``: Python gets the text and gives only them back."""
    spark = docs.sparkSession
    ship(spark)
    bench = item_classes(benchmark, item_col, item_text_col)
    total = benchmark.agg(F.coalesce(F.sum(F.length(F.col(item_text_col).cast("string"))), F.lit(0))).first()[0]
    passes = max(1, -(-int(total) // 2 // slice_windows))  # a word has two characters at least
    found = []
    for k in range(passes):
        part = bench if passes == 1 else bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        rows = sorted(part.collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r.text))  # slice_windows windows at most
        made = Benchmark([r.item_id for r in rows], [r.class_id for r in rows], pa.array([r.text for r in rows], pa.string()), window, similarity)
        found.append(_finder(spark.sparkContext.broadcast(made))(F.col(text_col).cast("string")))
    return found[0] if passes == 1 else F.concat(*found)


def _finder(shared):
    @F.arrow_udf(_ITEMS_SQL)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            parts = [_judge(shared.value, text.slice(lo, hi - lo)) for lo, hi in words.slices(text, words.BLOCK)]
            yield pa.array([x for part in parts for x in part], _ITEMS)

    return run


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, items`` for each row: the items found, with similarity and kind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _items(docs, benchmark, text_col, **options).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found, columns unchanged."""
    return docs.filter(F.size(_items(docs, benchmark, text_col, **options)) == 0)
