"""Conversation structure repair by cost layers of grammar states.

A conversation is well formed when the initials of its roles read
``(s?(ua)+)?``: nothing, or a system turn at most and then pairs of user and
assistant.  Faults of a row, the first that holds: *blank* (no character but
white space), *duplicate* (role and text of an earlier row), *truncated* (its
last character is no full stop, exclamation or question mark).

Edits and their costs: Keep 0, Rerole to user or assistant 2, Delete 3, Insert
an empty user or assistant turn anywhere 2; a truncated row that stays adds 1;
blank and duplicate rows must go.  The cheapest edits are found backwards from
the end.  For each turn one machine word holds 16 cost layers of 4 bits, bit s of
layer k saying that from grammar state s the end can be reached for k more than
the turn's least cost.  An edit moves all layers at once: its states by a mask,
its cost by a shift of whole layers.  Inserting moves between the states for 7 at
most, so no more layers can matter.  The first layer that holds the starting state
is the cost; walking forward along the bits and taking the least letter that some
cheapest path allows gives the audit.  What the repair does follows from the
audit: in each state only one role can be inserted or given.

Rows travel twice: first numbers only (sorted by conversation and turn), some 80
bytes a row in the task of their conversation, however long its texts; then texts,
which a task streams behind their audit without gathering a conversation.  A
conversation is the work of one task, as is the one hash of its repaired text.

Nulls are read as one space in every column: such a role is in no grammar, such a
text is blank; rows without a conversation id are one conversation, whose id is
null.  Rows of one turn are taken by role and then by a 128-bit hash of role and
text, null turns first; repeated rows are duplicates.  Empty and very long texts
are rows like others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The states after a row with initial s, u or a; a role that is not listed is illegal there.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
INSERT, REROLE, DELETE, UNFINISHED = 2, 2, 3, 1
LAYERS = 16
_SPACE = " \t\n\x0b\f\r"
_LOW = np.uint64(0x1111111111111111)
_N = [np.uint64(k) for k in range(65)]
#: Which state the only role that may be inserted leads to.
_NEXT = np.array([USER, USER, ASSISTANT, USER])
#: State after keeping a row with initial code 0 (none), 1 (s), 2 (u), 3 (a); -1 where the grammar forbids it.
_KEEP = np.full((4, 4), -1)
for (_state, _initial), _to in AFTER.items():
    _KEEP[_state, ".sua".index(_initial)] = _to


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with faults put in by ``crc32(conv_id:turn) % 20``: dropped, emptied, without end marks, repeated, or said by the user.

    Rows to be dropped stay, with ``dropped`` set, so that each conversation is seen.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(blank(text_col), ".!?", "")).otherwise(blank(text_col))
    role = F.when(kind == 4, F.lit("user")).otherwise(blank(role_col))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), (kind == 0).alias("dropped"), kind.alias("_kind"))
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1)))).drop("_kind", "_copy")


def plain(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows as they are, in the form of ``damage``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"), F.lit(False).alias("dropped"))


def _hashes() -> tuple[Column, Column]:
    return F.xxhash64("role", "text"), F.xxhash64(F.lit(1), "role", "text")


def _initial() -> Column:
    first = F.substring("role", 1, 1)
    return F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0).cast("byte")


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_REPORT_ARROW = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])


def report(rows: DataFrame) -> DataFrame:
    """Each conversation's faults, cost and audit: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``."""
    ship(rows.sparkSession)
    one, two = _hashes()
    trimmed = F.rtrim(F.col("text"), F.lit(_SPACE))
    numbers = rows.select("conv_id", "turn", "role", one.alias("h"), two.alias("g"), "dropped", _initial().alias("initial"), (F.length(trimmed) == 0).alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("open"))
    dealt = numbers.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "h", "g").drop("role")
    return dealt.mapInArrow(_reports, _REPORT)


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches cut where a conversation begins: whole conversations only."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, unset = _key(batch)
        new = np.flatnonzero((key[1:] != key[:-1]) | (unset[1:] != unset[:-1])) + 1
        if held and (key[0], unset[0]) != last:
            yield pa.Table.from_batches(held)
            held = []
        last = (key[-1], unset[-1])
        if len(new):
            yield pa.Table.from_batches([*held, batch.slice(0, new[-1])])
            held = [batch.slice(new[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _key(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = batch["conv_id"]
    return column.fill_null(0).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.fill_null(0).to_numpy(), np.asarray(column.is_null())


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _by_conversation(batches):
        yield from _reported(table).to_batches()


def _reported(table: pa.Table) -> pa.Table:
    key, unset = _key(table)
    new = np.append(True, (key[1:] != key[:-1]) | (unset[1:] != unset[:-1]))
    ids, no_id = key[new], unset[new]
    n = len(ids)
    stays = ~np.asarray(table["dropped"])
    conv = (np.cumsum(new) - 1)[stays]
    turn, no_turn = table["turn"].fill_null(0).to_numpy()[stays], np.asarray(table["turn"].is_null())[stays]
    initial, blank, ends_open = (np.asarray(table[c])[stays] for c in ("initial", "blank", "open"))
    h, g = (table[c].to_numpy()[stays] for c in ("h", "g"))
    same = np.zeros(len(conv), bool)
    order = np.lexsort((g, h, conv))  # stable: of equal rows the first one in order leads
    a, b = order[1:], order[:-1]
    same[a] = (conv[a] == conv[b]) & (h[a] == h[b]) & (g[a] == g[b])
    duplicate = same & ~blank
    truncated = ends_open & ~same & ~blank
    count = lambda flags: np.bincount(conv[flags], minlength=n)
    pair = conv[1:] == conv[:-1]
    illegal = np.append(False, pair & ~np.isin(initial[:-1] * 4 + initial[1:], (1 * 4 + 2, 2 * 4 + 3, 3 * 4 + 2))) if len(conv) else np.zeros(0, bool)
    known = np.flatnonzero(~no_turn)
    gaps = np.zeros(n, np.int64)
    if len(known):
        c, t = conv[known], turn[known]
        first = np.append(True, c[1:] != c[:-1])
        last = np.append(c[1:] != c[:-1], True)
        distinct = np.bincount(c[np.append(True, (c[1:] != c[:-1]) | (t[1:] != t[:-1]))], minlength=n)
        gaps[c[first]] = t[last] - t[first] + 1
        gaps -= distinct
    cost, audit = cheapest(np.bincount(conv, minlength=n), initial, blank | duplicate, truncated)
    columns = [pa.array(ids, mask=no_id), *(pa.array(x.astype(np.int64)) for x in (gaps, count(blank), count(duplicate), count(truncated), count(illegal), cost)), pa.array(audit)]
    return pa.table(columns, schema=_REPORT_ARROW)


def _given(x: np.ndarray) -> np.ndarray:
    """The states from which the one role that may come there leads into ``x``, in all layers."""
    u, a = (x >> _N[USER]) & _LOW, (x >> _N[ASSISTANT]) & _LOW
    return u << _N[START] | u << _N[SYSTEM] | u << _N[ASSISTANT] | a << _N[USER]


def _kept(x: np.ndarray, initial: np.ndarray) -> np.ndarray:
    """The states from which a row with this initial leads into ``x``, in all layers."""
    given = _given(x)
    users = given & ~(_LOW << _N[USER])
    return np.where(initial == 2, users, np.where(initial == 3, given & (_LOW << _N[USER]), np.where(initial == 1, (x >> _N[SYSTEM]) & _LOW, _N[0])))


def _inserted(x: np.ndarray) -> np.ndarray:
    """With turns inserted: two are enough to reach any state that inserting reaches."""
    x = x | _given(x) << _N[4 * INSERT]
    return x | _given(x) << _N[4 * INSERT]


def cheapest(sizes: np.ndarray, initial: np.ndarray, must_go: np.ndarray, truncated: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Least costs and audits of conversations of ``sizes`` rows each, whose rows follow one another.

    Conversations are walked together, a turn at a time from their ends; those with fewer
    turns drop out first.
    """
    n = len(sizes)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if n else np.zeros(0, np.int64)
    at = first + np.arange(n)  # a conversation of k rows has k + 1 layer words
    layers, base = np.zeros(int(sizes.sum()) + n, np.uint64), np.zeros(int(sizes.sum()) + n, np.int64)
    layers[at + sizes] = _inserted(np.array([1 << START | 1 << ASSISTANT], np.uint64))
    by_size = np.argsort(-sizes, kind="stable")
    ascending = -sizes[by_size]
    for step in range(1, int(sizes.max(initial=0)) + 1):
        c = by_size[: np.searchsorted(ascending, -step, "right")]
        place = sizes[c] - step
        x, row = layers[at[c] + place + 1], first[c] + place
        stay = _kept(x, initial[row]) | _given(x) << _N[4 * REROLE]
        stay = np.where(truncated[row], stay << _N[4 * UNFINISHED], stay)
        x = _inserted(np.where(must_go[row], _N[0], stay) | x << _N[4 * DELETE])
        up = np.zeros(len(c), np.int64)
        for _ in range(DELETE):  # the least cost rises by a deletion's at most
            empty = (x & _N[15]) == 0
            x, up = np.where(empty, x >> _N[4], x), up + empty
        layers[at[c] + place], base[at[c] + place] = x, base[at[c] + place + 1] + up
    low = np.zeros(n, np.int64)
    for k in range(LAYERS - 1, -1, -1):
        low[(layers[at] >> _N[4 * k + START]) & _N[1] == 1] = k
    cost = base[at] + low
    return cost, _audits(sizes, first, at, layers, base, cost, initial, must_go, truncated)


def _audits(sizes: np.ndarray, first: np.ndarray, at: np.ndarray, layers: np.ndarray, base: np.ndarray, cost: np.ndarray, initial: np.ndarray, must_go: np.ndarray, truncated: np.ndarray) -> list[str]:
    """The least letters along the cheapest paths."""
    left, place, state = cost.copy(), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    owners, letters = [], []
    live = np.flatnonzero((place < sizes) | (left > 0))

    def reached(word: np.ndarray, to: np.ndarray, rest: np.ndarray) -> np.ndarray:
        layer = rest - base[word]
        ok = (layer >= 0) & (layer < LAYERS) & (to >= 0)
        return ok & ((layers[word] >> np.where(ok, 4 * layer + to, 0).astype(np.uint64)) & _N[1] == 1)

    while len(live):
        s, i, d = state[live], place[live], left[live]
        word, more = at[live] + i, i < sizes[live]
        row, then = np.where(more, first[live] + i, 0), word + more
        extra, go = (truncated[row] * UNFINISHED, must_go[row]) if len(initial) else (0 * i, i < 0)
        kept = _KEEP[s, initial[row]] if len(initial) else _KEEP[s, 0]
        given = _NEXT[s]
        choices = [  # in the order of their letters
            ("D", more & reached(then, s, d - DELETE), s, DELETE),
            ("I", reached(word, given, d - INSERT), given, INSERT),
            ("K", more & ~go & reached(then, kept, d - extra), kept, extra),
            ("R", more & ~go & reached(then, given, d - REROLE - extra), given, REROLE + extra),
        ]
        which = np.argmax([c[1] for c in choices], axis=0)
        pick = lambda k: np.choose(which, [np.broadcast_to(c[k], which.shape) for c in choices])
        owners.append(live)
        letters.append(np.frombuffer(b"DIKR", np.uint8)[which])
        state[live], left[live], place[live] = pick(2), d - pick(3), i + (which != 1)
        live = live[(place[live] < sizes[live]) | (left[live] > 0)]
    if not owners:
        return [""] * len(sizes)
    owner = np.concatenate(owners)
    text = np.concatenate(letters)[np.argsort(owner, kind="stable")].tobytes().decode()
    ends = np.cumsum(np.bincount(owner, minlength=len(sizes)))
    return [text[a:b] for a, b in zip(np.concatenate(([0], ends[:-1])), ends)]


_TURNS = "conv_id long, place long, role string, text string, edit string"


def _behind(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Each conversation's report and then its rows in order, in one partition."""
    one, two = _hashes()
    turns = rows.filter(~F.col("dropped")).select("conv_id", F.lit(1).alias("kind"), "turn", "role", one.alias("h"), two.alias("g"), "text")
    both = turns.unionByName(reports.select("*", F.lit(0).alias("kind")), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "h", "g").drop("turn", "h", "g")


class _Replay:
    """One conversation's audit, applied to its rows as they come: yields the turns that result."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = int(_NEXT[self.state])
            self.at += 1
            yield ROLES[self.state], "", "I"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = AFTER[self.state, role[0]]
            yield role, text, "K"
        elif edit == "R":
            self.state = int(_NEXT[self.state])
            yield ROLES[self.state], text, "R"


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str, str]]]]:
    """Each conversation's report and, to be read before the next one, its repaired turns."""
    rows = (r for b in batches for r in zip(*(b[c].to_pylist() for c in ("kind", "role", "text")), _heads(b)))
    head = next(rows, None)
    while head:
        replay, following = _Replay(head[3]["audit"]), [None]

        def turns(replay: _Replay = replay, following: list = following) -> Iterator[tuple[str, str, str]]:
            for r in rows:
                if r[0] == 0:
                    following[0] = r
                    break
                yield from replay.row(r[1], r[2])
            yield from replay.inserts()

        yield head[3], turns()
        head = following[0]


def _heads(batch: pa.RecordBatch) -> Iterator[dict | None]:
    heads = iter(batch.filter(pc.equal(batch["kind"], 0)).select(_REPORT_ARROW.names).to_pylist())
    return (next(heads) if k == 0 else None for k in batch["kind"].to_pylist())


def repaired(rows: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """The repaired turns: ``conv_id, place`` (from 0)``, role, text, edit`` (its letter of the audit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for head, turns in _replayed(batches):
            for place, turn in enumerate(turns):
                out.append((head["conv_id"], place, *turn))
                if len(out) == 1024:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["conv_id", "place", "role", "text", "edit"])

    return _behind(rows, report(rows) if reports is None else reports).mapInArrow(run, _TURNS)


def digests(rows: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """The reports with ``repaired_sha256``: of the repaired turns as ``role:text`` lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for head, turns in _replayed(batches):
            h, joint = hashlib.sha256(), ""
            for role, text, _ in turns:
                h.update(f"{joint}{role}:{text}".encode())
                joint = "\n"
            out.append({**head, "repaired_sha256": h.hexdigest()})
            if len(out) == 1024:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = _REPORT_ARROW.append(pa.field("repaired_sha256", pa.string()))
    return _behind(rows, report(rows) if reports is None else reports).mapInArrow(run, f"{_REPORT}, repaired_sha256 string")
