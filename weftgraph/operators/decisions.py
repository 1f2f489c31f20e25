"""A turn's strategy in ordered steps, with a trace of everything that changed on the way.

The state of a turn is a struct: primary and supporting strategies, the verdict that
they carry, and the trace.  Each step is a function from state to state in SQL
expressions, so a turn is decided within its row; the policy table comes as one row
that holds all its rules.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A trace entry: the step, the rule that fired, what went and what came.
ENTRY = "array<struct<step: string, rule: string, source: string, gone: string, come: string>>"
_NONE = "cast(null as string)"


@dataclass(frozen=True)
class Combination:
    """Which strategies may share a turn."""

    hints: list[str]
    answers: list[str]
    checks: list[str]
    allowed: dict[str, list[str]] = field(default_factory=dict)
    most: int = 2
    feedback: str = "S06"
    no_verdict: str = "S07"

    def beside(self, primary: Column) -> Column:
        """The strategies that may support ``primary``."""
        cases = [F.when(primary == p, _list(s)) for p, s in self.allowed.items()]
        return F.coalesce(*cases, _list([])) if cases else _list([])


def _list(items: list[str]) -> Column:
    return F.array(*map(F.lit, items)).cast("array<string>")


def _entry(step: str, rule: str | Column, source: Column | None = None, gone: Column | None = None, come: Column | None = None) -> Column:
    text = lambda c: F.expr(_NONE) if c is None else c
    return F.struct(F.lit(step).alias("step"), (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), text(source).alias("source"), text(gone).alias("gone"), text(come).alias("come"))


def _some(*entries: Column) -> Column:
    """Those entries that are not null, in order."""
    return F.array_compact(F.array(*entries)).cast(ENTRY)


def _each(items: Column, make) -> Column:
    """An entry for each item for which ``make`` gives one."""
    return F.filter(F.transform(items, make), lambda e: e.isNotNull()).cast(ENTRY)


def _moved(df: DataFrame, primary: Column, supporting: Column, trace: Column) -> DataFrame:
    return df.withColumns({"primary": primary, "supporting": supporting, "trace": F.concat("trace", trace)})


def combine(df: DataFrame, c: Combination, step: str = "combination") -> DataFrame:
    """A hint beats a full answer and takes the first place; then only allowed strategies stay, ``most`` at most."""
    primary, supporting = F.col("primary"), F.col("supporting")
    every = F.concat(F.array(primary), supporting)
    of = lambda items: F.filter(every, lambda s: s.isin(items) if items else F.lit(False))
    clash = (F.size(of(c.hints)) > 0) & (F.size(of(c.answers)) > 0)
    head = F.when(clash & ~F.array_contains(_list(c.hints), primary), F.get(of(c.hints), F.lit(0))).otherwise(primary)
    lost = F.when(clash, _each(of(c.answers), lambda s: _entry(step, "hint_first_beats_full_answer", gone=s))).otherwise(F.array().cast(ENTRY))
    promoted = _some(F.when(head != primary, _entry(step, "hint_first_beats_full_answer", gone=primary, come=head)))
    rest = F.when(clash, F.filter(supporting, lambda s: ~F.array_contains(_list(c.answers), s) & (s != head))).otherwise(supporting)
    df = df.withColumns({"primary": head, "supporting": rest, "trace": F.concat("trace", lost, promoted)})
    # the rest is judged against the primary that holds now
    beside = c.beside(primary)
    bad = _each(supporting, lambda s: F.when(s == primary, _entry(step, "no_duplicate_primary", gone=s)).when(~F.array_contains(beside, s), _entry(step, "allowed_combinations", gone=s)))
    fit = F.filter(supporting, lambda s: (s != primary) & F.array_contains(beside, s))
    over = _each(F.slice(fit, c.most + 1, 1 << 20), lambda s: _entry(step, "max_supporting", gone=s))
    return _moved(df, primary, F.slice(fit, 1, c.most), F.concat(bad, over))


def route_verdict(df: DataFrame, c: Combination) -> DataFrame:
    """Only feedback carries a verdict; feedback that can't be given becomes a check."""
    step, primary, supporting, verdict = "evaluation", F.col("primary"), F.col("supporting"), F.col("evaluation")
    plain = (primary != c.feedback) & verdict.isNotNull()
    stuck = (primary == c.feedback) & F.coalesce(verdict == "cannot_evaluate", F.lit(False))
    beside = c.beside(F.lit(c.no_verdict))
    stays = lambda s: F.array_contains(beside, s) & (s != c.no_verdict)
    dropped = F.when(stuck, _each(supporting, lambda s: F.when(~stays(s), _entry(step, "allowed_combinations", gone=s)))).otherwise(F.array().cast(ENTRY))
    said = _some(F.when(plain, _entry(step, "evaluation_requires_feedback", gone=verdict)), F.when(stuck, _entry(step, "cannot_evaluate_routes_to_check", gone=primary, come=F.lit(c.no_verdict))))
    return df.withColumns(
        {
            "trace": F.concat("trace", said, dropped),
            "primary": F.when(stuck, F.lit(c.no_verdict)).otherwise(primary),
            "supporting": F.when(stuck, F.filter(supporting, stays)).otherwise(supporting),
            "evaluation": F.when(~plain & ~stuck, verdict),
        }
    )


def policy_table(policies: DataFrame) -> DataFrame:
    """One row: all policy rows as an array, highest precedence first, then in table order.

    Columns: id, conditions ``intent`` and ``special_handling`` (null: any), precedence, seq, direct,
    full, attempt (null: no vote), hint_first, allow_hints, allow_check, prohibited, veto_primary.
    """
    row = F.struct((-F.col("precedence")).alias("down"), "seq", "id", "intent", "special_handling", "direct", "full", "attempt", "hint_first", "allow_hints", "allow_check", "prohibited", "veto_primary")
    return policies.agg(F.array_sort(F.collect_list(row)).alias("policies"))


def apply_policy(df: DataFrame, table: DataFrame, c: Combination, conditions: tuple[str, ...] = ("intent", "special_handling")) -> DataFrame:
    """The hard override: permissions AND, demands OR, prohibited strategies vetoed, replaced or dropped, a hint put in where one is demanded.

    Adds direct, full, attempt, prohibited and policy (the first row that forbids direct
    answers, else the first).  A turn without any policy row is permitted nothing.
    """
    step = "policy"
    holds = lambda p: reduce(lambda a, b: a & b, [p[x].isNull() | p[x].eqNullSafe(F.col(x)) for x in conditions])
    df = df.join(F.broadcast(table), how="cross").withColumn("_rows", F.filter("policies", holds)).drop("policies")  # one row
    rows, some = F.col("_rows"), F.size("_rows") > 0
    every = lambda f: some & F.forall(rows, lambda p: p[f])
    hint_off, direct = F.exists(rows, lambda p: ~p["allow_hints"]), every("direct")
    banned = F.array_union(F.array_distinct(F.flatten(F.transform(rows, lambda p: p["prohibited"]))), F.when(hint_off, _list(c.hints)).otherwise(_list([])))
    banned = F.when(some, F.array_sort(F.array_union(banned, F.when(direct, _list([])).otherwise(_list(c.answers))))).otherwise(_list([]))
    df = df.withColumns({
        "direct": direct, "full": every("full"), "attempt": F.exists(rows, lambda p: F.coalesce(p["attempt"], F.lit(False))), "prohibited": banned,
        "_hint": F.exists(rows, lambda p: p["hint_first"]) & ~hint_off & some, "_check": F.forall(rows, lambda p: p["allow_check"]),
        "policy": F.coalesce(F.get(F.filter(rows, lambda p: ~p["direct"]), F.lit(0))["id"], F.get(rows, F.lit(0))["id"]),
    })
    primary, supporting, out = F.col("primary"), F.col("supporting"), F.col("prohibited")
    inside = lambda s: F.array_contains(out, s)
    given = F.filter(F.transform(rows, lambda p: p["veto_primary"]), lambda s: s.isNotNull())
    pool = F.filter(F.concat(given, _list(sorted(c.hints)), _list(sorted(c.checks))), lambda s: ~inside(s))
    # a veto with nothing to put in its place leaves the primary
    df = df.withColumn("_new", F.when(inside(primary), F.get(pool, F.lit(0))))
    new = F.col("_new")
    rule = lambda s: F.when(s.isin(c.answers) if c.answers else F.lit(False), F.lit("policy_vetoes_direct_answer")).otherwise(F.lit("policy_prohibits_strategy"))
    closed = F.when(~some, _entry(step, "no_policy_row"))
    df = df.withColumns({"trace": F.concat("trace", _some(closed, F.when(new.isNotNull(), _entry(step, rule(primary), F.col("policy"), primary, new)))), "supporting": F.when(new.isNotNull(), F.filter(supporting, lambda s: s != new)).otherwise(supporting), "primary": F.coalesce(new, primary)})
    gone = _each(supporting, lambda s: F.when(inside(s), _entry(step, rule(s), F.col("policy"), s)))
    df = _moved(df, primary, F.filter(supporting, lambda s: ~inside(s)), gone)
    is_check = lambda s: ~F.col("_check") & F.array_contains(_list(c.checks), s)
    df = _moved(df, primary, F.filter(supporting, lambda s: ~is_check(s)), _each(supporting, lambda s: F.when(is_check(s), _entry(step, "policy_disallows_check", F.col("policy"), s))))
    hint = F.get(F.filter(_list(sorted(c.hints)), lambda s: F.array_contains(c.beside(primary), s)), F.lit(0))
    wanted = F.col("_hint") & ~F.arrays_overlap(F.concat(F.array(primary), supporting), _list(c.hints)) & hint.isNotNull()
    df = _moved(df, primary, F.when(wanted, F.concat(F.array(hint), supporting)).otherwise(supporting), _some(F.when(wanted, _entry(step, "policy_requires_hint_first", F.col("policy"), come=hint))))
    return combine(df, c, step).drop("_rows", "_hint", "_check", "_new")


def decide(turns: DataFrame, policies: DataFrame, c: Combination) -> DataFrame:
    """Turns with a chosen trigger row (row_id, primary, supporting, evaluation, matched) through all steps."""
    begun = turns.withColumn("supporting", F.coalesce("supporting", _list([]))).withColumn("trace", F.array(_entry("trigger", F.when(F.col("matched"), F.lit("matched")).otherwise(F.lit("unmatched")), F.col("row_id"), come=F.col("primary"))).cast(ENTRY))
    routed = route_verdict(combine(begun, c), c)
    done = apply_policy(routed, policy_table(policies), c)
    return done.withColumn("trace", F.concat("trace", F.array(_entry("final", "chosen", F.col("policy"), come=F.col("primary"))).cast(ENTRY)))
