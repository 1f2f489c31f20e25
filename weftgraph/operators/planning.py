"""Response plans: a strategy's template, what supporting strategies add, and what constraints take away.

The rule tables are small mappings and become literals of one projection: turns
are neither shuffled nor joined.  Every decision leaves an action.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a block is; a block without tags is plain text.
TAGS = ("solution", "answer_key", "question", "hint", "steps")
#: fixed value: what is asked when nothing is left and the template has no question
BARE_QUESTION = "single_check_question"
_ACTION = "struct<rule: string, block: string>"


@dataclass(frozen=True)
class Template:
    """A primary strategy's blocks; ``waits`` None: where the turn requires an attempt."""

    blocks: tuple[str, ...]
    max_words: int
    waits: bool | None = None


@dataclass(frozen=True)
class Planning:
    """Rule tables of a planner.

    templates: by primary strategy; supporting: strategy -> (block, acts on a reply
    of the student); blocks: name -> tags; wording: by level.
    """

    templates: dict[str, Template]
    supporting: dict[str, tuple[str, bool]]
    blocks: dict[str, tuple[str, ...]]
    wording: dict[str, str]
    max_questions: int = 1
    hint_with_solution: bool = False
    answer_before_attempt: bool = False

    def problems(self) -> list[str]:
        """What is wrong with the tables, all at once: names of blocks and tags that are not declared."""
        used = [(f"template {s}", b) for s, t in self.templates.items() for b in t.blocks] + [(f"supporting {s}", b) for s, (b, _) in self.supporting.items()]
        undeclared = [f"{where}: no block {b}" for where, b in used if b not in self.blocks]
        strange = [f"block {b}: no tag {x}" for b, tags in self.blocks.items() for x in tags if x not in TAGS]
        empty = [f"template {s}: no words allowed" for s, t in self.templates.items() if t.max_words <= 0]
        return undeclared + strange + empty


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _lookup(rows: dict[str, Column], key: Column, kind: str) -> Column:
    """The literal of a key; null for an unknown or null one."""
    pairs = [x for name, value in rows.items() for x in (F.lit(name), value.cast(kind))]
    return F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast(kind)


def _action(rule: str | Column, block: Column) -> Column:
    return F.struct((F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), block.cast("string").alias("block"))


def plan_responses(turns: DataFrame, rules: Planning) -> DataFrame:
    """``turns`` with a plan each: ``structure, max_words, waits, full_solution, level, wording, added, actions``.

    turns: primary, supporting (array of strategies in order), direct, full,
    attempt (booleans, null: false), level (null: beginner) and any other columns, which are kept;
    columns that a plan names are replaced.

    Supporting blocks follow the template's, each once; one that acts on a reply is
    left to the next turn while this one waits.  Constraints then take blocks away in
    a fixed order, questions close the plan and are ``max_questions`` at most, and a plan
    that would be empty asks.  ``full_solution`` says what the plan does, not what it might.
    A primary strategy without a template has a null structure and the action ``no_template``;
    a null ``supporting`` adds nothing, repeated turns are planned alike, no turns give no plans.
    """
    if rules.problems():
        raise ValueError("; ".join(rules.problems()))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    tags = lambda b: F.coalesce(_lookup({n: _strings(t) for n, t in rules.blocks.items()}, b, "array<string>"), _strings(()))
    has = lambda b, tag: F.array_contains(tags(b), tag)

    shape = "struct<blocks: array<string>, max_words: int, waits: boolean>"
    templates = {s: F.struct(_strings(t.blocks).alias("blocks"), F.lit(t.max_words).alias("max_words"), F.lit(t.waits).cast("boolean").alias("waits")) for s, t in rules.templates.items()}
    d = turns.withColumn("_t", _lookup(templates, F.col("primary"), shape))
    d = d.withColumn("waits", F.when(F.col("_t").isNotNull(), F.coalesce("_t.waits", yes("attempt"))))

    support = {s: F.struct(F.lit(b).alias("block"), F.lit(r).alias("replies")) for s, (b, r) in rules.supporting.items()}

    def add(state: Column, strategy: Column) -> Column:
        s = _lookup(support, strategy, "struct<block: string, replies: boolean>")
        known = F.array_contains(state["blocks"], s["block"])
        held = F.col("waits") & s["replies"]
        more = lambda blocks, actions: F.struct(blocks.alias("blocks"), actions.alias("actions"))
        return (
            F.when(s.isNull(), more(state["blocks"], F.array_append(state["actions"], _action("unknown_supporting_strategy", strategy))))
            .when(known, state)
            .when(held, more(state["blocks"], F.array_append(state["actions"], _action("deferred_to_next_turn", s["block"]))))
            .otherwise(more(F.array_append(state["blocks"], s["block"]), state["actions"]))
        )

    none = F.array().cast(f"array<{_ACTION}>")
    fold_type = f"struct<blocks: array<string>, actions: array<{_ACTION}>>"
    asked = F.coalesce(F.col("supporting"), _strings(()))
    begun = F.struct(F.coalesce("_t.blocks", _strings(())).alias("blocks"), none.alias("actions")).cast(fold_type)
    d = d.withColumn("_s", F.aggregate(asked, begun, lambda a, s: add(a, s).cast(fold_type)))
    d = d.withColumn("added", F.array_except("_s.blocks", F.coalesce("_t.blocks", _strings(()))))

    # constraint, whether it holds, a tag that must be in the plan for it, the tags that it takes away
    constraints = F.array(*[
        F.struct(F.lit(rule).alias("rule"), holds.alias("holds"), F.lit(needs).cast("string").alias("needs"), _strings(gone).alias("gone"))
        for rule, holds, needs, gone in (
            ("full_solution_withheld", ~yes("full"), None, ("solution",)),
            ("direct_answer_prohibited", ~yes("direct"), None, ("solution",)),
            ("quiz_answer_withheld", F.lit(not rules.answer_before_attempt), None, ("answer_key",)),
            ("hint_first_and_full_solution_same_turn", F.lit(not rules.hint_with_solution), "hint", ("solution", "steps")),
        )
    ])

    def take(state: Column, c: Column) -> Column:
        there = c["needs"].isNull() | F.exists(state["blocks"], lambda b: F.array_contains(tags(b), c["needs"]))
        goes = lambda b: c["holds"] & there & F.arrays_overlap(tags(b), c["gone"])
        gone = F.transform(F.filter(state["blocks"], goes), lambda b: _action(c["rule"], b))
        return F.struct(F.filter(state["blocks"], lambda b: ~goes(b)).alias("blocks"), F.concat(state["actions"], gone).alias("actions")).cast(fold_type)

    declared = F.filter("_s.blocks", lambda b: b.isin(*rules.blocks))
    d = d.withColumn("_c", F.aggregate(constraints, F.struct(declared.alias("blocks"), F.col("_s.actions").alias("actions")).cast(fold_type), take))
    questions = F.filter("_c.blocks", lambda b: has(b, "question"))
    closing = F.slice(questions, 1, rules.max_questions) if rules.max_questions > 0 else _strings(())
    over = F.slice(questions, rules.max_questions + 1, F.greatest(F.size(questions), F.lit(1)))
    d = d.withColumn("_p", F.concat(F.filter("_c.blocks", lambda b: ~has(b, "question")), closing))
    rescue = F.coalesce(F.get(F.filter("_t.blocks", lambda b: has(b, "question")), F.lit(0)), F.lit(BARE_QUESTION))
    bare = F.size("_p") == 0
    d = d.withColumn("structure", F.when(F.col("_t").isNotNull(), F.when(bare, F.array(rescue)).otherwise(F.col("_p"))))
    states = F.exists("structure", lambda b: has(b, "solution"))
    if_so = lambda holds, action: F.when(holds, F.array(action)).otherwise(none)
    actions = F.when(F.col("_t").isNull(), F.array(_action("no_template", F.col("primary")))).otherwise(F.concat(
        F.col("_c.actions"), F.transform(over, lambda b: _action("max_questions", b)), if_so(bare, _action("empty_structure_recovered", rescue)),
        if_so(yes("full") & ~states, _action("full_solution_not_stated_this_turn", F.lit(None))),
    ))
    level = F.coalesce(F.col("level"), F.lit("beginner"))
    d = d.withColumns({"actions": actions, "full_solution": F.coalesce(yes("full") & states, F.lit(False)), "max_words": F.col("_t.max_words"), "level": level, "wording": _lookup({n: F.lit(w) for n, w in rules.wording.items()}, level, "string")})
    return d.drop("_t", "_s", "_c", "_p")
