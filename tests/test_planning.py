"""Response plans of single turns, and of odd ones."""

import pytest
from weftgraph.catalogue_sets import PLANNING
from weftgraph.operators import planning

COLUMNS = "turn_id int, primary string, supporting array<string>, direct boolean, full boolean, attempt boolean, level string, waits string"


def plans(spark, *turns):
    d = planning.plan_responses(spark.createDataFrame([(k, *t, "an extra column") for k, t in enumerate(turns)], COLUMNS), PLANNING)
    return [d.schema.names, *(r.asDict(True) for r in d.orderBy("turn_id").collect())]


def test_plans(spark):
    names, a, b, c, d, e = plans(
        spark,
        ("S01", ["S02", "S02", "S04", "S06"], True, True, False, None),
        ("S02", ["S06", "S03"], True, True, True, "advanced"),
        ("S05", [], False, True, False, "beginner"),
        ("S04", None, None, None, None, "other"),
        ("S03", ["S05"], True, True, True, None),
    )
    assert "waits" in names and not [n for n in names if n.startswith("_")]
    # one hint, the question of the template closes the plan, the quiz question is one too many
    assert a["structure"] == ["hook", "explanation", "hint", "feedback", "check_question"] and a["added"] == ["hint", "quiz_question", "feedback"]
    assert [(x["rule"], x["block"]) for x in a["actions"]] == [("max_questions", "quiz_question"), ("full_solution_not_stated_this_turn", None)]
    # what acts on a reply waits; a hint takes the solution away
    assert b["structure"] == ["hint", "check_question"] and b["waits"] and not b["full_solution"] and b["wording"] == "terms"
    assert [(x["rule"], x["block"]) for x in b["actions"]] == [("deferred_to_next_turn", "feedback"), ("hint_first_and_full_solution_same_turn", "worked_solution"), ("full_solution_not_stated_this_turn", None)]
    # a plan that would be empty asks
    assert c["structure"] == ["single_check_question"] and [x["rule"] for x in c["actions"]] == ["direct_answer_prohibited", "empty_structure_recovered", "full_solution_not_stated_this_turn"]
    assert d["structure"] == ["quiz_question"] and d["waits"] and d["wording"] is None and [x["rule"] for x in d["actions"]] == ["full_solution_withheld"]
    assert e["structure"] == ["explanation", "worked_solution", "recap"] and e["waits"] and e["full_solution"] and e["actions"] == [] and e["level"] == "beginner"


def test_odd_turns(spark):
    _, a, b = plans(spark, (None, ["S01"], True, True, True, None), ("S01", [None, "nobody"], True, False, None, ""))
    assert a["structure"] is None and not a["full_solution"] and [(x["rule"], x["block"]) for x in a["actions"]] == [("no_template", None)]
    assert b["structure"] == ["hook", "explanation", "check_question"] and [x["block"] for x in b["actions"]] == [None, "nobody"]
    assert plans(spark)[1:] == []


def test_tables_are_checked_as_one(spark):
    broken = planning.Planning({"S01": planning.Template(("hook",), 0)}, {"S02": ("gone", False)}, {"tip": ("advice",)}, {})
    assert broken.problems() == ["template S01: no block hook", "supporting S02: no block gone", "block tip: no tag advice", "template S01: no words allowed"]
    with pytest.raises(ValueError, match="no block gone"):
        plans_of = spark.createDataFrame([], COLUMNS)
        planning.plan_responses(plans_of, broken)
