"""Tables checked as one, and versions of what they say."""

import pytest
from pyspark.sql import functions as F
from weftgraph.operators import integrity


def tables(spark):
    rules = [("R1", "S1", ["S1", "S2"], "x"), ("R2", "any", ["S9", "S9"], " "), ("R3", None, None, None), ("R2", "S7", [None, "S2"], " "), (None, "S1", [], "y")]
    return {
        "rules": spark.createDataFrame(rules, "id string, strategy string, also array<string>, note string"),
        "strategies": spark.createDataFrame([(1, "S1"), (2, "S2"), (3, "S3"), (4, None)], "line int, id string"),
    }


DECLARED = integrity.Declared(
    rows={"rules": "id", "strategies": "line"},
    keys=[("rules", "id"), ("strategies", "id")],
    references=[("rules", "strategy", "strategies", "id"), ("rules", "also", "strategies", "id")],
    allowed=[("rules", "strategy", ["S1", "S2"])],
    required=[("rules", "note")],
)


def test_all_problems_of_all_tables(spark):
    got = {tuple(r) for r in integrity.table_findings(tables(spark), DECLARED).collect()}
    assert got == {
        ("rules", "id", "duplicate key", "R2", 2, "R2"),
        ("rules", "id", "missing key", None, 1, None),
        ("strategies", "id", "missing key", None, 1, "4"),
        ("rules", "strategy", "unknown in strategies.id", "S7", 1, "R2"),
        ("rules", "also", "unknown in strategies.id", "S9", 2, "R2"),
        ("rules", "strategy", "not allowed", "S7", 1, "R2"),
        ("rules", "note", "missing value", None, 1, "R3"),
        ("rules", "note", "missing value", " ", 1, "R2"),
        ("rules", "note", "missing value", " ", 1, "R2"),
    }


def test_empty_and_absent_tables(spark):
    none = {name: df.limit(0) for name, df in tables(spark).items()}
    assert integrity.table_findings(none, DECLARED).count() == 0
    with pytest.raises(ValueError, match="rules.gone"):
        integrity.table_findings(tables(spark), integrity.Declared({"rules": "id"}, keys=[("rules", "gone")]))
    with pytest.raises(ValueError, match="strategies: no row name"):
        integrity.table_findings(tables(spark), integrity.Declared({"rules": "id"}, keys=[("strategies", "id")]))


def test_versions(spark):
    version = lambda **t: {r.table: (r.n_rows, r.version) for r in integrity.table_versions(t).collect()}
    a = tables(spark)["rules"]
    first = version(a=a, b=a.orderBy(F.desc("id")).repartition(3), c=a.union(a.limit(1)), d=a.fillna("z", ["strategy"]), e=a.withColumnRenamed("note", "other"), f=a.limit(0))
    assert first["a"] == first["b"] and len({v for _, v in first.values()}) == 5 and first["f"][0] == 0
    assert all(len(v) == 12 for _, v in first.values()) and version(a=a)["a"] == first["a"]
