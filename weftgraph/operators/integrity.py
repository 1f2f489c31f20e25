"""Tables that refer to each other, checked as one: every problem of every table in one report.

Each table is read once.  Its cells become rows of (check, value), and one
aggregation over all tables answers all checks: a reference is unknown where a value
was referred to and never declared, so no table is joined, and a value that a third of
all rows hold is combined before it is sent.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CELL = "array<struct<check: int, refers: boolean, value: string>>"


@dataclass(frozen=True)
class Declared:
    """What must hold; a column may be an array, whose elements are then its values.

    rows: table -> the column that names a row in the report.
    keys: (table, column): not null and of one row.
    references: (table, column, other table, other column): null or a value of the other.
    allowed: (table, column, values): null or one of them.
    required: (table, column): neither null nor blank.
    wildcards: values that need no declaration and are always allowed.
    """

    rows: Mapping[str, str]
    keys: Sequence[tuple[str, str]] = ()
    references: Sequence[tuple[str, str, str, str]] = ()
    allowed: Sequence[tuple[str, str, Sequence[str]]] = ()
    required: Sequence[tuple[str, str]] = ()
    wildcards: Sequence[str] = field(default=("any",))


def table_findings(tables: Mapping[str, DataFrame], declared: Declared) -> DataFrame:
    """``table, column, problem, value, n_rows, first_row``: a row per table, column and wrong value.

    Problems are ``duplicate key``, ``missing key``, ``unknown in <table>.<column>``, ``not allowed``
    and ``missing value``.  ``n_rows`` counts the cells (a repeated row counts again), ``first_row`` is
    the least of their rows' names as text.  Empty tables declare nothing and have no problems, texts of any
    length are compared whole, and columns that no check names are not read.  A table or column that is
    declared but not there raises ValueError with all such names.
    """
    used = [(t, c) for t, c in declared.rows.items()] + [*declared.keys, *declared.required] + [x[:2] for x in (*declared.references, *declared.allowed)] + [x[2:] for x in declared.references]
    gone = sorted({f"{t}.{c}" for t, c in used if t not in tables or c not in tables[t].columns} | {f"{t}: no row name" for t, _ in used if t not in declared.rows})
    if gone:
        raise ValueError("not there: " + ", ".join(gone))
    checks: list[tuple[str, str, str]] = []  # table, column, kind
    cells: dict[str, list[Column]] = {}

    def values(t: str, c: str) -> Column:
        kind = tables[t].schema[c].dataType
        return F.col(c).cast("array<string>") if isinstance(kind, T.ArrayType) else F.array(F.col(c).cast("string"))

    def emit(t: str, c: str, number: int, refers: bool, keep) -> None:
        made = F.transform(F.filter(values(t, c), keep), lambda v: F.struct(F.lit(number).alias("check"), F.lit(refers).alias("refers"), v.alias("value")))
        cells.setdefault(t, []).append(F.coalesce(made.cast(_CELL), F.array().cast(_CELL)))

    plain = lambda v: v.isNotNull() & ~v.isin(*declared.wildcards) if declared.wildcards else v.isNotNull()
    other_than = lambda good: lambda v: plain(v) & ~v.isin(*good)
    for t, c in declared.keys:
        emit(t, c, len(checks), True, lambda v: F.lit(True))
        checks.append((t, c, "key"))
    for t, c, to, of in declared.references:
        emit(t, c, len(checks), True, plain)
        emit(to, of, len(checks), False, lambda v: v.isNotNull())
        checks.append((t, c, f"unknown in {to}.{of}"))
    for t, c, good in declared.allowed:
        emit(t, c, len(checks), True, other_than(good))
        checks.append((t, c, "not allowed"))
    for t, c in declared.required:
        emit(t, c, len(checks), True, lambda v: v.isNull() | ~v.rlike(r"(?U)\S"))
        checks.append((t, c, "missing value"))
    parts = [tables[t].select(F.col(declared.rows[t]).cast("string").alias("row"), F.explode(F.concat(*made)).alias("x")).select("row", "x.*") for t, made in cells.items()]
    if not parts:
        raise ValueError("nothing is declared")
    every = reduce(DataFrame.unionByName, parts)
    met = every.groupBy("check", "value").agg(F.count_if("refers").alias("n_rows"), F.min(F.when(F.col("refers"), F.col("row"))).alias("first_row"), F.count_if(~F.col("refers")).alias("n_declared"))
    text = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in checks]), F.col("check") + 1)
    kind = text(2)
    problem = F.when(kind != "key", kind).when(F.col("value").isNull(), F.lit("missing key")).when(F.col("n_rows") > 1, F.lit("duplicate key"))
    found = met.filter((F.col("n_rows") > 0) & (F.col("n_declared") == 0))
    return found.select(text(0).alias("table"), text(1).alias("column"), problem.alias("problem"), "value", "n_rows", "first_row").filter("problem is not null")


def table_versions(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table, n_rows, version``: twelve hexadecimal digits of what the rows say, whatever their order and files.

    A row's digest covers column names, values and nulls; repeated rows count.  A table's digests are
    added up, so no row is gathered; an empty table's version says its columns only.
    """
    out = []
    for name, df in tables.items():
        said = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
        part = F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("decimal(38,0)")
        total = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(part), F.lit(0).cast("decimal(38,0)")).alias("total"))
        columns = F.lit(",".join(sorted(df.columns)))
        out.append(total.select(F.lit(name).alias("table"), "n_rows", F.substring(F.sha2(F.concat_ws("|", columns, "n_rows", "total"), 256), 1, 12).alias("version")))
    return reduce(DataFrame.unionByName, out)
