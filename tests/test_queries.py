"""Every query with an SQL form against it, on the smallest tables."""

import duckdb
import pytest

from weftgraph import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, duck, name):
    cur = duck.execute(catalogue.ORACLES[name])
    cols = [d[0] for d in cur.description]
    df = catalogue.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(repr(plain(tuple(r))) for r in df.select(*cols).collect()) == sorted(repr(plain(r)) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    first, again = (sorted(map(repr, catalogue.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert first == again


def test_entry_without_the_document_subpackage(tmp_path):
    """The entry module imports and lists queries when the subpackage is gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "weftgraph", tmp_path / "weftgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bfs_two_hop' in q and not any(k.startswith('op') for k in q); print(len(e.oracle_sql()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout) > 30
