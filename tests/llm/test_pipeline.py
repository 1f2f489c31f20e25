"""The pipeline against its parts, in plain Python where they allow it."""

import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from weftgraph.llm import queries, simhash_pivots

from . import edge
from .test_operators import mixed, tokenizer

SF = "/root/testdata/sf0.001"


def test_stages_on_their_own_inputs(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        seen.append([tuple(r) for r in docs.collect()])
        docs = spark.read.parquet(str(tmp_path / str(k)))
    seen.append([tuple(r) for r in docs.collect()])
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    assert good & {r[0] for r in seen[0]} <= {r[0] for r in seen[1]}
    heads = {c for _, _, c in simhash_pivots.brute_force([(r[0], r[1]) for r in seen[1]])}
    assert {r[0] for r in seen[2]} == heads and len(seen[2]) == len(heads)
    flat = lambda t: " ".join(t.split())
    items = [flat(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r[0] for r in seen[3]} == {r[0] for r in seen[2] if not any(q in flat(r[1]) for q in items)}
    size, src, total, target = mixed(seen[3])
    taken = {}
    for r in seen[4]:
        taken[r[3]] = taken.get(r[3], 0) + len(r[1].split())
    most = max(size)
    assert all(abs(taken.get(s, 0) - target[s]) <= most for s in total)
    t = tokenizer()
    ids = [t.encode(r[1], add_special_tokens=False).ids + [2] for r in sorted(seen[4], key=lambda r: r[0])]
    assert sorted((r[2], r[3]) for r in seen[5]) == sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids)


def test_run_handles_odd_rows(spark, tmp_path):
    edge.documents(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    edge.labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, edge.prose(9, 40))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = sorted(out.collect(), key=lambda r: r.start)
    assert rows and [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    copies, contaminated = {2, 15}, {10, 11}
    assert not {r.doc_id for r in rows} & (copies | contaminated)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cur = c.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, cur.fetchall()))


def test_plans_read_only_what_they_need(spark):
    plan = queries.queries()["op3_line_rules"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan and "Python" not in plan
