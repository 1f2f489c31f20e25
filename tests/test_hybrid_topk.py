"""Hybrid search with a query set that grows with the table."""

import random

import duckdb
from pyspark.sql import functions as F

from weftgraph import catalogue
from weftgraph.operators import retrieval


def vectors(n, seed=5):
    rnd = random.Random(seed)
    return [(k, [rnd.uniform(-1, 1) for _ in range(8)], rnd.randrange(4)) for k in range(n)]


def test_every_hundredth_row_is_a_query(spark, tmp_path):
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(vectors(1250), "vec_id long, embedding array<float>, label int").write.parquet(path)
    got = sorted(map(tuple, catalogue.QUERIES["hybrid_topk"](spark, str(tmp_path)).select("query_id", "chunk_id", "score", "rank").collect()))
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{path}/*.parquet'")
    assert got == sorted(c.execute(catalogue.ORACLES["hybrid_topk"]).fetchall())
    assert {x[0] for x in got} == set(range(0, 1250, 100)) and len(got) == 5 * 13


def test_blocks_of_queries_give_the_same(spark):
    e = spark.createDataFrame(vectors(90), "vec_id long, embedding array<float>, label int")
    q = e.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"), F.col("label").alias("query_label"))
    c = e.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    same = F.when(F.col("query_label") == F.col("label"), 1.0).otherwise(0.0)
    whole, parts = (sorted(map(tuple, retrieval.hybrid_topk(q, c, 3, keyword=same, block=b).collect())) for b in (100, 2))
    assert whole == parts and len(whole) == 27
