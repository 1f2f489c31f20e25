"""What the pipeline's Python workers keep beside each other."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from weftgraph.llm import quality_fm, simhash_pivots, token_files, words

from . import edge


@pytest.fixture
def no_plain_workers(spark, monkeypatch):
    """Rows of a Python list may not be sent: they pass through workers of another daemon."""

    def refuse(*_, **__):
        raise AssertionError("rows of a list pass through plain Python workers")

    monkeypatch.setattr(SparkContext, "parallelize", refuse)


def test_token_files_start_no_plain_workers(spark, tmp_path, request):
    docs = edge.documents(spark)
    want = docs.count()
    request.getfixturevalue("no_plain_workers")
    source = str(public_tokenizers.path("word_bpe_49k.json"))
    shards = token_files.write(docs, str(tmp_path / "a"), source, shard_bytes=30_000)
    assert [c for c in shards.dtypes] == [("shard", "int"), ("base", "bigint"), ("n_docs", "bigint"), ("n_tokens", "bigint")]
    rows = shards.orderBy("shard").collect()
    assert len(rows) > 1 and sum(r.n_docs for r in rows) == want
    assert [r.base for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    assert token_files.read(shards, str(tmp_path / "a")).count() == want


def test_crowded_buckets_start_no_plain_workers(spark, request):
    r = random.Random(5)
    top = r.getrandbits(33) << 31
    values = sorted({top | r.getrandbits(31) for _ in range(80)} | {top | 1 << k for k in range(4)})
    fps = spark.range(len(values)).select(F.element_at(F.array(*[F.lit(simhash_pivots._signed(v)) for v in values]), (F.col("id") + 1).cast("int")).alias("fp"))
    request.getfixturevalue("no_plain_workers")
    edges = {(e.a % (1 << 64), e.b % (1 << 64)) for e in simhash_pivots.links(fps, bucket=4).collect()}
    root = {v: v for v in values}

    def find(pairs):
        root.update((v, v) for v in values)
        for a, b in pairs:
            old, new = root[a], root[b]
            root.update((v, new) for v in values if root[v] == old)
        return {frozenset(v for v in values if root[v] == x) for x in root.values()}

    near = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3]
    assert near and find(edges) == find(near)


def test_a_block_takes_little_memory(monkeypatch):
    r = random.Random(3)
    known = ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(2000)]
    column = pa.array([" ".join(r.choices(known, k=300)) + " don't 3.14 é" for _ in range(2600)])
    assert column.nbytes > 4 << 20
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        enc = token_files.Encoder(f.read())
    enc.encode(column.slice(0, 50), 2)

    def ids():
        return [enc.encode(column.slice(lo, hi - lo), 2)[0].tobytes() for lo, hi in words.slices(column, token_files.BLOCK)]

    tracemalloc.start()
    try:
        found = ids()
        most = tracemalloc.get_traced_memory()[1] - sum(map(len, found))
    finally:
        tracemalloc.stop()
    assert most < 32 << 20
    monkeypatch.setattr(token_files, "BLOCK", 2 << 20)
    assert b"".join(ids()) == b"".join(found)


def test_a_scored_block_takes_little_memory(spark):
    r = random.Random(4)
    known = ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(20000)]
    column = pa.array([" ".join(r.choices(known, k=300)) for _ in range(1400)])
    chars = np.full(len(column), 1800.0)
    machine = quality_fm.Machine()
    machine.w = np.random.default_rng(1).normal(0, 0.1, len(machine.w))
    seen = []

    class Watched(quality_fm.Machine):
        def score(self, text, n_chars):
            seen.append(text.nbytes)
            return machine.score(text, n_chars)

    class Docs:
        columns = ["text"]
        sparkSession = spark

    whole = machine.score(column, chars)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality_fm, "train", lambda *_, **__: Watched())
        m.setattr(quality_fm.F, "arrow_udf", lambda _: lambda f: lambda *_: f)
        m.setattr(type(spark.sparkContext), "broadcast", lambda _, x: type("B", (), {"value": x}))
        run = quality_fm._scored(Docs, None, "quality", (3, 1), "doc_id", "text", "n_chars")
    tracemalloc.start()
    try:
        (found,) = run(iter([(column, pa.array(chars))]))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.to_numpy().tobytes() == whole.tobytes()
    assert max(seen) < 512 << 10 and most < 24 << 20
