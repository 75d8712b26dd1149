"""Vectors that meet by key, in pairs of lanes of blocks: equal to plain loops, and no row for a pair of vectors or blocks."""

import numpy as np
from pyspark.sql import functions as F

from lorequarry.operators import vector
from lorequarry.plans import run


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def made(spark, n=300, keys=3):
    r = np.random.default_rng(4)
    rows = [(i, i % keys, [float(v) for v in r.normal(size=6)]) for i in range(n)]
    return rows, spark.createDataFrame([*rows, (1000, 0, None), (1001, None, [1.0] * 6), (1002, 1, [0.0] * 6)], "id long, g int, embedding array<float>").repartition(3)


def cosine(a, b):
    a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
    return round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6)


def test_blocks_meet_without_rows_of_both(spark, monkeypatch):
    """a task gets each block of a pair of lanes once, not once for every block it meets."""
    monkeypatch.setattr(vector, "MATRIX_QUERIES", 2)
    monkeypatch.setattr(vector, "BLOCK", 16)
    rows, corpus = made(spark)
    found = vector.knn(corpus.select(F.col("id").alias("query_id"), "embedding"), corpus, 4, skip_self=True)
    assert "CoGroup" in plan(found) and "Join" not in plan(found)
    got = {}
    for x in found.collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.id))
    for i, _, v in rows[::25]:
        want = sorted((j for j, _, _ in rows if j != i), key=lambda j: (-cosine(v, rows[j][2]), j))[:4]
        assert [j for _, j in sorted(got[i])] == want


def test_staged_scores_no_pair_by_itself(spark, monkeypatch):
    """rows of the nearest groups are scored by blocks."""
    monkeypatch.setattr(vector, "BLOCK", 16)
    rows, corpus = made(spark, keys=5)
    asked = corpus.filter("id % 20 = 0 and id < 300").select(F.col("id").alias("query_id"), "embedding")
    found = run.staged(asked, corpus.filter("id < 300"), "g", 2, 3)
    assert "CoGroup" in plan(found)
    means = {g: np.mean([np.array(v, np.float32).astype(float) for _, h, v in rows if h == g], axis=0) for g in range(5)}
    got = {}
    for x in found.collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.id, x.score))
    assert len(got) == 15
    for q, hits in got.items():
        near = sorted(means, key=lambda g: (-cosine(rows[q][2], means[g]), g))[:2]
        want = sorted(((-cosine(rows[q][2], v), j) for j, g, v in rows if g in near and j != q))[:3]
        assert [(j, s) for _, j, s in sorted(hits)] == [(j, -s) for s, j in want]


def test_guardrail_by_blocks(spark):
    """the best cosine of an answer with its key's chunks, without a row for each pair; null where none can be compared."""
    rows, corpus = made(spark)
    answers = corpus.filter("id % 30 = 0 or id > 900").select(F.col("id").alias("answer_id"), "g", F.col("embedding").alias("answer_vec"))
    found = vector.guardrail(answers, corpus.filter("id % 30 > 0 and id < 300").select("g", F.col("embedding").alias("chunk_vec")), "g", 0.7)
    assert "CoGroup" in plan(found)
    got = {x.answer_id: (x.best, x.grounded) for x in found.collect()}
    want = {i: max(cosine(v, w) for j, h, w in rows if h == g and j % 30) for i, g, v in rows if i % 30 == 0}
    assert got == {i: (b, b >= 0.7) for i, b in want.items()} | {1000: (None, None), 1002: (None, None)}
