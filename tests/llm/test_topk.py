import numpy as np
from pyspark.sql import functions as F

from lorequarry.llm import topk

LONG = 2**63 - 1


def brute(rows, k, every):
    vectors = [(i, [int(np.floor(64 * v)) for v in x]) for i, x in rows if i is not None and x and all(v is not None and np.isfinite(v) for v in x)]
    out = []
    for i in sorted({i for i, _ in vectors if i % every == 0}):
        own = min((len(v), v) for j, v in vectors if j == i)[1]
        found = sorted((-max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(own, v)))), j) for j, v in vectors if j != i and len(v) == len(own))[:k]
        out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(found)]
    return out


def run(spark, rows, k=5, **sizes):
    df = spark.createDataFrame([(i, x, "clash", 1) for i, x in rows], "vec_id long, embedding array<double>, norm string, dim int")
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_top_k(df, F.col("vec_id") % 20 == 0, k, 64.0, **sizes).collect())


def test_all_prunings_agree_with_brute_force(spark):
    r = np.random.default_rng(1)
    centers = r.normal(size=(30, 8))
    x = centers[r.integers(0, 30, 1500)] * np.exp(r.normal(size=(1500, 1))) + r.normal(size=(1500, 8)) * 0.02
    x[100] = x[101] = x[102] = x[140]
    x[0] = 0
    rows = [(i, [float(v) for v in v]) for i, v in enumerate(x)]
    rows += [(5000, None), (5020, [1.0] * 8), (5021, [float("nan")] * 8), (5022, [None] * 8), (5040, [1.0, 2.0]), (5041, [3.0, 1.0]), (5060, [1e300] * 8), (None, [1.0] * 8), (5080, []), (5081, [float("inf")] * 8), (5100, [-9.0] * 3)]
    assert run(spark, rows, bucket_rows=100, query_rows=16, cell=4) == brute(rows, 5, 20)


def test_coordinates_prune_nothing_that_counts():
    r = np.random.default_rng(2)
    for _ in range(300):
        q, x = r.normal(size=6), r.normal(size=(50, 6)) * 3
        x[:10] = q * r.uniform(0.5, 3, (10, 1)) + r.normal(size=(10, 6)) * 0.2
        x = x[np.argsort(-np.linalg.norm(x, axis=1))]
        norms, scores = np.linalg.norm(x, axis=1), x @ q
        bound = np.sort(scores)[-r.integers(1, 12)]
        kept = topk.survivors(q, np.linalg.norm(q), bound, x, norms)
        kept = np.arange(50) if kept is None else kept
        assert set(np.flatnonzero(scores >= bound + 1e-9)) <= set(kept)


def test_repeats_and_empty(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]
    assert run(spark, rows) == [(20, 1, 1, 2048), (20, 2, 1, 2048), (20, 3, 2, 2048)]
    assert run(spark, []) == [] and run(spark, [(20, [1.0])]) == []
