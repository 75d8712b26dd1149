import numpy as np
import pytest
from pyspark.sql import functions as F

from lorequarry.llm import embedding_dedup


def brute(rows, bound):
    """n_links and component of each row position."""
    n = len(rows)
    usable = [lab is not None and x is not None and len(x) > 0 and all(v is not None and np.isfinite(v) for v in x) and any(x) for _, lab, x in rows]
    links, parent = [0] * n, list(range(n))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i in range(n):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]):
                a, b = np.array(rows[i][2]), np.array(rows[j][2])
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= bound:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    low = {}
    for i in range(n):
        low[root(i)] = min(low.get(root(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], low[root(i)], rows[i][0] == low[root(i)]) for i in range(n))


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, lab, x, "clash", 1) for i, lab, x in rows], "vec_id long, label int, embedding array<double>, keys string, part int")
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, 0.93, **more).collect())


def test_against_all_pairs(spark):
    r = np.random.default_rng(3)
    rows = []
    for g in range(25):
        center = r.normal(size=32)
        rows += [(len(rows) + 100 * k, int(g % 3), [float(v) for v in center + r.normal(size=32) * 0.12]) for k in range(r.integers(1, 14))]
    x = rows[5][2]
    rows += [(9000 + i, rows[5][1], x) for i in range(40)]  # copies
    rows += [(9100, None, x), (9101, rows[5][1], None), (9102, 0, [0.0] * 32), (9103, 0, [float("nan")] * 32), (9104, 0, [None] * 32), (9105, 0, []), (9106, 0, [1.0, 2.0]), (9107, 0, [2.0, 4.1]), (9108, 7, x)]
    rows = list({i: (i, lab, v) for i, lab, v in rows}.values())
    expected = brute(rows, 0.93)
    for part in (1024, 8):
        got = run(spark, rows, part=part)
        found, there = sum(n for _, n, _, _ in got), sum(n for _, n, _, _ in expected)
        assert found >= 0.99 * there and all(g[1] <= e[1] for g, e in zip(got, expected))
        assert got == expected


def test_small_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(3, 1, [1.0, 1.0]), (3, 1, [1.0, 1.0])]) == [(3, 1, 3, True), (3, 1, 3, True)]


def test_learned_codes_keep_near_vectors_together():
    r = np.random.default_rng(5)
    x = embedding_dedup.unit(r.normal(size=(3000, 64)))
    y = embedding_dedup.unit(x + 0.045 * r.normal(size=x.shape))
    cos = (x * y).sum(1)
    coder = embedding_dedup.Coder({64: x[:1000]}, 0.93)
    met = (coder.substrings(x) == coder.substrings(y)).any(1)
    assert met[cos >= 0.93].mean() > 0.99


@pytest.mark.parametrize("dim", [8, 12, 16, 24, 32, 48, 64, 128])
def test_pairs_at_the_bound_meet(dim):
    r = np.random.default_rng(dim)
    x = embedding_dedup.unit(r.normal(size=(4000, dim)))
    side = r.normal(size=x.shape)
    side = embedding_dedup.unit(side - (side * x).sum(1)[:, None] * x)
    y = 0.9301 * x + np.sqrt(1 - 0.9301**2) * side
    for width in (12, 16):
        coder = embedding_dedup.Coder({dim: x[:2000]}, 0.93, substring=width)
        met = (coder.substrings(x) == coder.substrings(y)).any(1)
        assert met[2000:].mean() >= 0.985 and met.mean() >= 0.99  # on vectors that the rotations haven't seen, and on all


@pytest.mark.parametrize("dim", [2, 5, 8, 16])
def test_short_vectors_against_all_pairs(spark, dim):
    r = np.random.default_rng(dim)
    rows = [(i, i % 2, [float(v) for v in np.round(r.normal(size=dim), 3)]) for i in range(160)]
    got, expected = run(spark, rows, part=40), brute(rows, 0.93)
    found, there = sum(n for _, n, _, _ in got), sum(n for _, n, _, _ in expected)
    assert found >= 0.95 * there and all(g[1] <= e[1] for g, e in zip(got, expected))


def test_keys_widen_with_the_largest_label(spark):
    rows = spark.range(3000).selectExpr("id as vec_id", "if(id < 2900, 1, 2) as label", "array(cast(id % 7 as double), 1.0D, cast(id % 11 as double)) as embedding")
    assert embedding_dedup.learn(rows, 0.93).substring == 12
    assert embedding_dedup.tables_for(0.93, 12) == 25 and embedding_dedup.tables_for(0.93, 16) == 44
    assert embedding_dedup.learn(rows, 0.93, substring=8, bucket=4).substring == 10


def test_a_hot_bucket_is_many_tasks_work(spark):
    """A third of all vectors in one bucket: no task takes more than its share of the pairs of parts."""
    r = np.random.default_rng(9)
    center = r.normal(size=16)
    rows = [(i, 1, [float(v) for v in (center + 0.01 * r.normal(size=16) if i % 3 == 0 else r.normal(size=16))]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    classes = df.select(F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("copies"), "label", "embedding")
    codes = embedding_dedup.coded(classes, embedding_dedup.learn(df, 0.93))
    hits = embedding_dedup.in_buckets(codes, 50)
    parts = {(r.table, r.key): r.parts for r in hits.filter("parts > 1").collect()}
    assert max(parts.values()) >= 10
    work = hits.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).groupBy("table", "key", F.least("part", "other"), F.greatest("part", "other")).count()
    assert work.agg(F.max("count")).first()[0] <= 4 * 50  # two parts of about 50
    assert run(spark, rows, part=50) == brute(rows, 0.93)
