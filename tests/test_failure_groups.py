"""Failed questions by content: planted groups, chains, and groups of a graph against a plain search."""

import random

import numpy as np

from lorequarry.operators import graph
from lorequarry.plans import evaluate


def test_groups_of_a_graph(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(rng.randrange(1000, 1080), rng.randrange(1000, 1080)) for _ in range(60)] + [(7, 7), (None, 3), (100, 101), (101, 100)]
    found = {r.id: r["first"] for r in graph.groups(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {n: n for pair in links if None not in pair for n in pair}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert found == {n: root(n) for n in parent}
    assert graph.groups(spark.createDataFrame([], "a long, b long")).count() == 0


def test_planted_groups_are_found(spark):
    r = np.random.default_rng(5)
    centres = np.linalg.qr(r.normal(size=(16, 16)))[0][:4]
    rows = []
    for g, centre in enumerate(centres):
        for i in range(6):
            v = centre + r.normal(size=16) * 0.05
            rows.append((100 * (g + 1) + i, [float(x) for x in v], "recall" if i < 4 else "precision"))
    rows += [(900, [1.0] + [0.0] * 15, "alone"), (901, None, "no vector"), (902, [0.0] * 16, None), (None, [1.0] * 16, "lost"), (100, rows[0][1], "recall")]
    found = {x["first"]: x for x in evaluate.failure_groups(spark.createDataFrame(rows, "id long, embedding array<double>, reason string")).collect()}
    assert set(found) == {100, 200, 300, 400, 900, 901, 902}
    for g in (100, 200, 300, 400):
        assert (found[g].n, found[g].reason, found[g].share, found[g].examples) == (6, "recall", 0.666667, [g, g + 1, g + 2])
    assert found[902].n == 1 and found[902].reason is None


def test_mutual_neighbours_against_all_pairs(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(60, 3))
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    best = [{j for j in sorted(range(60), key=lambda j: (-s[i, j], j))[:4] if s[i, j] >= 0.9} for i in range(60)]
    want = {(i, j) for i in range(60) for j in best[i] if i < j and i in best[j]}
    got = graph.mutual_neighbours(spark.createDataFrame(rows, "id long, embedding array<double>"), 4, 0.9).collect()
    assert {(p.a, p.b) for p in got} == want and len(got) == len(want)
