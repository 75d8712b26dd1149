import random

from lorequarry.llm.common import bounded_sample, connected_components


def test_chains_stars_and_cycles(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    links += [(b, a) for a, b in links]
    r.shuffle(links)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    expected = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200, 202: 200}
    assert got == expected
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_bounded_sample(spark):
    df = spark.range(5000).selectExpr("id", "if(id % 10 = 0, 'rare', 'often') as label")
    got = bounded_sample(df, "label", "id", 100).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {"rare": 100, "often": 100}
    assert bounded_sample(df, "label", "id", 600).groupBy("label").count().collect() and bounded_sample(df.limit(0), "label", "id", 5).count() == 0
