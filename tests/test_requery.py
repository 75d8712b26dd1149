"""Queries that are asked again: only the open ones, until they are good or at the last round."""

import pytest
from pyspark.sql import functions as F

from lorequarry.plans import run


@pytest.mark.parametrize(("rounds", "asked", "best"), [(1, [{1, 2, 3, 4}], {1: 1, 2: 1, 3: 1}), (2, [{1, 2, 3, 4}, {2, 3}], {1: 1, 2: 2, 3: 1}), (5, [{1, 2, 3, 4}, {2, 3}, {3}, {3}, {3}], {1: 1, 2: 2, 3: 4})])
def test_rounds(spark, rounds, asked, best):
    """1 is good at once, 2 in the second round, 3 never, and its fourth round is the best; 4 finds nothing and isn't rewritten."""
    scores = {(1, 1): 9.0, (2, 1): 1.0, (2, 2): 8.0, (3, 1): 3.0, (3, 2): 2.0, (3, 3): 3.0, (3, 4): 4.0, (3, 5): 4.0}
    table = spark.createDataFrame([(q, f"try {r}", 100 * q + r, s) for (q, r), s in scores.items()], "query_id long, query string, id long, score double")
    seen = []

    def retrieve(queries):
        seen.append({r.query_id for r in queries.collect()})
        return queries.join(table, ["query_id", "query"]).select("query_id", "id", "score")

    def rewrite(waiting, hits):
        number = F.regexp_extract("query", r"(\d+)", 1).cast("int") + 1
        return waiting.filter("query_id <> 4").withColumn("query", F.concat(F.lit("try "), number))

    queries = spark.createDataFrame([(q, "try 1") for q in (1, 2, 3, 4)] + [(None, "try 1")], "query_id long, query string")
    found = {r.query_id: (r["round"], r.id) for r in run.asked_again(queries, retrieve, rewrite, 5.0, rounds).collect()}
    assert seen == asked
    assert found == {q: (r, 100 * q + r) for q, r in best.items()}


def test_no_queries(spark):
    none = spark.createDataFrame([], "query_id long, query string")
    assert run.asked_again(none, lambda q: q.select("query_id", F.lit(1).alias("id"), F.lit(1.0).alias("score")), lambda q, h: q, 1.0).count() == 0
