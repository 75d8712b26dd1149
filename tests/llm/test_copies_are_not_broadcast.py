"""Rows that are exploded into copies look as small to Spark as the files that they come from; they must not be broadcast."""

import pytest
from pyspark.sql import functions as F

from lorequarry.llm import simhash, topk
from lorequarry.llm.common import materialize
from lorequarry.operators import vector


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("max_bits", [1, 2])
def test_cells_of_fingerprints(spark, max_bits):
    prints = materialize(spark.range(500).select(F.xxhash64("id").alias("fp")), "prints")
    assert "BroadcastHashJoin" not in plan(simhash.near_links(prints, max_bits))
    assert "BroadcastHashJoin" not in plan(simhash.stars(prints, max_bits))


def test_query_blocks(spark):
    rows = materialize(spark.range(60).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.sin(i * F.col("id"))).alias("embedding")), "rows")
    assert "BroadcastHashJoin" not in plan(topk.exact_top_k(rows, F.col("vec_id") % 5 == 0, 3, bucket_rows=8, query_rows=4))
    asked, corpus = rows.select(F.col("vec_id").alias("query_id"), "embedding"), rows.select(F.col("vec_id").alias("id"), "embedding")
    assert "BroadcastHashJoin" not in plan(vector._blockwise(asked, corpus, 3, True))
