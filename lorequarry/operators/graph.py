"""Groups in graphs of links: nearest neighbours that choose each other, and what hangs together by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize
from . import vector


def mutual_neighbours(rows: DataFrame, k: int, least: float) -> DataFrame:
    """(a, b, score): rows (id, embedding) that are among each other's k nearest with a cosine of at least `least`, a < b."""
    near = vector.knn(rows.select(F.col("id").alias("query_id"), "embedding"), rows.select("id", "embedding"), k, skip_self=True).filter(F.col("score") >= least)
    ends = near.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), "score")
    return ends.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("score").alias("score")).filter("n = 2").select("a", "b", "score")


def groups(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, first): every node of links (a, b) with the smallest node that it hangs together with.

    Every round a node takes the least name among its own and its neighbours', and then the name of the node so
    named, so names travel along doubling paths. Neighbours' names are minima of partial minima, so a hub is never gathered.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a is not null and b is not null").distinct(), "graph-links")
    named = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("first")), "graph-names")
    for _ in range(max_rounds):
        near = both.join(named.select(F.col("id").alias("b"), "first"), "b").groupBy(F.col("a").alias("id")).agg(F.min("first").alias("m"))
        own = named.join(near, "id").select("id", F.least("first", "m").alias("first"))
        jump = own.join(named.select(F.col("id").alias("first"), F.col("first").alias("further")), "first").select("id", F.least("first", "further").alias("first"))
        before, named = named, materialize(jump, "graph-names")
        moved = not named.join(before.withColumnRenamed("first", "was"), "id").filter("first <> was").isEmpty()
        discard(before)
        if not moved:
            discard(both)
            return named
    raise RuntimeError("the groups did not settle")
