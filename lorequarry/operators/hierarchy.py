"""Parent-pointer forests: children lists and breadcrumbs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def children(nodes: DataFrame) -> DataFrame:
    """(id, child_ids): each node's children once, in order of id; nodes is (id, parent_id)."""
    kids = nodes.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.sort_array(F.collect_set("id")).alias("child_ids"))
    return kids.join(nodes.select("id"), "id", "left_semi")


def breadcrumbs(nodes: DataFrame) -> DataFrame:
    """(id, breadcrumb): names from the root down to each node of (id, parent_id, name).

    The walk ends at a parent that is missing or already on the path, so cycles do no harm. Of
    rows that repeat an id the smallest counts. Paths double in length with every round, in which
    a node takes over what its highest ancestor so far knows; so trees of any depth and number of nodes take
    few joins, and nodes whose walk has ended aren't joined again.
    """
    once = nodes.filter("id is not null").groupBy("id").agg(F.min(F.struct("parent_id", "name")).alias("m"))
    # from the node upwards; at is where the walk goes on
    step = F.array(F.struct("id", F.col("m.name").alias("name")))
    ended, going = [], materialize(once.select("id", F.col("m.parent_id").alias("at"), step.alias("path")), "walks")
    known = going
    while not (active := going.filter("at is not null")).isEmpty():
        ended.append(going.filter("at is null").select("id", "path"))
        above = known.select(F.col("id").alias("at"), F.col("at").alias("further"), F.col("path").alias("more"))
        met = active.join(above, "at", "left").withColumn("more", F.coalesce("more", F.array().cast(known.schema["path"].dataType)))
        # the walk ends where it would meet itself
        own = F.transform("path", lambda s: s["id"])
        loop = F.arrays_overlap(own, F.transform("more", lambda s: s["id"]))
        head = F.coalesce(F.array_position(F.transform("more", lambda s: F.array_contains(own, s["id"])), True) - 1, F.lit(0)).cast("int")
        path = F.when(loop, F.concat("path", F.slice("more", F.lit(1), head))).otherwise(F.concat("path", "more"))
        going = materialize(met.select("id", F.when(~loop, F.col("further")).alias("at"), path.alias("path")), "walks")
        known = going.unionByName(reduce(DataFrame.unionByName, ended).withColumn("at", F.lit(None).cast(nodes.schema["parent_id"].dataType)))
    ended.append(going.select("id", "path"))
    return reduce(DataFrame.unionByName, ended).select("id", F.reverse(F.transform("path", lambda s: s["name"])).alias("breadcrumb"))
