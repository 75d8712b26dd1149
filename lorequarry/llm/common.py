"""Helpers shared by the training-data operators: table access, samples, link components."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import discard, materialize

#: White space and words as the contracts define them (ASCII white space only).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; Spark reads it, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def named(column: str) -> Column:
    """A column by its name, whatever signs the name has."""
    return F.col("`" + column.replace("`", "``") + "`").alias(column)


def release_memory() -> None:
    """Gives a Python worker's free memory back at the end of its task: idle workers stay beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def word_count(text: Column) -> Column:
    """Number of words of a text, null counting as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for every node that appears in links.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each round is two
    partially aggregated minima joined back on the node, so a hub is never gathered in one
    task. Every round is written to the shared folder; the rounds end when the links form stars.
    Links may hold loops, repeats and both directions. Returns (node, component).
    """
    spark = links.sparkSession
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    pairs = materialize(pairs, "links")
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        before, pairs = pairs, materialize(small.select("e.u", "e.v").filter("u <> v").distinct(), "links")
        discard(before)
        ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(pairs.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        unsettled = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below > 1 or (below > 0 and above > 0)")
        if unsettled.isEmpty():
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = pairs.select(F.col("v").alias("u"), "v").distinct()
    return pairs.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))


def bounded_sample(rows: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """(label, key): at most n different keys of each label, those with the smallest hashes.

    Keys are thinned by hash to about 3n of each label before they are ranked, so that what a task
    ranks doesn't grow with the input. Labels with up to 2n keys are ranked whole.
    """
    pairs = rows.select(label, key)
    # within 5 hundredths, mostly
    sizes = pairs.groupBy(label).agg(F.approx_count_distinct(key).alias("_keys"))
    span = 1 << 40
    near = F.pmod(F.xxhash64(F.col(key)), F.lit(span)) < F.lit(3.0 * n * span) / F.col("_keys")
    thin = pairs.join(sizes, label).filter(near).select(label, key).distinct()
    order = Window.partitionBy(label).orderBy(F.xxhash64(key), key)
    return thin.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")


def sampled_texts(docs: DataFrame, ids: DataFrame, label: str, n: int) -> DataFrame:
    """(label, text): at most n different rows (doc_id, text) of each label, among the rows of docs with the ids of (label, doc_id).

    Rows are chosen by what they hold, as an id may stand for any number of them. ids has at
    most n rows of each label, so it is broadcast. docs has a column label, or ids gives it.
    """
    rows = docs.join(F.broadcast(ids), [c for c in ids.columns if c in docs.columns]).select(label, "text", F.xxhash64("doc_id", "text").alias("row"))
    picked = bounded_sample(rows, label, "row", n)
    return rows.join(F.broadcast(picked), [label, "row"]).dropDuplicates([label, "row"]).select(label, "text")
