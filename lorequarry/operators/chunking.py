"""Chunks of articles and Markdown as DataFrames, folds over ordered chunks, and chunk statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html_ops as H

FIELDS = ("chunk_index", "content", "heading_path", "chunk_type", "token_count", "oversized")


def chunk_articles(docs: DataFrame, count: Callable[[str], int] = H.quarter, limits: H.Limits = H.Limits(), markdown: bool = False, repair: bool = True) -> DataFrame:
    """One row per chunk of docs (source_id, content, and columns that are kept); a text that fails to parse gives one row with error."""

    def split(text: str) -> dict:
        try:
            if markdown:
                return {"chunks": H.chunk_markdown(text, count, limits), "error": None}
            return {"chunks": H.chunk_article(H.preprocess(text, count, limits) if repair else text, count, limits), "error": None}
        except (ValueError, AttributeError, IndexError, RecursionError) as e:
            return {"chunks": [], "error": f"{type(e).__name__}: {e}"[:300]}

    kind = H.pa.struct([("chunks", H.CHUNK_TYPE), ("error", H.pa.string())])
    made = docs.withColumn("_made", H.column(split, kind, f"struct<chunks:{H.CHUNK_DDL},error:string>")(F.col("content")))
    kept = [c for c in docs.columns if c != "content"]
    rows = made.select(*kept, F.col("_made.error").alias("error"), F.explode_outer("_made.chunks").alias("c"))
    return rows.filter("c is not null or error is not null").select(*kept, *[F.col(f"c.{f}").alias(f) for f in FIELDS], "error")


def paragraphs(docs: DataFrame, key: str, text: str, *kept: str) -> DataFrame:
    """(key, kept columns, chunk_index, content): the non-blank lines of a text in order, from 0."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return docs.select(key, *kept, F.posexplode(lines).alias("chunk_index", "content"))


def merge_small(parts: Column, size: Callable[[Column], Column], small: int) -> Column:
    """Array of texts in which one below the limit is put before the next; a small last one stays alone."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), F.lit("").alias("carry"))

    def step(acc: Column, x: Column) -> Column:
        joined = F.when(acc["carry"] == "", x).otherwise(F.concat(acc["carry"], F.lit("\n"), x))
        is_small = size(joined) < small
        return F.struct(F.when(is_small, acc["done"]).otherwise(F.concat(acc["done"], F.array(joined))).alias("done"), F.when(is_small, joined).otherwise(F.lit("")).alias("carry"))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["carry"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["carry"]))))


def pack_greedily(sizes: Column, limit: int) -> Column:
    """Group number, from 0, of each size in order: a new group begins where the next size would pass the limit."""
    start = F.struct(F.array().cast("array<int>").alias("groups"), F.lit(0).alias("group"), F.lit(0.0).alias("used"))

    def step(acc: Column, x: Column) -> Column:
        x = x.cast("double")
        full = (F.size(acc["groups"]) > 0) & (acc["used"] + x > limit)
        group = F.when(full, acc["group"] + 1).otherwise(acc["group"])
        return F.struct(F.concat(acc["groups"], F.array(group)).alias("groups"), group.alias("group"), F.when(full, x).otherwise(acc["used"] + x).alias("used"))

    return F.aggregate(sizes, start, step, lambda acc: acc["groups"])


def token_distribution(chunks: DataFrame, tokens: Column) -> DataFrame:
    """Smallest, upper median and largest token count, and counts by size class."""
    t = chunks.select(tokens.alias("t"))
    n = F.count("*")
    stats = t.agg(
        n.alias("n"), F.min("t").alias("min_tokens"), F.max("t").alias("max_tokens"),
        F.count_if(F.col("t") < 256).alias("under_256"), F.count_if(F.col("t").between(256, 511)).alias("from_256"),
        F.count_if(F.col("t").between(512, 1023)).alias("from_512"), F.count_if(F.col("t") >= 1024).alias("from_1024"),
    )
    # the upper median from counts of each value: those are few, whatever the number of chunks
    steps = t.groupBy("t").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("t")))
    median = steps.crossJoin(F.broadcast(stats.select("n"))).filter(F.col("upto") > F.floor(F.col("n") / 2)).agg(F.min("t").alias("median_tokens"))
    return stats.crossJoin(median)


def type_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_type").agg(F.count("*").alias("n"))


def joined(order: str, content: str, separator: str = "\n\n") -> Column:
    """Aggregate: the contents of a group joined in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(content).alias("c")))), lambda s: s["c"])
    return F.array_join(parts, separator)


def ordered_text(chunks: DataFrame, key: list[str], order: str, content: str, separator: str = "\n\n", limit: int | None = None) -> DataFrame:
    """Contents of each key joined in order, cut at limit characters if given."""
    text = joined(order, content, separator)
    return chunks.groupBy(*key).agg((F.substring(text, 1, limit) if limit else text).alias("raw_content"), F.count("*").alias("n_chunks"))
