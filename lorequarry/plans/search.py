"""Search: request checks, the two-stage funnel, boosts, and document lookup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import models, vector
from ..operators.lexical import top_k

# Bounds of a request.
DEFAULT_K, MAX_K, DEFAULT_POOL, MAX_POOL, MAX_QUERY_CHARS = 5, 20, 20, 100, 2000
RESULT = ("source_id", "title", "source_url", "heading_path", "chunk_type", "content", "cosine_score", "rerank_score", "rerank_rank")


def clamp_k(k: Column) -> Column:
    """A requested number of results as a whole number from 1 to MAX_K, DEFAULT_K where it is none."""
    return F.greatest(F.lit(1), F.least(F.lit(MAX_K), F.coalesce(k.try_cast("int"), F.lit(DEFAULT_K))))


def clamp_pool(pool: Column, k: Column) -> Column:
    """A requested candidate pool: at most MAX_POOL, at least k."""
    return F.greatest(k, F.lit(1), F.least(F.lit(MAX_POOL), F.coalesce(pool.try_cast("int"), F.lit(DEFAULT_POOL))))


def valid_query(query: Column) -> Column:
    return F.coalesce((F.trim(query) != "") & (F.char_length(query) <= MAX_QUERY_CHARS), F.lit(False))


def check_query(query: str | None) -> str:
    """One request's query, trimmed; raises ValueError for what the batch form rejects."""
    if not isinstance(query, str) or not query.strip():
        raise ValueError("the query must not be empty")
    if len(query) > MAX_QUERY_CHARS:
        raise ValueError(f"the query must have at most {MAX_QUERY_CHARS} characters")
    return query.strip()


def split_valid(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries to be run (trimmed, with k and pool clamped) and rejected ones."""
    k = clamp_k(F.col("k"))
    good = queries.filter(valid_query(F.col("query"))).withColumns({"query": F.trim("query"), "k": k, "pool": clamp_pool(F.col("pool"), k)})
    return good, queries.filter(~valid_query(F.col("query")))


def funnel(candidates: DataFrame, first: Column, second: Column, pool: int, k: int) -> DataFrame:
    """Two chained rankings of (query_id, id): the pool best by first, of which the k best by second."""
    window = lambda c: Window.partitionBy("query_id").orderBy(c.desc(), F.col("id"))
    pooled = candidates.withColumn("_first", F.row_number().over(window(first))).filter(F.col("_first") <= pool).drop("_first")
    return pooled.withColumn("rerank_rank", F.row_number().over(window(second)) - 1).filter(F.col("rerank_rank") < k)


def allowed(acl: Column, groups: list[str]) -> Column:
    """Whether a document is public or open to one of the caller's groups."""
    return F.coalesce(acl, F.lit("public")).isin("public", *groups)


def freshness(modified: Column, as_of: Column, half_life_days: Column) -> Column:
    """Weight that halves with every half-life since the last change."""
    return F.pow(F.lit(0.5), F.greatest(F.datediff(as_of, modified), F.lit(0)) / half_life_days)


def search(
    queries: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    make_embedder: Callable[[], models.Embedder] = models.HashEmbedder,
    make_scorer: Callable[[], models.Scorer] = models.OverlapScorer,
    groups: list[str] | None = None,
    source_type: str | None = None,
) -> DataFrame:
    """Ranked chunks for a batch of queries (query_id, query, k, pool).

    Filters on documents (access, source type) apply before the vectors are ranked. The pool of
    each query is reranked by the scorer over headings and content; per query k rows remain.
    """
    asked, _ = split_valid(queries)
    visible = documents
    if groups is not None:
        visible = visible.filter(allowed(F.col("acl"), groups))
    if source_type is not None:
        visible = visible.filter(F.col("source_type") == source_type)
    pool = chunks if visible is documents else chunks.join(visible.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    vectors = models.embed(asked.select("query_id", "query"), "query", make_embedder)
    near = vector.knn(vectors.select("query_id", "embedding"), pool.select("id", "embedding"), MAX_POOL)
    near = near.join(asked.select("query_id", "query", "k", "pool"), "query_id").filter(F.col("rank") <= F.col("pool"))
    found = near.join(pool.select("id", "document_id", "chunk_index", "content", "heading_path", "chunk_type"), "id")
    found = found.withColumn("_text", X.rerank_text(F.col("content"), F.col("heading_path")))
    scored = models.score_pairs(found, "query", "_text", make_scorer).withColumnRenamed("score", "cosine_score")
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "id")
    best = scored.withColumn("rerank_rank", F.row_number().over(order) - 1).filter(F.col("rerank_rank") < F.col("k"))
    docs = documents.select(F.col("id").alias("document_id"), "source_id", "title", "source_url")
    return best.join(docs, "document_id").select("query_id", *RESULT)


def get_document(documents: DataFrame, source_id: str) -> DataFrame:
    """One document by its source id, with its time as text; raises KeyError if there is none."""
    found = documents.filter(F.col("source_id") == source_id)
    if found.isEmpty():
        raise KeyError(source_id)
    return found.withColumn("last_modified", F.date_format("last_modified", "yyyy-MM-dd'T'HH:mm:ss"))


def cite_prompt(question: str) -> str:
    """Prompt that asks for an answer with citations from the retrieved chunks."""
    return f"Answer the question from the retrieved chunks only and cite the chunk of every statement.\n\nQuestion: {check_query(question)}"


def in_source_order(hits: DataFrame) -> DataFrame:
    """Retrieved chunks of each query in the order of their documents."""
    order = Window.partitionBy("query_id").orderBy("document_id", "chunk_index")
    return hits.withColumn("place", F.row_number().over(order))


def roll_up(hits: DataFrame, parent: str, k: int) -> DataFrame:
    """The k best parents of each query by the sum of their hits' scores."""
    sums = hits.groupBy("query_id", F.col(parent).alias("id")).agg(F.round(F.sum("score"), 6).alias("score"), F.round(F.max("score"), 6).alias("best"), F.count("*").alias("hits"))
    return top_k(sums, k)
