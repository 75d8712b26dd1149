"""Batch jobs around search: evaluation runs, crawl statistics, traces, gradual retrieval, gaps and caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, lexical, models, vector
from ..storage import materialize
from . import evaluate, search

#: Candidates graded below this are asked again.
REGRADE_BELOW = 0.3


def evaluation(golden: DataFrame, chunks: DataFrame, documents: DataFrame, k: int = 5, pool: int = 20, limit: int | None = None, ids: list[int] | None = None, generator: Callable[[], models.Generator] | None = None, **models_of) -> DataFrame:
    """Evaluation records of golden questions (id, query, answer, source_article_id, source_article_id_alt, ...): retrieved chunks, answer, matches.

    Answers are a generator's, or the offline one's without it. A question that fails the request checks, or whose
    generation fails, stays as a record with an error.
    """
    asked = golden if ids is None else golden.filter(F.col("id").isin(*ids))
    asked = asked if limit is None else asked.orderBy("id").limit(limit)
    expected = evaluate.expected_ids(F.col("source_article_id"), F.col("source_article_id_alt"))
    asked = asked.withColumn("expected_source_ids", expected)
    requests = asked.select(F.col("id").cast("long").alias("query_id"), "query", F.lit(str(k)).alias("k"), F.lit(str(pool)).alias("pool"))
    hits = search.search(requests, chunks, documents, **models_of)
    block = X.format_chunk(F.col("rerank_rank") + 1, F.col("source_id"), F.col("title"), F.col("heading_path"), F.col("content"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(F.col("rerank_rank").alias("r"), c.alias("v")))), lambda s: s["v"])
    found = hits.groupBy(F.col("query_id").cast("int").alias("id")).agg(ordered(F.col("source_id")).alias("retrieved_ids"), ordered(block).alias("context_strings"), ordered(F.col("content")).alias("_contents"))
    rows = asked.join(found, "id", "left")
    if generator:
        answered = models.generate(rows, "query", "_contents", generator)
    else:
        text = F.when(F.col("_contents").isNotNull(), models.answer_column(F.col("query"), F.col("_contents")))
        spent = X.count_tokens(F.array_join("context_strings", "\n\n---\n\n")).cast("long"), X.count_tokens(text).cast("long")
        answered = rows.withColumn("generated", F.struct(text.alias("answer"), spent[0].alias("input_tokens"), spent[1].alias("output_tokens"), F.lit(None).cast("string").alias("error")))
    flags = evaluate.match_columns(F.col("expected_source_ids"), F.coalesce("retrieved_ids", F.array().cast("array<string>")))
    return answered.select(
        "id", "query", F.col("answer").alias("expected_answer"), "expected_source_ids", "query_type", "retrieved_ids", "context_strings", "generated.answer", "generated.input_tokens", "generated.output_tokens",
        *[c.alias(n) for n, c in flags.items()], F.when(~search.valid_query(F.col("query")), "invalid query").when(F.col("retrieved_ids").isNull(), "nothing retrieved").otherwise(F.col("generated.error")).alias("error"),
    )


def judged(records: DataFrame, judge: Callable[[], models.Judge] | None = None) -> DataFrame:
    """(id, query_type, scores) of the records that have an answer, by a judge, or by the offline one without it."""
    context = F.array_join("context_strings", " ")
    scored = records.filter("answer is not null")
    if judge:
        return models.judge(scored, F.col("query"), F.col("answer"), F.col("expected_answer"), context, judge).select("id", "query_type", "scores")
    return scored.select("id", "query_type", models.judge_columns(F.col("query"), F.col("answer"), F.col("expected_answer"), context).alias("scores"))


def crawl_stats(topics: DataFrame, articles: DataFrame) -> DataFrame:
    """One row: topics, leaves with articles, articles found and landed."""
    t = topics.agg(F.count("*").alias("topics_discovered"), F.count_if((F.col("child_count") == 0) & (F.col("article_count") > 0)).alias("leaf_topics"))
    a = articles.agg(F.countDistinct("id").alias("articles_discovered"), F.count_if("downloaded").alias("articles_downloaded"))
    return t.crossJoin(F.broadcast(a))


def spans(hits: DataFrame, queries: DataFrame, started: Column, ended: Column) -> DataFrame:
    """Trace rows of served queries, to be appended to an events table."""
    best = hits.groupBy("query_id").agg(F.max("rerank_score").alias("top_rerank_score"), F.to_json(F.collect_list(F.struct("rerank_rank", "source_id"))).alias("output_value"))
    return queries.join(best, "query_id", "left").select("query_id", F.col("query").alias("input_value"), "k", F.col("pool").alias("rerank_from"), "output_value", "top_rerank_score", (F.unix_millis(ended) - F.unix_millis(started)).alias("latency_ms"))


def staged(queries: DataFrame, corpus: DataFrame, group: str, groups: int, k: int) -> DataFrame:
    """Two-stage retrieval: the nearest group centroids of a query first, then its k nearest rows in those groups.

    queries is (query_id, embedding), corpus (id, embedding, group).
    """
    wide = corpus.select(group, F.posexplode("embedding").alias("i", "x"))
    means = wide.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroids = means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))
    near = vector.knn(queries, centroids.select(F.col(group).cast("long").alias("id"), "embedding"), groups).select("query_id", F.col("id").alias("_group"))
    asked = near.join(queries, "query_id").select("query_id", "_group", "embedding")
    return vector.knn_within(asked, corpus.select("id", F.col(group).cast("long").alias("_group"), "embedding"), "_group", k, skip_self=True)


def lexical_then_vector(lexical_hits: DataFrame, query_vectors: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Rows of a lexical first stage (query_id, id), the k best by cosine."""
    both = lexical_hits.select("query_id", "id").join(query_vectors.select("query_id", F.col("embedding").alias("_q")), "query_id").join(vectors.select("id", F.col("embedding").alias("_v")), "id")
    return lexical.top_k(both.select("query_id", "id", F.round(vector.cosine(F.col("_q"), F.col("_v")), vector.DIGITS).alias("score")), k)


def chunk_at_query_time(document_hits: DataFrame, documents: DataFrame, small: int = 50) -> DataFrame:
    """Chunks of the few documents that were found, cut only now: (query_id, id, chunk_index, content)."""
    found = document_hits.select("query_id", "id").join(documents.select("id", "text"), "id")
    parts = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return found.select("query_id", "id", F.posexplode(chunking.merge_small(parts, lambda c: X.count_tokens(c), small)).alias("chunk_index", "content"))


def graded(hits: DataFrame, score: str = "rerank_score", below: float = REGRADE_BELOW) -> DataFrame:
    """Whether a query's best hit is good, doubtful or bad enough to ask again."""
    best = hits.groupBy("query_id").agg(F.max(score).alias("best"))
    return best.withColumn("grade", F.when(F.col("best") >= 2 * below, "good").when(F.col("best") >= below, "doubtful").otherwise("ask again"))


def asked_again(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], rewrite: Callable[[DataFrame, DataFrame], DataFrame], below: float, rounds: int = 2, score: str = "score") -> DataFrame:
    """(query_id, round, and retrieve's other columns): the hits of each query's best round.

    queries is (query_id, query). Each round retrieves for the queries that are still open: those whose best score in every
    round before was below the limit, in the words that rewrite(open queries, their hits) gave them. Only these are joined
    again; a query is closed by a good round, or by the last. Of a query's rounds the one with the best score stays,
    of equal ones the first. A query that finds nothing stays open and has no rows; one that isn't rewritten is closed.
    """
    kept, waiting = None, queries.select("query_id", "query").filter("query_id is not null")
    for number in range(1, rounds + 1):
        waiting = materialize(waiting, "open-queries")
        if waiting.isEmpty():
            break
        hits = materialize(retrieve(waiting).withColumn("round", F.lit(number)), "round-hits")
        kept = hits if kept is None else kept.unionByName(hits)
        good = hits.groupBy("query_id").agg(F.max(score).alias("best")).filter(F.col("best") >= below)
        waiting = rewrite(waiting.join(good, "query_id", "left_anti"), hits)
    if kept is None:
        return retrieve(queries.select("query_id", "query").limit(0)).withColumn("round", F.lit(0))
    best = kept.groupBy("query_id", "round").agg(F.max(score).alias("best")).groupBy("query_id").agg(F.min(F.struct((-F.col("best")).alias("worst"), F.col("round").alias("round"))).alias("b"))
    return kept.join(best.select("query_id", F.col("b.round").alias("round")), ["query_id", "round"])


def hypothetical(queries: DataFrame, generate: Callable[[Column], Column]) -> DataFrame:
    """Queries whose text is a generated answer to them, to be embedded in their place."""
    return queries.withColumn("query", F.coalesce(generate(F.col("query")), F.col("query")))


def normalized(query: Column) -> Column:
    """A query without case, punctuation and extra white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(query), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def cached(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """Queries with the answer of an equal query from the cache (query_hash, answer), null where there is none."""
    return queries.withColumn("query_hash", F.md5(normalized(F.col("query")).cast("binary"))).join(cache.select("query_hash", "answer"), "query_hash", "left")


def tenant_only(rows: DataFrame, tenant: str) -> DataFrame:
    """Rows of one tenant; there is no way around the predicate."""
    if not tenant:
        raise ValueError("a tenant must be named")
    return rows.filter(F.col("tenant") == tenant)


def source_gaps(documents: DataFrame, hits: DataFrame) -> DataFrame:
    """Documents that no query has found."""
    return documents.join(hits.select("source_id"), "source_id", "left_anti")


def query_gaps(hits: DataFrame, clusters: DataFrame, below: float) -> DataFrame:
    """(cluster, n, low, share): clusters of queries by how often their best score is low."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    return best.join(clusters, "query_id").groupBy("cluster").agg(F.count("*").alias("n"), F.count_if(F.col("best") < below).alias("low"), F.avg((F.col("best") < below).cast("int")).alias("share"))


def query_clusters(queries: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """(query_id, cluster) by k-means over unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    length = vector.norm(F.col("embedding"))
    units = queries.filter(length > 0).select("query_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double") / length)).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=10).fit(units).transform(units).select("query_id", F.col("prediction").alias("cluster"))

