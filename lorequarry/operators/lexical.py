"""Lexical retrieval: postings, BM25, rank fusion, overlap measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

#: Up to so many pairs of query and term go to every task.
BROADCAST_TERMS = 500_000
#: The published constant of reciprocal rank fusion.
RRF_K = 60


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def postings(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, term, tf): the term vector of each text."""
    terms = docs.select(F.col(id_column).alias("id"), F.explode(tokens(F.col(text_column))).alias("term"))
    return terms.groupBy("id", "term").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, rank): the k texts of highest BM25 for every query.

    queries is (query_id, text), docs (id, text). Texts are dealt by id once; a document's postings, its parts and
    its scores for all queries then stay in one task, and only the k best of each query and task are shuffled. Where the
    queries have more terms than go to every task, postings are joined with them by a shuffle.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    asked = materialize(asked, "bm25-asked")
    length = F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"))
    totals = docs.agg(F.count("*").alias("n"), F.avg(length).alias("avg_len"))
    few = asked.count() <= BROADCAST_TERMS
    to_all = F.broadcast if few else lambda rows: rows
    dealt = docs.select("id", "text").repartition("id")
    worded = dealt.select("id", tokens(F.col("text")).alias("words"))
    # the length travels with each term, so that neither text nor words are copied to every row
    spread = worded.select("id", F.inline(F.transform("words", lambda w: F.struct(F.size("words").alias("len"), w.alias("term")))))
    hits = spread.join(to_all(asked.select("term").distinct()), "term", "left_semi").groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    n = F.broadcast(totals)  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = hits.join(to_all(asked.join(df, "term")), "term").crossJoin(n).select("query_id", "id", part.alias("part"))
    scored = scored.groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))
    return top_k(scored, k)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows (id, score) of each query_id with their rank, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fuse(ranked: list[DataFrame], k: int, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, id, rank)."""
    rows = None
    for one in ranked:
        part = one.select("query_id", "id", (F.lit(1.0) / (constant + F.col("rank"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    return top_k(rows.groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score")), k)


def ngram_overlap(pairs: DataFrame, n: int = 1) -> DataFrame:
    """ROUGE-n recall, precision and F1 of (pair_id, candidate, reference), by multiset counts of n-grams."""

    def counted(column: str, name: str) -> DataFrame:
        words = tokens(F.col(column))
        grams = F.filter(F.transform(words, lambda _, i: F.array_join(F.slice(words, i + 1, n), " ")), lambda g: F.size(F.split(g, " ")) == n) if n > 1 else words
        return pairs.select("pair_id", F.explode(grams).alias("gram")).groupBy("pair_id", "gram").agg(F.count("*").alias(name))

    both = counted("candidate", "c").join(counted("reference", "r"), ["pair_id", "gram"], "full_outer").fillna(0, ["c", "r"])
    sums = both.groupBy("pair_id").agg(F.sum(F.least("c", "r")).alias("hits"), F.sum("c").alias("c"), F.sum("r").alias("r"))
    recall, precision = F.col("hits") / F.nullif(F.col("r"), F.lit(0)), F.col("hits") / F.nullif(F.col("c"), F.lit(0))
    return sums.select("pair_id", F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision"), F.round(2.0 * F.col("hits") / F.nullif(F.col("c") + F.col("r"), F.lit(0)), 6).alias("f1"))


def bleu(pairs: DataFrame, max_n: int = 4) -> DataFrame:
    """(pair_id, bleu) of (pair_id, candidate, reference): geometric mean of the clipped precisions of 1 to max_n words, with the penalty for short candidates."""
    precision = None
    for n in range(1, max_n + 1):
        one = ngram_overlap(pairs, n).select("pair_id", F.col("precision").alias(f"p{n}"))
        precision = one if precision is None else precision.join(one, "pair_id", "left")
    sizes = pairs.select("pair_id", F.size(tokens(F.col("candidate"))).alias("c"), F.size(tokens(F.col("reference"))).alias("r"))
    logs = sum((F.log(F.col(f"p{n}")) for n in range(1, max_n + 1)), F.lit(0.0)) / max_n
    short = F.when(F.col("c") < F.col("r"), F.exp(1 - F.col("r") / F.col("c"))).otherwise(1.0)
    some = F.coalesce(F.least(*[F.coalesce(f"p{n}", F.lit(0.0)) for n in range(1, max_n + 1)], F.lit(1.0)) > 0, F.lit(False))
    return sizes.join(precision, "pair_id", "left").select("pair_id", F.round(F.when(some, short * F.exp(logs)).otherwise(0.0), 6).alias("bleu"))
