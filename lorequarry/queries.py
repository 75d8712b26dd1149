"""Registered queries of the library's operators on the driver's tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import html_ops as H
from .functions import text as X
from .operators import chunking, enrich, fulltext, hierarchy, impact_index, lexical, maintenance, models, telemetry, vector
from .plans import evaluate, run, search, store
from .storage import materialize, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: DuckDB's word boundary knows ASCII only; other characters become a word character that no term holds.
ASCII = r"regexp_replace({}, '[^\x00-\x7F]', '_', 'g')"
STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
AUDIT_STOP = ", ".join(f"'{w}'" for w in X.AUDIT_STOP_WORDS)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ask_embeddings(e: DataFrame) -> DataFrame:
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def near(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return vector.knn(ask_embeddings(e), e.select(F.col("vec_id").alias("id"), "embedding"), k, skip_self=True)


def knn_sql(k: int, where: str = "true") -> str:
    return f"""
    SELECT query_id, id, score, rank FROM (
        SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
            row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id)::INT AS rank
        FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0 AND {where}) WHERE rank <= {k}
    """


# --- retrieval -------------------------------------------------------------------------------


@query(f"SELECT n.query_id, n.id, e.label, n.score, n.rank FROM ({knn_sql(5)}) n JOIN embeddings e ON n.id = e.vec_id")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return near(spark, sf_dir, 5).join(e, "id").select("query_id", "id", "label", "score", "rank")


@query(f"SELECT n.query_id, n.id, d.lang, d.source, n.score, n.rank FROM ({knn_sql(5)}) n JOIN documents d ON n.id = d.doc_id")
def knn_join_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return near(spark, sf_dir, 5).join(d, "id").select("query_id", "id", "lang", "source", "score", "rank")


@query(knn_sql(5, "e.label < 5"))
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return vector.knn(ask_embeddings(e), e.filter("label < 5").select(F.col("vec_id").alias("id"), "embedding"), 5, skip_self=True)


@query("""
WITH s AS (
    SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS cosine_score, round(list_aggregate(list_transform(list_zip(q.embedding, e.embedding), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE)), 'sum'), 6) AS far
    FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0
), pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine_score DESC, id) AS r FROM s
), best AS (SELECT query_id, id, cosine_score, -far AS rerank_score, (row_number() OVER (PARTITION BY query_id ORDER BY -far DESC, id) - 1)::INT AS rerank_rank FROM pool WHERE r <= 20)
SELECT * FROM best WHERE rerank_rank < 5
""")
def two_stage_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine pool of 20, reranked by Manhattan distance to 5."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    pool = near(spark, sf_dir, 20).drop("rank").withColumnRenamed("score", "cosine_score")
    both = pool.join(e, "id").join(e.select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), "query_id")
    far = F.aggregate(F.zip_with("q", "embedding", lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    scored = both.withColumn("rerank_score", -F.round(far, 6)).select("query_id", "id", "cosine_score", "rerank_score")
    return search.funnel(scored, F.col("cosine_score"), F.col("rerank_score"), 20, 5)


METRICS_SQL = f"""
    WITH hits AS (SELECT n.*, (a.label = b.label)::INT AS rel, t.total FROM ({knn_sql(50)}) n JOIN embeddings a ON n.query_id = a.vec_id JOIN embeddings b ON n.id = b.vec_id
        JOIN (SELECT label, count(*) - 1 AS total FROM embeddings GROUP BY label) t ON t.label = a.label),
    ks AS (SELECT unnest([3, 5, 10, 20, 50])::INT AS k)
    SELECT query_id, k, round(sum(rel) / nullif(max(total), 0), 6) AS recall, round(coalesce(max(CASE WHEN rel = 1 THEN 1.0::DOUBLE / rank END), 0.0), 6)::DOUBLE AS rr,
        round(sum(rel / log2(rank + 1.0::DOUBLE)) / list_aggregate(list_transform(range(1, greatest(1, least(max(total), k)) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE)), 'sum'), 6) AS ndcg
    FROM hits JOIN ks ON rank <= k GROUP BY query_id, k
"""


def labelled_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    hits = near(spark, sf_dir, 50).join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id").join(e.select(F.col("vec_id").alias("id"), "label"), "id")
    return hits.join(e.groupBy(F.col("label").alias("wanted")).agg((F.count("*") - 1).alias("total")), "wanted")


@query(f"SELECT query_id, recall, rr, ndcg FROM ({METRICS_SQL}) WHERE k = 10")
def recall_mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ranking_metrics(labelled_hits(spark, sf_dir), F.col("label") == F.col("wanted"), F.col("total"), 10)


@query(f"SELECT k, count(*) AS n, round(avg(recall), 5) AS recall, round(avg(rr), 5) AS mrr FROM ({METRICS_SQL}) GROUP BY k")
def k_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = labelled_hits(spark, sf_dir)
    out = None
    for k in (3, 5, 10, 20, 50):
        one = evaluate.ranking_metrics(hits, F.col("label") == F.col("wanted"), F.col("total"), k).agg(F.count("*").alias("n"), F.round(F.avg("recall"), 5).alias("recall"), F.round(F.avg("rr"), 5).alias("mrr"))
        one = one.select(F.lit(k).alias("k"), "n", "recall", "mrr")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT doc_id, trim(text) <> '' AND length(text) <= 2000 AS valid, greatest(1, least(20, coalesce(try_cast(k AS INT), 5)))::INT AS k,
    greatest(greatest(1, least(20, coalesce(try_cast(k AS INT), 5))), 1, least(100, coalesce(try_cast(p AS INT), 20)))::INT AS pool
FROM (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN 'many' WHEN 1 THEN '999' WHEN 2 THEN '0' ELSE '7' END AS k, CASE doc_id % 3 WHEN 0 THEN '99999' WHEN 1 THEN '1' ELSE 'x' END AS p FROM documents)
""")
def clamp_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d = read(spark, sf_dir, "documents").withColumns({"k": F.when(i % 4 == 0, "many").when(i % 4 == 1, "999").when(i % 4 == 2, "0").otherwise("7"), "p": F.when(i % 3 == 0, "99999").when(i % 3 == 1, "1").otherwise("x")})
    k = search.clamp_k(F.col("k"))
    return d.select("doc_id", search.valid_query(F.col("text")).alias("valid"), k.alias("k"), search.clamp_pool(F.col("p"), k).alias("pool"))


@query("SELECT doc_id::VARCHAR AS source_id, text AS raw_content, source, '2026-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00' AS last_modified FROM documents WHERE doc_id = 7")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_timestamp(F.concat(F.lit("2026-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("raw_content"), "source", day.alias("last_modified"))
    return search.get_document(d, "7")


@query(f"""
WITH hits AS (SELECT n.query_id, n.rank, a.label AS wanted, b.label FROM ({knn_sql(5)}) n JOIN embeddings a ON n.query_id = a.vec_id JOIN embeddings b ON n.id = b.vec_id),
per AS (SELECT query_id, bool_or(rank = 1 AND label = wanted) AS top1, bool_or(label = wanted) AS topk FROM hits GROUP BY query_id)
SELECT count(*) AS n, avg(top1::INT) AS top1_source_match_rate, avg(topk::INT) AS topk_source_match_rate FROM per
""")
def match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"))
    hits = near(spark, sf_dir, 5).join(e.select(F.col("vec_id").alias("id"), "label"), "id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda s: s["label"]).alias("got"))
    rows = hits.join(e.select(F.col("vec_id").alias("query_id"), evaluate.expected_ids(F.col("label"), F.lit(None).cast("array<string>")).alias("expected")), "query_id")
    flags = rows.select(*[c.alias(n) for n, c in evaluate.match_columns(F.col("expected"), F.col("got")).items()])
    return flags.agg(F.count("*").alias("n"), F.avg(F.col("top1_source_match").cast("int")).alias("top1_source_match_rate"), F.avg(F.col("topk_source_match").cast("int")).alias("topk_source_match_rate"))


BM25_SQL = """
WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents),
stats AS (SELECT count(*) AS n, avg(len(ws)) AS avg_len FROM t),
asked AS (SELECT DISTINCT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark),
hits AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(ws) AS len, unnest(ws) AS term FROM t) WHERE term IN (SELECT term FROM asked) GROUP BY id, len, term),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
scored AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6) AS score
    FROM hits JOIN df USING (term) JOIN asked USING (term), stats GROUP BY query_id, id),
ranked AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM scored)
SELECT query_id, id, score, rank FROM ranked WHERE rank <= {k}
"""


def lexical_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    questions = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return lexical.bm25(questions, read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), k)


@query(BM25_SQL.format(k=10))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_hits(spark, sf_dir, 10)


@query(f"""
WITH s AS (SELECT i.item_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
    FROM benchmark i JOIN embeddings q ON q.vec_id = i.item_id JOIN embeddings e ON e.vec_id <> i.item_id),
v AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 50),
parts AS (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS part FROM v UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank) FROM ({BM25_SQL.format(k=50)})),
sums AS (SELECT query_id, id, round(sum(part), 9) AS score FROM parts GROUP BY query_id, id)
SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM sums) WHERE rank <= 10
""")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of the 50 nearest vectors and the 50 best BM25 texts of every benchmark passage (its vector is the one of its number)."""
    e = read(spark, sf_dir, "embeddings")
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")).join(e, "vec_id").select(F.col("vec_id").alias("query_id"), "embedding")
    return lexical.fuse([vector.knn(asked, e.select(F.col("vec_id").alias("id"), "embedding"), 50, skip_self=True), lexical_hits(spark, sf_dir, 50)], 10)


@query(BM25_SQL.format(k=10))
def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 by the stored index: built into a new folder, then searched for every benchmark passage."""
    path = f"{shared_dir(spark)}/impact-index-{uuid.uuid4().hex}"
    impact_index.build(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), path)
    questions = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return impact_index.bm25(impact_index.load(spark, path), questions, 10)


REWRITE_SQL = rf"""list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({ASCII.format("d.text")}, '\$[\d,]+|\d+%|[A-Z]{{2,}}-?\d*|[A-Z][a-z]{{3,}}|\b[a-z]{{6,}}\b|\b\d{{3,}}\b'), lambda t: lower(t)), lambda t: t NOT IN ({STOP}))))[1:10]"""


@query(f"""
WITH r1 AS ({BM25_SQL.format(k=5)}),
best1 AS (SELECT query_id, max(score) AS best FROM r1 GROUP BY query_id),
again AS (SELECT b.item_id, b.text || ' ' || array_to_string({REWRITE_SQL}, ' ') AS text FROM benchmark b JOIN r1 ON r1.query_id = b.item_id AND rank = 1 JOIN documents d ON d.doc_id = r1.id JOIN best1 ON best1.query_id = b.item_id WHERE best < 60),
r2 AS ({BM25_SQL.format(k=5).replace("FROM benchmark", "FROM again")}),
best2 AS (SELECT query_id, max(score) AS best FROM r2 GROUP BY query_id),
chosen AS (SELECT query_id, CASE WHEN best2.best > best1.best THEN 2 ELSE 1 END AS round FROM best1 LEFT JOIN best2 USING (query_id))
SELECT c.query_id, c.round, h.id, h.score, h.rank FROM chosen c JOIN (SELECT *, 1 AS round FROM r1 UNION ALL SELECT *, 2 FROM r2) h ON h.query_id = c.query_id AND h.round = c.round
""")
def requery_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages by BM25; those whose best score is below 60 are asked again with ten terms of their best document."""
    documents = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")

    def rewrite(open_queries: DataFrame, hits: DataFrame) -> DataFrame:
        first = hits.filter("rank = 1").select("query_id", "id").join(documents, "id").select("query_id", F.slice(F.array_sort(X.distinctive_terms(F.col("text"))), 1, 10).alias("terms"))
        return open_queries.join(first, "query_id").select("query_id", F.concat_ws(" ", "query", F.array_join("terms", " ")).alias("query"))

    questions = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return run.asked_again(questions, lambda q: lexical.bm25(q.withColumnRenamed("query", "text"), documents, 5), rewrite, 60.0)


WORDS_SQL = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


@query(f"SELECT doc_id, lexeme, list(place ORDER BY place) AS positions FROM (SELECT doc_id, unnest({WORDS_SQL}) AS lexeme, generate_subscripts({WORDS_SQL}, 1)::INT AS place FROM documents) GROUP BY doc_id, lexeme")
def tsvector_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.lexemes(read(spark, sf_dir, "documents"), ["doc_id"], "text", "simple")


@query()
def tsvector_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.lexemes(read(spark, sf_dir, "documents"), ["doc_id"], "text")


def asked_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, sentence_no, phrase): every sentence of every benchmark passage."""
    parts = F.split(F.coalesce("text", F.lit("")), r"[.!?\n]+")
    return read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(parts).alias("sentence_no", "phrase"))


@query(rf"""
WITH asked AS (SELECT item_id, unnest(string_split_regex(coalesce(text, ''), '[.!?\n]+')) AS text, generate_subscripts(string_split_regex(coalesce(text, ''), '[.!?\n]+'), 1)::INT - 1 AS sentence_no FROM benchmark),
p AS (SELECT item_id, sentence_no, ' ' || array_to_string({WORDS_SQL}, ' ') || ' ' AS phrase FROM asked WHERE len({WORDS_SQL}) > 0),
d AS (SELECT doc_id, ' ' || array_to_string({WORDS_SQL}, '  ') || ' ' AS whole FROM documents)
SELECT item_id, sentence_no, doc_id, (length(whole) - length(replace(whole, replace(phrase, ' ', '  ')[2:-2], ''))) // length(replace(phrase, ' ', '  ')[2:-2]) AS starts FROM p JOIN d ON contains(whole, replace(phrase, ' ', '  ')[2:-2])
""")
def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a sentence of a benchmark passage word by word, whatever stands between the words."""
    key = ["item_id", "sentence_no"]
    index = fulltext.lexemes(read(spark, sf_dir, "documents"), ["doc_id"], "text", "simple")
    return fulltext.phrase_match(index, materialize(fulltext.phrases(asked_sentences(spark, sf_dir), "phrase", key, "simple"), "phrases"), key, "doc_id")


@query()
def phrase_match_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by stems, without stop words."""
    key = ["item_id", "sentence_no"]
    index = fulltext.lexemes(read(spark, sf_dir, "documents"), ["doc_id"], "text")
    return fulltext.phrase_match(index, materialize(fulltext.phrases(asked_sentences(spark, sf_dir), "phrase", key), "phrases"), key, "doc_id")


@query("""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
near AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) <= 5),
mutual AS (SELECT x.a, x.b FROM near x JOIN near y ON x.a = y.b AND x.b = y.a WHERE x.s >= 0.35 AND y.s >= 0.35),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, m.b FROM reach r JOIN mutual m ON r.b = m.a),
named AS (SELECT a AS id, min(b) AS first FROM reach GROUP BY a),
reasons AS (SELECT first, 'label ' || coalesce(label::VARCHAR, 'none') AS reason, count(*) AS c FROM named JOIN embeddings ON vec_id = id GROUP BY ALL),
tops AS (SELECT first, sum(c)::BIGINT AS n, arg_min(reason, struct_pack(less := -c, reason := reason)) AS reason, max(c) AS c FROM reasons GROUP BY first)
SELECT t.first, n, reason, round(c / n, 6) AS share, (SELECT list(id ORDER BY id)[1:3] FROM named WHERE named.first = t.first) AS examples FROM tops t
""")
def failure_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as questions that failed, their label as the reason, grouped by what they ask (vectors of these tables are far apart, so 0.35 is near)."""
    e = read(spark, sf_dir, "embeddings")
    reason = F.concat(F.lit("label "), F.coalesce(F.col("label").cast("string"), F.lit("none")))
    return evaluate.failure_groups(e.select(F.col("vec_id").alias("id"), "embedding", reason.alias("reason")), least=0.35)


@query("""
SELECT o_orderkey, round(o_totalprice * power(0.5::DOUBLE, greatest(date_diff('day', o_orderdate::DATE, DATE '1999-01-01'), 0) / (CASE WHEN o_orderpriority LIKE '1%' THEN 180.0::DOUBLE ELSE 730.0::DOUBLE END)), 6) AS score,
    round(0.7::DOUBLE * o_totalprice / 1e6 + 0.3::DOUBLE * power(0.5::DOUBLE, greatest(date_diff('day', o_orderdate::DATE, DATE '1999-01-01'), 0) / (CASE WHEN o_orderpriority LIKE '1%' THEN 180.0::DOUBLE ELSE 730.0::DOUBLE END)), 6) AS blended
FROM orders
""")
def freshness_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-lives of 180 days for urgent orders and two years for others; authority times freshness, and a 70/30 blend."""
    o = read(spark, sf_dir, "orders")
    half = F.when(F.col("o_orderpriority").startswith("1"), 180.0).otherwise(730.0)
    fresh = search.freshness(F.to_date("o_orderdate"), F.lit("1999-01-01").cast("date"), half)
    return o.select("o_orderkey", F.round(F.col("o_totalprice") * fresh, 6).alias("score"), F.round(0.7 * F.col("o_totalprice") / 1e6 + 0.3 * fresh, 6).alias("blended"))


@query("SELECT doc_id, source FROM documents WHERE coalesce(CASE WHEN doc_id % 3 = 0 THEN 'public' WHEN doc_id % 3 = 1 THEN source END, 'public') IN ('public', 'src1', 'src2')")
def acl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").withColumn("acl", F.when(F.col("doc_id") % 3 == 0, "public").when(F.col("doc_id") % 3 == 1, F.col("source")))
    return d.filter(search.allowed(F.col("acl"), ["src1", "src2"])).select("doc_id", "source")


@query(f"""
WITH hits AS (SELECT n.query_id, b.label AS id, n.score FROM ({knn_sql(20)}) n JOIN embeddings b ON n.id = b.vec_id),
sums AS (SELECT query_id, id, round(sum(score), 6) AS score, round(max(score), 6) AS best, count(*) AS hits FROM hits GROUP BY query_id, id)
SELECT * FROM (SELECT query_id, id, score, best, hits, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM sums) WHERE rank <= 3
""")
def parent_score_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return search.roll_up(near(spark, sf_dir, 20).join(e, "id"), "label", 3)


@query(f"""
SELECT query_id, document_id, chunk_index, row_number() OVER (PARTITION BY query_id ORDER BY document_id, chunk_index)::INT AS place
FROM (SELECT n.query_id, b.label::BIGINT AS document_id, n.id AS chunk_index FROM ({knn_sql(10)}) n JOIN embeddings b ON n.id = b.vec_id)
""")
def source_order_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("document_id"))
    hits = near(spark, sf_dir, 10).join(e, "id").select("query_id", "document_id", F.col("id").alias("chunk_index"))
    return search.in_source_order(hits)


@query("""
SELECT label, count(*) AS n, round(avg(l), 6) AS mean_length, round(var_pop(l), 6) AS var_length
FROM (SELECT label, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings) GROUP BY label
""")
def embedding_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.drift(read(spark, sf_dir, "embeddings"), "label")


@query("""
WITH c AS (SELECT a.vec_id AS answer_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id % 50 > 0 WHERE a.vec_id % 50 = 0)
SELECT answer_id, max(cos) AS best, max(cos) >= 0.4::DOUBLE AS grounded FROM c GROUP BY answer_id
""")
def guardrail_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set as answers, all other vectors as the chunks of their label."""
    e = read(spark, sf_dir, "embeddings")
    answers = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("answer_id"), "label", F.col("embedding").alias("answer_vec"))
    return vector.guardrail(answers, e.filter("vec_id % 50 > 0").select("label", F.col("embedding").alias("chunk_vec")), "label", 0.4)


@query()
def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search plan over chunked documents, with the offline models."""
    d = read(spark, sf_dir, "documents")
    chunks = chunking.paragraphs(d, "doc_id", "text").withColumnRenamed("doc_id", "document_id")
    chunks = models.embed(chunks.withColumns({"id": F.xxhash64("document_id", "chunk_index"), "heading_path": F.array(F.lit("Documents")), "chunk_type": F.lit("text")}), "content")
    docs = d.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("source_id"), F.col("source").alias("title"), F.lit("").alias("source_url"), F.lit("public").alias("acl"), F.col("lang").alias("source_type"))
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit("5").alias("k"), F.lit("20").alias("pool"))
    return search.search(asked, chunks, docs, groups=[])


@query("""
WITH c AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
near AS (SELECT q.vec_id AS query_id, label AS g, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], m), 6) DESC, c.label) AS r FROM (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0) q, c),
s AS (SELECT n.query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM near n JOIN embeddings e ON e.label = n.g JOIN embeddings q ON q.vec_id = n.query_id WHERE n.r <= 3 AND e.vec_id <> n.query_id)
SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s) WHERE rank <= 5
""")
def staged_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return run.staged(ask_embeddings(e), e.select(F.col("vec_id").alias("id"), "embedding", "label"), "label", 3, 5)


@query(f"""
WITH b AS ({BM25_SQL.format(k=50)}), s AS (SELECT b.query_id, b.id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM b JOIN embeddings q ON q.vec_id = b.query_id JOIN embeddings e ON e.vec_id = b.id)
SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s) WHERE rank <= 5
""")
def lexical_then_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return run.lexical_then_vector(lexical_hits(spark, sf_dir, 50), e.select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("id"), "embedding"), 5)


@query(r"""
WITH q AS (SELECT item_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g'))) AS query_hash FROM benchmark)
SELECT item_id, query_hash, CASE WHEN item_id % 2 = 0 THEN 'answer ' || item_id END AS answer FROM q
""")
def query_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    known = q.filter("item_id % 2 = 0").select(F.md5(run.normalized(F.upper("query")).cast("binary")).alias("query_hash"), F.concat(F.lit("answer "), F.col("item_id").cast("string")).alias("answer"))
    return run.cached(q, known).drop("query")


@query("SELECT doc_id, source AS tenant FROM documents WHERE source = 'src3'")
def tenant_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.tenant_only(read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("tenant")), "src3")


@query(f"SELECT doc_id::VARCHAR AS source_id FROM documents WHERE doc_id NOT IN (SELECT id FROM ({BM25_SQL.format(k=10)}))")
def source_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lexical_hits(spark, sf_dir, 10).select(F.col("id").cast("string").alias("source_id"))
    return run.source_gaps(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_id")), hits)


@query(f"SELECT label AS cluster, count(*) AS n, count(*) FILTER (WHERE best < 0.45::DOUBLE) AS low, avg((best < 0.45::DOUBLE)::INT) AS share FROM (SELECT query_id, max(score) AS best FROM ({knn_sql(5)}) GROUP BY query_id) h JOIN embeddings e ON h.query_id = e.vec_id GROUP BY label")
def query_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("cluster"))
    return run.query_gaps(near(spark, sf_dir, 5), clusters, 0.45)


@query(f"SELECT query_id, max(score) AS best, CASE WHEN max(score) >= 0.6::DOUBLE THEN 'good' WHEN max(score) >= 0.3::DOUBLE THEN 'doubtful' ELSE 'ask again' END AS grade FROM ({knn_sql(5)}) GROUP BY query_id")
def retrieval_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.graded(near(spark, sf_dir, 5), "score")


@query()
def query_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.query_clusters(ask_embeddings(read(spark, sf_dir, "embeddings")), 4)


@query()
def query_time_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.chunk_at_query_time(lexical_hits(spark, sf_dir, 3), read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


# --- evaluation ------------------------------------------------------------------------------


@query(rf"""
SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({ASCII.format("text")}, '\$[\d,]+|\d+%|[A-Z]{{2,}}-?\d*|[A-Z][a-z]{{3,}}|\b[a-z]{{6,}}\b|\b\d{{3,}}\b'), lambda t: lower(t)), lambda t: t NOT IN ({STOP})))) AS terms FROM documents
""")
def keyword_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.array_sort(X.distinctive_terms(F.col("text"))).alias("terms"))


KEY_SQL = rf"""regexp_extract_all({ASCII.format("text")}, '\$[\d,]+(?:\.\d+)?|\d+\s*%|\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}|\b\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b|[A-Z]{{2,}}(?:-\d+)?|[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*|\b[a-z]{{5,}}\b|\b\d+\b')"""
TERMS_SQL = f"""
ts AS (SELECT item_id, unnest({KEY_SQL}) AS t, generate_subscripts({KEY_SQL}, 1) AS i FROM benchmark),
firsts AS (SELECT item_id, lower(trim(t)) AS k, arg_min(t, i) AS t, min(i) AS i FROM ts WHERE lower(trim(t)) NOT IN ({AUDIT_STOP}) GROUP BY item_id, lower(trim(t))),
terms AS (SELECT item_id, list(t ORDER BY i) AS terms FROM firsts GROUP BY item_id)
"""


@query(f"WITH {TERMS_SQL} SELECT item_id, terms[1:10] AS terms FROM terms")
def audit_key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", X.slice_terms(X.key_terms(F.col("text")), 10).alias("terms")).filter(F.size("terms") > 0)


@query(f"""
WITH {TERMS_SQL} SELECT b.item_id, d.doc_id, len(terms[1:10]) AS total, len(list_filter(terms[1:10], lambda t: contains(lower(d.text), lower(t)))) AS found
FROM terms b JOIN documents d ON b.item_id = d.doc_id
""")
def audit_answerability(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark").select("item_id", X.slice_terms(X.key_terms(F.col("text")), 10).alias("terms")).filter(F.size("terms") > 0)
    d = read(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("low"))
    found = F.size(F.filter("terms", lambda t: F.contains(F.col("low"), F.lower(t))))
    return b.join(d, F.col("item_id") == F.col("doc_id")).select("item_id", "doc_id", F.size("terms").cast("long").alias("total"), found.cast("long").alias("found"))


@query(rf"""
WITH {TERMS_SQL}, q AS (SELECT item_id, list_filter(terms, lambda t: regexp_matches(t, '^[$A-Z\d]') OR length(t) > 7)[1:5] AS ds FROM terms),
hits AS (SELECT item_id, doc_id, len(ds) AS n, len(list_filter(ds, lambda t: contains(lower(text), lower(t)))) AS hits FROM q, documents WHERE doc_id <> item_id AND len(ds) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id::VARCHAR) AS place FROM hits WHERE hits >= greatest(2, n - 1))
SELECT item_id, list(doc_id::VARCHAR ORDER BY place) AS alternates FROM ranked WHERE place <= 5 GROUP BY item_id
""")
def audit_alternates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.array(F.col("item_id").cast("string")).alias("expected_source_ids"), X.slice_terms(F.filter(X.key_terms(F.col("text")), X.is_distinctive), 5).alias("distinctive"))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("content"))
    return evaluate.other_sources(b, d).withColumnRenamed("id", "item_id")


QUERY_SQL = rf"""regexp_extract_all({ASCII.format("text")}, '\$[\d,]+(?:\.\d+)?|\d+\s*%|[A-Z]{{2,}}(?:-\d+)?|[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*|\b[a-z]{{5,}}\b|\b\d+\b')"""
SUBJECT_STOP = ", ".join(f"'{w}'" for w in sorted({*X.AUDIT_STOP_WORDS, *X.QUESTION_WORDS, *X.DOMAIN_WORDS}))


def golden_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as golden questions: the document of the same number is the source; some have a source that isn't there, some none."""
    i, none = F.col("item_id"), F.array().cast("array<string>")
    sources = F.when(i % 11 == 0, none).when(i % 7 == 0, F.array(i.cast("string"), F.concat(F.lit("gone-"), i))).otherwise(F.array(i.cast("string")))
    return read(spark, sf_dir, "benchmark").select(i.alias("id"), F.col("text").alias("query"), F.col("text").alias("answer"), sources.alias("expected_source_ids"))


@query(rf"""
WITH {TERMS_SQL}, g AS (SELECT item_id, text, CASE WHEN item_id % 11 = 0 THEN [] WHEN item_id % 7 = 0 THEN [item_id::VARCHAR, 'gone-' || item_id] ELSE [item_id::VARCHAR] END AS ids FROM benchmark),
asked AS (SELECT item_id, unnest({QUERY_SQL}) AS t, generate_subscripts({QUERY_SQL}, 1) AS i FROM benchmark),
subjects AS (SELECT item_id, list(t ORDER BY i)[1:8] AS subject FROM (SELECT item_id, lower(trim(t)) AS k, arg_min(t, i) AS t, min(i) AS i FROM asked WHERE lower(trim(t)) NOT IN ({SUBJECT_STOP}) GROUP BY ALL) GROUP BY item_id),
found AS (SELECT g.item_id, len(list_filter(subject, lambda t: NOT contains(lower(d.text), lower(t)))) > 0 AS lacking FROM g JOIN documents d ON d.doc_id::VARCHAR = ids[1] JOIN subjects s ON s.item_id = g.item_id),
gone AS (SELECT DISTINCT item_id FROM (SELECT item_id, unnest(ids) AS source FROM g) WHERE source NOT IN (SELECT doc_id::VARCHAR FROM documents)),
q AS (SELECT item_id, list_filter(terms, lambda t: regexp_matches(t, '^[$A-Z\d]') OR length(t) > 7)[1:5] AS ds FROM terms),
others AS (SELECT DISTINCT q.item_id FROM q JOIN g USING (item_id), documents d WHERE len(ds) > 0 AND NOT list_contains(ids, d.doc_id::VARCHAR) AND len(list_filter(ds, lambda t: contains(lower(d.text), lower(t)))) >= greatest(2, len(ds) - 1))
SELECT count(*) AS n, count(*) FILTER (WHERE len(ids) = 0) AS no_source_id, count(gone.item_id) AS missing_source, count(*) FILTER (WHERE lacking) AS subject_missing, count(others.item_id) AS has_alternates
FROM g LEFT JOIN gone USING (item_id) LEFT JOIN found USING (item_id) LEFT JOIN others USING (item_id)
""")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("content"))
    return evaluate.audit_counts(evaluate.audit(golden_set(spark, sf_dir), d))


@query(rf"""
WITH e AS (SELECT item_id, list_distinct(list_filter(list_transform(regexp_extract_all({ASCII.format("text")}, '\$[\d,]+|\d+%|[A-Z]{{2,}}-?\d*|[A-Z][a-z]{{3,}}|\b[a-z]{{6,}}\b|\b\d{{3,}}\b'), lambda t: lower(t)), lambda t: t NOT IN ({STOP}))) AS terms FROM benchmark)
SELECT e.item_id, round(len(list_filter(terms, lambda t: contains(lower(d.text), t))) / len(terms), 6) AS recall FROM e JOIN documents d ON d.doc_id = e.item_id WHERE len(terms) > 0
""")
def keyword_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark").select("item_id", X.distinctive_terms(F.col("text")).alias("terms"))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("context"))
    return b.join(d, "item_id").select("item_id", F.round(X.share_present(F.col("terms"), F.col("context")), 6).alias("recall")).filter("recall is not null")


@query("SELECT role, count(*) AS n, avg(CASE WHEN contains(text, 'I don''t know') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS idk_rate, floor(avg(length(text)))::BIGINT AS avg_chars FROM conversations GROUP BY role")
def idk_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("n"), F.avg(F.when(F.contains("text", F.lit(X.IDK)), 1.0).otherwise(0.0)).alias("idk_rate"), F.floor(F.avg(F.char_length("text"))).alias("avg_chars"))


@query("""
SELECT metric, count(*) AS n, avg(score)::DOUBLE AS mean, avg((score >= 1)::INT) AS pass_rate FROM (SELECT 'quality' AS metric, quality AS score FROM labels UNION ALL SELECT 'toxic', CASE WHEN doc_id % 5 > 0 THEN toxic END FROM labels) WHERE score IS NOT NULL GROUP BY metric
""")
def metric_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.struct(c.cast("double").alias("score"), (c >= 1).alias("success"))
    toxic = F.when(F.col("doc_id") % 5 > 0, F.col("toxic"))
    return evaluate.score_summary(read(spark, sf_dir, "labels").select(F.create_map(F.lit("quality"), s(F.col("quality")), F.lit("toxic"), s(toxic)).alias("scores")))


@query("""
WITH m AS (SELECT doc_id % 2 AS half, avg(quality) AS top1_source_match_rate, avg(toxic) AS idk_rate FROM labels GROUP BY 1),
c AS (SELECT * FROM m WHERE half = 0), b AS (SELECT * FROM m WHERE half = 1),
rows AS (SELECT 'top1_source_match_rate' AS metric, c.top1_source_match_rate AS current, b.top1_source_match_rate AS baseline, 'down' AS dir, 0.05 AS tol, false AS less FROM c, b
    UNION ALL SELECT 'idk_rate', c.idk_rate, b.idk_rate, 'up', 0.10, true FROM c, b
    UNION ALL SELECT unnest(['topk_source_match_rate', 'answer_keyword_recall_mean']), NULL, NULL, 'down', 0.05, false)
SELECT metric, current, baseline, current - baseline AS delta,
    CASE WHEN current IS NULL THEN 'missing' WHEN abs(current - baseline) <= 0.001 THEN 'same' WHEN (less AND current < baseline) OR (NOT less AND current > baseline) THEN 'better' ELSE 'worse' END AS verdict,
    coalesce(CASE WHEN dir = 'down' THEN current - baseline < -tol ELSE current - baseline > tol END, true) AS failed FROM rows
""")
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    side = lambda half: evaluate.as_metrics(labels.filter(F.col("doc_id") % 2 == half).agg(F.avg("quality").alias("top1_source_match_rate"), F.avg("toxic").alias("idk_rate")), ["top1_source_match_rate", "idk_rate"])
    return evaluate.gate(side(0), side(1))


@query("SELECT source, sum(length(text) // 4)::BIGINT AS input_tokens, round(sum(length(text) // 4) * 3.0::DOUBLE / 1e6 + count(*) * 150 * 15.0::DOUBLE / 1e6, 6) AS dollars FROM documents GROUP BY source")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.floor(F.char_length("text") / 4)).alias("input_tokens"), (F.count("*") * 150).alias("out"))
    return d.select("source", "input_tokens", F.round(telemetry.cost(telemetry.GENERATE, {"input": F.col("input_tokens"), "output": F.col("out")}), 6).alias("dollars"))


@query("SELECT lang, source, count(*) AS n, avg(quality) AS quality, avg(toxic) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, source)")
def segment_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    return d.rollup("lang", "source").agg(F.count("*").alias("n"), F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))


@query("SELECT kind, found, needed, found >= needed AS enough FROM (SELECT 'long_texts' AS kind, count(*) FILTER (WHERE length(text) > 2000) AS found, 10::BIGINT AS needed FROM documents UNION ALL SELECT 'spanish', count(*) FILTER (WHERE lang = 'es'), 5 FROM documents UNION ALL SELECT 'icelandic', count(*) FILTER (WHERE lang = 'is'), 1 FROM documents)")
def golden_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.composition(read(spark, sf_dir, "documents"), {"long_texts": (F.char_length("text") > 2000, 10), "spanish": (F.col("lang") == "es", 5), "icelandic": (F.col("lang") == "is", 1)})


@query("""
WITH w AS (SELECT b.item_id AS pair_id, regexp_extract_all(lower(b.text), '[a-z0-9]+') AS r, regexp_extract_all(lower(d.text), '[a-z0-9]+') AS c FROM benchmark b JOIN documents d ON b.item_id = d.doc_id),
rc AS (SELECT pair_id, g, count(*) AS r FROM (SELECT pair_id, unnest(r) AS g FROM w) GROUP BY 1, 2), cc AS (SELECT pair_id, g, count(*) AS c FROM (SELECT pair_id, unnest(c) AS g FROM w) GROUP BY 1, 2),
j AS (SELECT pair_id, sum(least(coalesce(r, 0), coalesce(c, 0))) AS hits, sum(coalesce(c, 0)) AS c, sum(coalesce(r, 0)) AS r FROM rc FULL JOIN cc USING (pair_id, g) GROUP BY pair_id)
SELECT pair_id, round(hits / nullif(r, 0), 6) AS recall, round(hits / nullif(c, 0), 6) AS precision, round(2.0::DOUBLE * hits / nullif(c + r, 0), 6) AS f1 FROM j
""")
def rouge_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pair_id"), F.col("text").alias("reference"))
    return lexical.ngram_overlap(b.join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), F.col("text").alias("candidate")), "pair_id"))


@query("SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS both_pass, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS judge_only, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS human_only, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS both_fail, avg(((quality = 1) = (toxic = 0))::INT) AS agreement, avg(((quality = 1) = (toxic = 0))::INT) >= 0.9 AS enough FROM labels")
def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.agreement(read(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("judge"), (F.col("toxic") == 0).alias("human")))


@query("SELECT quality, doc_id AS id, score, place FROM (SELECT l.quality, l.doc_id, d.n_chars AS score, row_number() OVER (PARTITION BY quality ORDER BY d.n_chars, l.doc_id)::INT AS place FROM labels l JOIN documents d USING (doc_id)) WHERE place <= 5")
def worst_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score")), "doc_id").select("quality", F.col("doc_id").alias("id"), "score")
    return evaluate.worst(rows, "quality", 5)


@query()
def offline_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offline generator and judges over benchmark passages and the documents of the same number."""
    b = read(spark, sf_dir, "benchmark").join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("context")), "item_id")
    rows = b.withColumn("answer", models.answer_column(F.col("text"), F.array("context")))
    return rows.select("item_id", "answer", F.explode(models.judge_columns(F.col("text"), F.col("answer"), F.col("text"), F.col("context"))).alias("metric", "s")).select("item_id", "answer", "metric", "s.score", "s.success")


@query()
def evaluation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records over benchmark passages as golden questions, with the offline models, judged and summed up."""
    d = read(spark, sf_dir, "documents")
    chunks = chunking.paragraphs(d, "doc_id", "text").withColumnRenamed("doc_id", "document_id")
    chunks = models.embed(chunks.withColumns({"id": F.xxhash64("document_id", "chunk_index"), "heading_path": F.array(F.lit("Documents")), "chunk_type": F.lit("text")}), "content")
    docs = d.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("source_id"), F.col("source").alias("title"), F.lit("").alias("source_url"))
    golden = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("id"), F.col("text").alias("query"), F.col("text").alias("answer"), F.col("item_id").cast("string").alias("source_article_id"), F.lit(None).cast("array<string>").alias("source_article_id_alt"), F.lit("passage").alias("query_type"))
    return evaluate.proxies(run.evaluation(golden, chunks, docs))


# --- ingestion -------------------------------------------------------------------------------


@query("""
SELECT chunk_type, count(*) AS n FROM (SELECT CASE WHEN contains(lower(html), '<table') THEN 'table'
    WHEN (contains(lower(html), '<ul') OR contains(lower(html), '<ol')) AND len(regexp_extract_all(lower(html), '<li')) / greatest(len(string_split(html, chr(10))), 1) > 0.3 THEN 'list' ELSE 'text' END AS chunk_type FROM pages) GROUP BY chunk_type
""")
def chunk_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.type_counts(read(spark, sf_dir, "pages").select(X.chunk_type(F.col("html")).alias("chunk_type")))


@query("""
WITH t AS (SELECT ceil(length(text) / 4)::INT AS t FROM documents)
SELECT count(*) AS n, min(t) AS min_tokens, max(t) AS max_tokens, count(*) FILTER (WHERE t < 256) AS under_256, count(*) FILTER (WHERE t BETWEEN 256 AND 511) AS from_256, count(*) FILTER (WHERE t BETWEEN 512 AND 1023) AS from_512,
    count(*) FILTER (WHERE t >= 1024) AS from_1024, list_sort(list(t))[count(*) // 2 + 1] AS median_tokens FROM t
""")
def token_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.token_distribution(read(spark, sf_dir, "documents"), X.count_tokens(F.col("text")))


@query(r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages
""")
def html_strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", X.strip_markup(F.col("html")).alias("text"))


@query(r"""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>')) AS m FROM pages)
SELECT page_id, level, text FROM (SELECT page_id, substr(m, 3, 1)::INT AS level, trim(regexp_replace(m, '(?s)<[^>]+>', '', 'g')) AS text FROM h) WHERE text <> ''
""")
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.explode(X.headings(F.col("html"))).alias("h")).select("page_id", "h.level", "h.text")


@query(r"SELECT page_id, regexp_matches(html, '(?i)<table[\s>]') AS contains_table, regexp_matches(html, '(?i)<[ou]l[\s>]') AS contains_list FROM pages")
def html_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", X.content_flags(F.col("html")).alias("f")).select("page_id", "f.*")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def texts_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, t): documents with a visible text, as HTML writes it."""
    return read(spark, sf_dir, "documents").filter(F.col("text").rlike(r"\S") & F.col("source").isNotNull()).select("doc_id", "source", escaped(F.col("text")).alias("t"))


@query(rf"""SELECT doc_id, '<p href="y">' || {ESCAPED} || '</p><b>' || source || '</b>' AS html FROM documents WHERE regexp_matches(text, '\S') AND source IS NOT NULL""")
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts, comments, forms and odd attributes around every text, cleaned away."""
    made = F.concat(F.lit('<!-- c --><script>var a = "</p>";</script><meta name="x"><p class="k" href="y" onclick="z">'), "t", F.lit("</p><form><b id=i>"), "source", F.lit("</b></form><style>p{}</style>"))
    return texts_with(spark, sf_dir).select("doc_id", H.column(H.clean, H.pa.string(), "string")(made).alias("html"))


@query(rf"""SELECT doc_id, '<p>' || {ESCAPED} || '</p><ul><li>' || source || '<hr></li></ul><div><img></div>' AS html FROM documents WHERE regexp_matches(text, '\S') AND source IS NOT NULL""")
def html_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual carriers, empty elements and stray rules around every text, tidied away."""
    made = F.concat(F.lit("<p></p><p><span><font>"), "t", F.lit("</font></span></p><div> <b></b></div><hr><a></a><ul><li>"), "source", F.lit("<span><hr></span></li></ul><div><img></div>"))
    return texts_with(spark, sf_dir).select("doc_id", H.column(H.tidy, H.pa.string(), "string")(made).alias("html"))


@query(rf"""
WITH h AS (SELECT doc_id, '<p>' || {ESCAPED} || '</p>' AS cell, '<table><tr><td>' || '<p>' || {ESCAPED} || '</p></td></tr></table>' AS tab FROM documents WHERE regexp_matches(text, '\S') AND source IS NOT NULL)
SELECT doc_id, ceil(length(tab) / 4) >= 5000 AS layout, CASE WHEN ceil(length(tab) / 4) >= 5000 THEN '<div><p>a</p><div>' || cell || '</div></div>' ELSE '<p>a</p>' || tab END AS html FROM h
""")
def html_table_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in a table in a div: large tables are frames and give way, divs around other tables go."""
    made = F.concat(F.lit("<div><p>a</p><table><tr><td><p>"), "t", F.lit("</p></td></tr></table></div>"))
    html = H.column(lambda x: H.unwrap_table_divs(H.unwrap_layout_tables(x)), H.pa.string(), "string")(made)
    return texts_with(spark, sf_dir).select("doc_id", html.alias("html")).select("doc_id", F.col("html").startswith("<div>").alias("layout"), "html")


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split({ESCAPED}, chr(10))) AS x, generate_subscripts(string_split({ESCAPED}, chr(10)), 1) AS i FROM documents WHERE regexp_matches(text, '\S') AND source IS NOT NULL),
m AS (SELECT doc_id, i, CASE WHEN i % 3 = 1 THEN 'Part ' || i END AS head, '<p>' || x || '</p>' AS p FROM l),
g AS (SELECT *, count(head) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM m)
SELECT doc_id, max(head) AS heading, string_agg(p, '' ORDER BY i) AS content FROM g GROUP BY doc_id, part
""")
def html_heading_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading before every third line of every text, cut at the headings."""
    line = lambda x, i: F.concat(F.when(i % 3 == 0, F.concat(F.lit("<h2>Part "), (i + 1).cast("string"), F.lit("</h2>"))).otherwise(""), F.lit("<p>"), x, F.lit("</p>"))
    made = F.concat(F.lit("<html><body>"), F.array_join(F.transform(F.split("t", "\n"), line), ""), F.lit("</body></html>"))
    parts = H.column(lambda x: [{"heading": c.headings.get("h2"), "content": c.content} for c in H.split_at_headings(x)], H.pa.list_(H.pa.struct([("heading", H.pa.string()), ("content", H.pa.string())])), "array<struct<heading:string,content:string>>")
    return texts_with(spark, sf_dir).select("doc_id", F.explode(parts(made)).alias("c")).select("doc_id", "c.*")


@query(r"""
SELECT page_id, name, level FROM (SELECT page_id, name, CASE WHEN regexp_matches(name, '^[Tt]op$|^_[Tt][Oo][Pp]$') THEN NULL WHEN regexp_matches(name, '^S[IVX]+$') THEN 'h2' WHEN regexp_matches(name, '^Topic\d+$') THEN 'h2' WHEN regexp_matches(name, '^f\d+|^_Hlk') THEN NULL
    WHEN regexp_matches(name, '^\d{3,}\d[a-z]$') THEN 'h4' WHEN regexp_matches(name, '^\d{3,}[a-z]$') THEN 'h4' WHEN regexp_matches(name, '^\d{3,}$') THEN 'h3' WHEN regexp_matches(name, '^[A-Z]$') THEN 'h3' WHEN regexp_matches(name, '^[A-Z][a-z]$') THEN 'h4' END AS level
    FROM (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'Top' WHEN 1 THEN 'SIV' WHEN 2 THEN 'Topic' || page_id WHEN 3 THEN 'f' || page_id WHEN 4 THEN (1000 + page_id) || 'a' WHEN 5 THEN (1000 + page_id)::VARCHAR WHEN 6 THEN 'B' ELSE 'Ab' END AS name FROM pages)) WHERE level IS NOT NULL
""")
def html_anchor_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named anchors of every kind, one for each page, made headings."""
    i = F.col("page_id")
    known = [F.lit("Top"), F.lit("SIV"), F.concat(F.lit("Topic"), i.cast("string")), F.concat(F.lit("f"), i.cast("string")), F.concat((1000 + i).cast("string"), F.lit("a")), (1000 + i).cast("string"), F.lit("B"), F.lit("Ab")]
    made = F.concat(F.lit('<div><p><a name="'), F.element_at(F.array(*known), (i % 8 + 1).cast("int")), F.lit('"></a><strong>A title</strong> and more</p></div>'))
    out = read(spark, sf_dir, "pages").select("page_id", H.column(H.anchors_to_headings, H.pa.string(), "string")(made).alias("html"))
    hit = lambda g: F.regexp_extract("html", r'^<div><(h[1-6]) id="([^"]+)">A title</h[1-6]></div>$', g)
    return out.select("page_id", hit(2).alias("name"), hit(1).alias("level")).filter("level <> ''")


@query()
def html_structural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("source_id"), F.col("html").alias("content"))
    return chunking.chunk_articles(pages)


@query()
def recursive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = H.column(H.split_prose, H.pa.list_(H.pa.string()), "array<string>")
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(split(F.col("text"))).alias("piece", "content"))


@query()
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.concat(F.lit("# "), F.col("source"), F.lit("\n"), F.col("text")).alias("content"))
    return chunking.chunk_articles(docs, markdown=True)


@query()
def enrich_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("source_id"), "html")
    return enrich.enrich(pages).drop("html")


@query("""
WITH p AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
c AS (SELECT * FROM p WHERE content <> '')
SELECT doc_id::VARCHAR AS source_id, any_value(source) AS title, string_agg(content, chr(10) || chr(10) ORDER BY i) = any_value(raw) AS whole, count(*) AS n_chunks, sum(ceil(length(content) / 4))::BIGINT AS n_tokens
FROM c JOIN documents USING (doc_id) JOIN (SELECT doc_id, string_agg(content, chr(10) || chr(10) ORDER BY i) AS raw FROM c GROUP BY doc_id) USING (doc_id) GROUP BY doc_id
""")
def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all documents added to a bucketed store twice, and summed by document without a shuffle."""
    d = read(spark, sf_dir, "documents").filter("doc_id is not null").withColumnRenamed("source", "title")
    parts = chunking.paragraphs(d, "doc_id", "text", "title")
    chunks = parts.select(
        F.col("doc_id").cast("string").alias("source_id"), "chunk_index", "content", "title", X.count_tokens(F.col("content")).alias("token_count"), F.lit("text").alias("chunk_type"),
        F.array("title").alias("heading_path"), F.lit(False).alias("oversized"), F.lit("").alias("context"),
    )
    kept = store.ChunkStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", buckets=16)
    for _ in range(2):
        kept.add(chunks)
    # chunks are summed before the join, so that no chunk carries its document's text
    sums = kept.all_chunks().groupBy(F.col("document_id").alias("id")).agg(chunking.joined("chunk_index", "content").alias("again"), F.count("*").alias("n_chunks"), F.sum("token_count").alias("n_tokens"))
    return kept.documents().hint("merge").join(sums, "id").select("source_id", "title", (F.col("raw_content") == F.col("again")).alias("whole"), "n_chunks", "n_tokens")


@query("SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, content FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE content <> ''")
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.paragraphs(read(spark, sf_dir, "documents"), "doc_id", "text")


@query("""
WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents),
fold AS (SELECT doc_id, ps, 0 AS i, []::VARCHAR[] AS done, '' AS carry FROM p
    UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN ceil(length(j) / 4) < 50 THEN done ELSE list_append(done, j) END, CASE WHEN ceil(length(j) / 4) < 50 THEN j ELSE '' END
    FROM (SELECT *, CASE WHEN carry = '' THEN ps[i + 1] ELSE carry || chr(10) || ps[i + 1] END AS j FROM fold WHERE i < len(ps)))
SELECT doc_id, CASE WHEN carry = '' THEN done ELSE list_append(done, carry) END AS merged FROM fold WHERE i = len(ps)
""")
def merge_small_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return read(spark, sf_dir, "documents").select("doc_id", chunking.merge_small(parts, lambda c: X.count_tokens(c), 50).alias("merged"))


@query("""
WITH RECURSIVE o AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS qs FROM lineitem GROUP BY l_orderkey),
fold AS (SELECT l_orderkey, qs, 0 AS i, []::INT[] AS groups, 0 AS g, 0.0::DOUBLE AS used FROM o
    UNION ALL SELECT l_orderkey, qs, i + 1, list_append(groups, CASE WHEN i > 0 AND used + qs[i + 1] > 80 THEN g + 1 ELSE g END), CASE WHEN i > 0 AND used + qs[i + 1] > 80 THEN g + 1 ELSE g END, CASE WHEN i > 0 AND used + qs[i + 1] > 80 THEN qs[i + 1] ELSE used + qs[i + 1] END FROM fold WHERE i < len(qs))
SELECT l_orderkey, groups FROM fold WHERE i = len(qs)
""")
def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda s: s["l_quantity"]).alias("qs"))
    return lines.select("l_orderkey", chunking.pack_greedily(F.col("qs"), 80).alias("groups"))


@query("""
SELECT conv_id, string_agg('[Chunk ' || (turn + 1) || ']' || chr(10) || 'Source: ' || conv_id || ' — ' || role || chr(10) || 'Heading: ' || role || ' > ' || turn || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS raw_content, count(*) AS n_chunks FROM conversations GROUP BY conv_id
""")
def context_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    block = X.format_chunk(F.col("turn") + 1, F.col("conv_id").cast("string"), F.col("role"), F.array("role", F.col("turn").cast("string")), F.col("text"))
    return chunking.ordered_text(c.withColumn("block", block), ["conv_id"], "turn", "block", "\n\n---\n\n")


@query("SELECT conv_id, substr(string_agg(text, chr(10) || chr(10) ORDER BY turn), 1, 30000) AS raw_content, count(*) AS n_chunks FROM conversations GROUP BY conv_id")
def doc_text_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.ordered_text(read(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", limit=30_000)


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS raw_content, count(*) AS n_chunks FROM conversations GROUP BY conv_id")
def insert_documents_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.ordered_text(read(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")


@query("""
SELECT doc_id, CASE WHEN ctx <> '' THEN ctx || chr(10) || chr(10) || base ELSE base END AS embed_text FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'About ' || lang ELSE '' END AS ctx,
    CASE WHEN n_chars <= 4096 THEN text WHEN doc_id % 2 = 0 THEN source || ' | ' || lang ELSE lang END AS base FROM documents)
""")
def embed_text_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    ctx = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("About "), F.col("lang")))
    return read(spark, sf_dir, "documents").select("doc_id", X.embed_text(F.col("text"), F.col("n_chars") > 4096, title, F.array(F.lit(""), title, F.col("lang")), ctx).alias("embed_text"))


@query("""
SELECT doc_id, coalesce(nullif(substr(trim(regexp_replace(text, '[^a-zA-Z0-9]+', '_', 'g'), '_'), 1, 50), ''), 'x') || '__' || doc_id AS request_id FROM documents
""")
def request_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.request_id(X.request_token(F.col("text")), F.col("doc_id")).alias("request_id"))


@query("""
SELECT 'c' || c_custkey AS id, [r_name, n_name, c_name] AS breadcrumb FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'n' || n_nationkey, [r_name, n_name] FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'r' || r_regionkey, [r_name] FROM region
""")
def breadcrumb_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.breadcrumbs(tree(spark, sf_dir))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = lambda p, k, parent, name: (F.concat(F.lit(p), k.cast("string")).alias("id"), parent.alias("parent_id"), F.col(name).alias("name"))
    r = read(spark, sf_dir, "region").select(*node("r", F.col("r_regionkey"), F.lit(None).cast("string"), "r_name"))
    n = read(spark, sf_dir, "nation").select(*node("n", F.col("n_nationkey"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "n_name"))
    return r.unionByName(n).unionByName(read(spark, sf_dir, "customer").select(*node("c", F.col("c_custkey"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), "c_name")))


@query("SELECT 'r' || n_regionkey AS id, list_sort(list('n' || n_nationkey)) AS child_ids FROM nation GROUP BY n_regionkey UNION ALL SELECT 'n' || c_nationkey, list_sort(list('c' || c_custkey)) FROM customer GROUP BY c_nationkey")
def topic_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.children(tree(spark, sf_dir))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.not_yet(read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT doc_id, coalesce('q' || quality, lang) AS context FROM (SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 0) d FULL JOIN labels l USING (doc_id)")
def context_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id", F.col("lang").alias("context"))
    new = read(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("context"))
    return maintenance.merge_contexts(old, new, ["doc_id"])


@query("""
SELECT 'null text' AS rule, count(*) FILTER (WHERE text IS NULL) AS violations FROM documents UNION ALL SELECT 'null source', count(*) FILTER (WHERE source IS NULL) FROM documents
UNION ALL SELECT 'repeated text', count(*) FROM (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'orphan label', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 7 > 0)
""")
def constraint_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    nulls = schemas.null_counts(d, ["text", "source"]).select(F.concat(F.lit("null "), F.col("column_name")).alias("rule"), "violations")
    repeats = schemas.duplicates(d.select(F.md5(F.col("text").cast("binary")).alias("h")), ["h"]).agg(F.count("*").alias("violations")).select(F.lit("repeated text").alias("rule"), "violations")
    orphans = schemas.orphans(read(spark, sf_dir, "labels"), d.filter("doc_id % 7 > 0"), "doc_id").agg(F.count("*").alias("violations")).select(F.lit("orphan label").alias("rule"), "violations")
    return nulls.unionByName(repeats).unionByName(orphans)


# --- upkeep ----------------------------------------------------------------------------------


@query(r"""
SELECT doc_id, regexp_matches(trim(text), '^[a-z,;)]') AS mid_sentence, regexp_matches(lower(text), '(?s)^\s*<tr\b') OR (contains(lower(text), '<table') AND NOT contains(lower(text), '<th')) AS headless_rows, doc_id % 2 = 1 AS no_heading FROM documents
""")
def orphan_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("doc_id") % 2 == 0, F.array("source"))
    return read(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in maintenance.orphan_flags(F.col("text"), path).items()])


SECRET_SQL = r"AKIA[0-9A-Z]{16}|(?i:password|passwd|token|secret|api_key)\s*[=:]\s*\S{6,}"


@query(rf"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{SECRET_SQL}', '[secret]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', '[email]', 'g'), 'https?://(?:localhost|[A-Za-z0-9.-]+\.(?:internal|local|corp))(?:[:/]\S*)?', '[url]', 'g') AS redacted
FROM documents WHERE regexp_matches(text, '{SECRET_SQL}')
""")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").filter(maintenance.has_secret(F.col("text"))).select("doc_id", maintenance.redact(F.col("text")).alias("redacted"))


@query(r"SELECT page_id, regexp_matches(html, '\S{201,}') AS blob, regexp_matches(lower(html), '<img\b') AND trim(regexp_replace(html, '(?s)<[^>]*>', '', 'g')) = '' AS image_only FROM pages")
def base64_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", maintenance.is_blob(F.col("html")).alias("blob"), maintenance.is_image_only(F.col("html")).alias("image_only"))


@query("SELECT l_orderkey AS parent_table_id, 'Table with ' || count(*) || ' rows and columns l_partkey, l_quantity.' AS content, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey")
def table_summary_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.table_summaries(read(spark, sf_dir, "lineitem"), "l_orderkey", ["l_partkey", "l_quantity"])


@query("SELECT DISTINCT h.conv_id AS document_id, c.turn AS chunk_index, h.conv_id AS query_id, c.role FROM conversations h JOIN conversations c ON h.conv_id = c.conv_id AND c.turn BETWEEN h.turn - 1 AND h.turn + 1 WHERE h.turn = 2")
def sibling_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), "role")
    hits = c.filter("chunk_index = 2").select(F.col("document_id").alias("query_id"), "document_id", "chunk_index")
    return maintenance.neighbours(hits, c)


@query("""
WITH o AS (SELECT doc_id, text FROM documents WHERE doc_id % 5 > 0), n AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 5 < 4)
SELECT doc_id, CASE WHEN o.text IS NULL THEN 'added' WHEN n.text IS NULL THEN 'removed' WHEN o.text <> n.text THEN 'changed' ELSE 'same' END AS change FROM o FULL JOIN n USING (doc_id)
""")
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    new = d.filter("doc_id % 5 < 4").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return maintenance.changes(d.filter("doc_id % 5 > 0"), new, "doc_id", "text")


@query(r"""
SELECT conv_id, turn, coalesce(lag(trim(regexp_extract(trim(text), '([^.!?]*[.!?]?)$', 1))) OVER (PARTITION BY conv_id ORDER BY turn), '') AS previous_sentence FROM conversations
""")
def heading_prepend_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.with_previous_sentence(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "previous_sentence")


@query(r"""
WITH w AS (SELECT p_partkey AS id, list_distinct(list_filter(string_split_regex(lower(p_name || ' ' || p_brand), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS ws FROM part)
SELECT a, b, round(s / u, 6) AS similarity FROM (SELECT x.id AS a, y.id AS b, len(list_intersect(x.ws, y.ws)) AS s, len(x.ws) + len(y.ws) - len(list_intersect(x.ws, y.ws)) AS u FROM w x JOIN w y ON x.id < y.id) WHERE s > 0 AND s / u >= 0.6
""")
def title_similarity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" "), "p_brand").alias("title"))
    return maintenance.title_links(parts, "p_partkey", "title", 0.6)


@query(r"""
WITH w AS (SELECT p_partkey AS id, list_sort(list_distinct(list_filter(string_split_regex(lower(p_name), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS ws FROM part),
c AS (SELECT ws, min(id) AS class_id FROM w WHERE len(ws) > 0 GROUP BY ws),
l AS (SELECT x.class_id AS a, y.class_id AS b FROM c x JOIN c y ON x.class_id <> y.class_id WHERE len(list_intersect(x.ws, y.ws)) / (len(x.ws) + len(y.ws) - len(list_intersect(x.ws, y.ws))) >= 0.6)
SELECT id AS p_partkey, class_id, (SELECT count(*) FROM l WHERE l.a = c.class_id) AS n_links FROM w JOIN c USING (ws)
""")
def title_link_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part with the class of its name's words, and how many other classes that one links to."""
    members = maintenance.title_classes(read(spark, sf_dir, "part"), "p_partkey", "p_name")
    links = maintenance.class_links(members, 0.6)
    ends = links.select(F.col("a").alias("class_id")).unionByName(links.select(F.col("b").alias("class_id"))).groupBy("class_id").agg(F.count("*").alias("n_links"))
    return members.join(ends, "class_id", "left").select(F.col("id").alias("p_partkey"), "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


@query("""
WITH l AS (SELECT DISTINCT l_suppkey AS doc, l_partkey % 100 AS target FROM lineitem)
SELECT a.doc, a.target, b.doc IS NOT NULL AS mutual FROM l a LEFT JOIN l b ON a.doc = b.target AND a.target = b.doc
""")
def explicit_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("doc")).agg(F.collect_set(F.col("l_partkey") % 100).alias("links"))
    return maintenance.explicit_links(links, "doc", "links")


@query(r"SELECT event_type, list_filter(string_split(trim(regexp_replace(lower(regexp_replace(regexp_replace(event_type || 'Event_idValue', '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS words FROM (SELECT DISTINCT event_type FROM events)")
def identifier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_type").distinct().select("event_type", X.identifier_words(F.concat("event_type", F.lit("Event_idValue"))).alias("words"))


@query("SELECT doc_id, '[' || list_aggregate(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), 'string_agg', ',') || ']' AS literal FROM (SELECT vec_id AS doc_id, embedding FROM embeddings)")
def vector_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), X.vector_literal(F.col("embedding")).alias("literal"))


@query("SELECT count(*) AS topics_discovered, count(*) FILTER (WHERE kids = 0 AND found > 0) AS leaf_topics, (SELECT count(DISTINCT o_custkey) FROM orders) AS articles_discovered, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS articles_downloaded FROM (SELECT n_nationkey, n_regionkey % 2 AS kids, n_nationkey % 3 AS found FROM nation)")
def crawl_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = read(spark, sf_dir, "nation").select((F.col("n_regionkey") % 2).alias("child_count"), (F.col("n_nationkey") % 3).alias("article_count"))
    return run.crawl_stats(topics, read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderstatus") == "F").alias("downloaded")))


# --- telemetry -------------------------------------------------------------------------------


@query("""
WITH d AS (SELECT ts::DATE AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1),
c AS (SELECT *, (n - lag(n) OVER (ORDER BY day)) / lag(n) OVER (ORDER BY day) AS change FROM d)
SELECT day::VARCHAR AS day, n, errors, round(p95, 6) AS p95, round(change, 6) AS change, errors / n > 0.05 AS too_many_errors, p95 > 10 AS too_slow, coalesce(abs(change) > 0.2, false) AS index_jump FROM c
""")
def pipeline_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = telemetry.daily_health(read(spark, sf_dir, "events"), F.col("event_type") == "error", F.col("value"))
    return out.withColumns({"day": F.col("day").cast("string"), "p95": F.round("p95", 6), "change": F.round("change", 6)})


@query("SELECT event_type, user_id, events, place FROM (SELECT event_type, user_id, count(*) AS events, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id)::INT AS place FROM events GROUP BY event_type, user_id) WHERE place <= 5")
def usage_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.usage(read(spark, sf_dir, "events"), "event_type", 5)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def telemetry_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.windows(read(spark, sf_dir, "events"))


@query("""
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, session
""")
def telemetry_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.sessions(read(spark, sf_dir, "events"))


@query("SELECT ts::DATE::VARCHAR AS day, count(*) AS n, count(*) FILTER (WHERE value < 5) AS low, avg((value < 5)::INT) AS share FROM events GROUP BY 1")
def low_confidence_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.low_confidence(read(spark, sf_dir, "events"), F.col("value"), 5).withColumn("day", F.col("day").cast("string"))


@query("SELECT o_orderstatus AS status, count(*) AS n, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM orders) AS percent FROM orders GROUP BY 1")
def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.progress(read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")))


@query("""
SELECT date_trunc('week', ts)::DATE::VARCHAR AS week, event_type, count(*) AS n, true AS median_within, true AS p95_within FROM events WHERE value IS NOT NULL AND isfinite(value) GROUP BY ALL
""")
def sketched_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks merged from stored daily sketches, and whether their quantiles' true ranks are within a fiftieth of what was asked."""
    e = read(spark, sf_dir, "events")
    days = materialize(telemetry.daily_sketches(e, F.col("value"), ("event_type",)), "daily-sketches")
    weeks = telemetry.merged_sketches(days, F.date_trunc("week", "day").cast("date"), ("event_type",)).withColumns({"p50": telemetry.sketch_quantile(F.col("sketch"), 0.5), "p95": telemetry.sketch_quantile(F.col("sketch"), 0.95)})
    weeks = weeks.select(F.col("period").alias("week"), "event_type", "n", "p50", "p95")
    values = e.select(F.to_date(F.date_trunc("week", "ts")).alias("week"), "event_type", "value").join(weeks, ["week", "event_type"])
    # equal values span ranks, any of which will do
    within = lambda q, share: (F.count_if(F.col("value") < F.col(q)) / F.first("n") <= share + 0.02) & (F.count_if(F.col("value") <= F.col(q)) / F.first("n") >= share - 0.02)
    return values.groupBy(F.col("week").cast("string").alias("week"), "event_type").agg(F.first("n").alias("n"), within("p50", 0.5).alias("median_within"), within("p95", 0.95).alias("p95_within"))
