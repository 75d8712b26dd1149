"""The jobs as registered queries over whole tables, each run twice into a new folder, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import evaluate_golden, ingest_documents
from lorequarry import queries as library
from lorequarry.storage import shared_dir


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of every document's latest version after a second run, which finds nothing new."""
    out = folder(spark, "job1")
    for _ in range(2):
        store = ingest_documents.run(spark, f"{sf_dir}/documents.parquet", f"{out}/store", f"{out}/checkpoint")
    rows = ingest_documents.current(store).withColumnRenamed("id", "doc_id")
    return rows.select("doc_id", "source", "lang", "content_hash", "change", "had_secret", "chunk_index", "content", "token_count", "chunk_type")


def job2_evaluate_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a run that was repeated."""
    out = folder(spark, "job2")
    for _ in range(2):
        evaluate_golden.run(spark, f"{sf_dir}/benchmark.parquet", f"{sf_dir}/documents.parquet", out, "whole")
    rows = spark.read.parquet(f"{out}/records").filter("run = 'whole'")
    ids = F.transform("retrieved", lambda r: r["id"])
    return rows.select(F.col("query_id").alias("item_id"), "answerable", "length", ids.alias("retrieved_ids"), "top1_source_match", "topk_source_match", "keyword_recall", "best_score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "job1_ingest_documents": job1_ingest_documents,
    "job2_evaluate_golden": job2_evaluate_golden,
}

EMAIL_SQL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
URL_SQL = r"https?://(?:localhost|[A-Za-z0-9.-]+\.(?:internal|local|corp))(?:[:/]\S*)?"
SENTENCES_SQL = r"list_distinct(list_filter(list_transform(string_split_regex(lower(coalesce(text, '')), '[.!?\n]+'), lambda s: trim(s)), lambda s: length(s) >= 40))"

ORACLE_SQL: dict[str, str] = {
    "job1_ingest_documents": rf"""
WITH RECURSIVE versions AS (
    SELECT doc_id, source, lang, text, sha256(text) AS content_hash FROM documents WHERE doc_id IS NOT NULL AND len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) > 0
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, sha256(text) DESC, source, lang) = 1
), p AS (
    SELECT doc_id, source, lang, content_hash, regexp_matches(text, '{library.SECRET_SQL}') AS had_secret, list_filter(list_transform(string_split(
        regexp_replace(regexp_replace(regexp_replace(text, '{library.SECRET_SQL}', '[secret]', 'g'), '{EMAIL_SQL}', '[email]', 'g'), '{URL_SQL}', '[url]', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps
    FROM versions
), fold AS (SELECT doc_id, ps, 0 AS i, []::VARCHAR[] AS done, '' AS carry FROM p
    UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN ceil(length(j) / 4) < 50 THEN done ELSE list_append(done, j) END, CASE WHEN ceil(length(j) / 4) < 50 THEN j ELSE '' END
    FROM (SELECT *, CASE WHEN carry = '' THEN ps[i + 1] ELSE carry || chr(10) || ps[i + 1] END AS j FROM fold WHERE i < len(ps))
), merged AS (SELECT doc_id, CASE WHEN carry = '' THEN done ELSE list_append(done, carry) END AS cs FROM fold WHERE i = len(ps)
), chunks AS (SELECT doc_id, (unnest(range(1, len(cs) + 1)) - 1)::INT AS chunk_index, unnest(cs) AS content FROM merged)
SELECT doc_id, source, nullif(lang, '') AS lang, content_hash, 'added' AS change, had_secret, chunk_index, content, ceil(length(content) / 4)::INT AS token_count,
    CASE WHEN contains(lower(content), '<table') THEN 'table'
        WHEN (contains(lower(content), '<ul') OR contains(lower(content), '<ol')) AND len(regexp_extract_all(lower(content), '<li')) / greatest(len(string_split(content, chr(10))), 1) > 0.3 THEN 'list' ELSE 'text' END AS chunk_type
FROM chunks JOIN p USING (doc_id)
""",
    "job2_evaluate_golden": rf"""
WITH q AS (SELECT item_id, {SENTENCES_SQL} AS ss, list_distinct(list_filter(list_transform(regexp_extract_all({library.ASCII.format("text")}, '\$[\d,]+|\d+%|[A-Z]{{2,}}-?\d*|[A-Z][a-z]{{3,}}|\b[a-z]{{6,}}\b|\b\d{{3,}}\b'), lambda t: lower(t)), lambda t: t NOT IN ({library.STOP}))) AS terms FROM benchmark
), d AS (SELECT doc_id, lower(coalesce(text, '')) AS low, {SENTENCES_SQL} AS ss FROM documents
), answers AS (SELECT DISTINCT item_id FROM (SELECT item_id, unnest(ss) AS s FROM q) WHERE s IN (SELECT unnest(ss) FROM d)
), hits AS ({library.BM25_SQL.format(k=10)}
), given AS (
    SELECT query_id AS item_id, rank, id, score, list_has_any(q.ss, d.ss) AS source, list_filter(terms, lambda t: contains(low, t)) AS found
    FROM hits JOIN q ON q.item_id = query_id JOIN d ON d.doc_id = id
), per AS (
    SELECT item_id, list(id ORDER BY rank) AS retrieved_ids, bool_or(source AND rank = 1) AS top1, bool_or(source) AS topk, max(score) AS best, len(list_distinct(flatten(list(found)))) AS found FROM given GROUP BY item_id
)
SELECT q.item_id, a.item_id IS NOT NULL AS answerable, CASE WHEN len(terms) > 20 THEN 'long' ELSE 'short' END AS length, retrieved_ids,
    coalesce(top1, false) AS top1_source_match, coalesce(topk, false) AS topk_source_match, round(CASE WHEN len(terms) > 0 THEN coalesce(found, 0) / len(terms) END, 6) AS keyword_recall, coalesce(best, 0.0::DOUBLE) AS best_score
FROM q LEFT JOIN per USING (item_id) LEFT JOIN answers a USING (item_id)
""",
}
