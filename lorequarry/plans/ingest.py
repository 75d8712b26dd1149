"""Ingestion: files to chunks, contexts, vectors and stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import html_ops as H
from ..functions import text as X
from ..operators import chunking, maintenance, models
from ..sources import files


def ingest(spark: SparkSession, html: str | None = None, markdown: str | None = None, sidecars: list[str] | None = None, count: Callable[[str], int] = H.quarter, limits: H.Limits = H.Limits()) -> DataFrame:
    """Chunks of article and Markdown files, with their sidecars' title where there are any."""
    made = None
    for path, is_markdown in ((html, False), (markdown, True)):
        if path:
            part = chunking.chunk_articles(files.read_texts(spark, path), count, limits, is_markdown)
            made = part if made is None else made.unionByName(part)
    if made is None:
        raise ValueError("nothing to ingest")
    if sidecars:
        return files.with_sidecars(made, files.read_sidecars(spark, sidecars).select("source_id", "title", "source_url", "acl", "source_type", "content_category", "last_modified", F.col("source_authority_tier").alias("authority_tier")))
    return made.withColumn("title", F.lit(None).cast("string"))


def contextualize(chunks: DataFrame, known: DataFrame | None = None, make: Callable[[], models.Contextualizer] | None = None) -> DataFrame:
    """Chunks with a context: the known one, else a contextualizer's, or the offline one's without it; a failed call leaves it empty, with its error."""
    if make:
        if known is None:
            return models.contextualized(chunks, make)
        chunks = files.prefer_context(chunks, known)
        own = models.contextualized(chunks.filter("context = ''"), make)
        return chunks.filter("context <> ''").withColumn("context_error", F.lit(None).cast("string")).unionByName(own)
    own = models.context_column(F.col("title"), F.col("heading_path"))
    if known is None:
        return chunks.withColumn("context", own)
    chunks = files.prefer_context(chunks, known)
    return chunks.withColumn("context", F.when(F.col("context") == "", own).otherwise(F.col("context")))


def keyed(chunks: DataFrame) -> DataFrame:
    """Chunks that have a place, with the keys of their document and their own."""
    placed = chunks.filter("chunk_index is not null")
    return placed.withColumns({"document_id": schemas.document_key(F.col("source_id")), "id": schemas.chunk_key(F.col("source_id"), F.col("chunk_index"))})


def chunk_rows(rows: DataFrame, make: Callable[[], models.Embedder] = models.HashEmbedder) -> DataFrame:
    """Rows of the chunk table, with their vectors, of keyed chunks."""
    text = X.embed_text(F.col("content"), F.col("oversized"), F.col("title"), F.col("heading_path"), F.col("context"))
    embedded = models.embed(rows.withColumn("embed_text", text), "embed_text", make)
    return embedded.select("id", "document_id", "chunk_index", "content", "embed_text", "embedding", "heading_path", "chunk_type", "token_count", F.to_json(F.struct("oversized")).alias("metadata"))


def document_meta(chunks: DataFrame) -> DataFrame:
    """(source_id, and what chunks say of their document)."""
    meta = [c for c in ("title", "source_url", "acl", "source_type", "content_category", "last_modified", "authority_tier") if c in chunks.columns]
    return chunks.groupBy("source_id").agg(*[F.first(c).alias(c) for c in meta])


def stored_tables(chunks: DataFrame, make: Callable[[], models.Embedder] = models.HashEmbedder) -> tuple[DataFrame, DataFrame]:
    """Document and chunk tables of contextualized chunks, ready to be appended."""
    placed = keyed(chunks)
    docs = chunking.ordered_text(placed, ["source_id"], "chunk_index", "content").join(document_meta(placed), "source_id")
    return schemas.with_defaults(docs).withColumn("id", schemas.document_key(F.col("source_id"))), chunk_rows(placed, make)


def store_new(chunks: DataFrame, stored_documents: DataFrame | None, documents_path: str, chunks_path: str, stored_chunks: DataFrame | None = None) -> None:
    """Appends documents not stored yet, chunks before documents, so that a listed document is whole; with stored_chunks a run after a crash adds no chunk twice."""
    docs, rows = stored_tables(chunks)
    if stored_documents is not None:
        docs = maintenance.not_yet(docs, stored_documents, ["source_id"])
        rows = rows.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    if stored_chunks is not None:
        rows = maintenance.not_yet(rows, stored_chunks, ["id"])
    rows.write.mode("append").parquet(chunks_path)
    docs.write.mode("append").parquet(documents_path)


def store_batch(chunks: DataFrame, documents_path: str, chunks_path: str, batch: str) -> None:
    """Stores a batch's documents and chunks under its name, chunks first; storing the batch again replaces it, so a rerun after a crash repeats nothing."""
    docs, rows = stored_tables(chunks)
    files.write_batch(rows, chunks_path, batch)
    files.write_batch(docs, documents_path, batch)


def numbered_tokens(chunks: DataFrame) -> DataFrame:
    """(source_id, token) of the distinct sources; of those with an equal token the later ones end in `__` and their number, which no plain token holds."""
    once = chunks.select("source_id").filter("source_id is not null").distinct().withColumn("token", X.request_token(F.col("source_id")))
    once = once.withColumn("place", F.row_number().over(Window.partitionBy("token").orderBy("source_id")))
    suffix = F.concat(F.lit("__"), F.col("place").cast("string"))
    numbered = F.concat(F.left("token", F.lit(50) - F.length(suffix)), suffix)
    return once.select("source_id", F.when(F.col("place") == 1, F.col("token")).otherwise(numbered).alias("token"))


def submit(chunks: DataFrame, prompt: Column, limit_docs: int | None = None) -> DataFrame:
    """(request_id, source_id, chunk_index, prompt, status): a batch's requests for contexts, pending; of the first limit_docs sources where that is set."""
    tokens = numbered_tokens(chunks)
    if limit_docs is not None:
        tokens = tokens.join(tokens.select("source_id").orderBy("source_id").limit(limit_docs), "source_id", "left_semi")
    asked = chunks.join(tokens, "source_id")
    return asked.select(X.request_id(F.col("token"), F.col("chunk_index")).alias("request_id"), "source_id", "chunk_index", prompt.alias("prompt"), F.lit("pending").alias("status"))


def poll(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """requests with their status by the responses (request_id, context, error) that have come."""
    came = responses.select("request_id", "error").withColumn("came", F.lit(True))
    status = F.when(F.col("came").isNull(), F.col("status")).when(F.col("error").isNotNull(), "failed").otherwise("done")
    return requests.join(came, "request_id", "left").withColumn("status", status).drop("came", "error")


def collect_contexts(chunks: DataFrame, requests: DataFrame, responses: DataFrame) -> DataFrame:
    """chunks with the contexts that came; the others keep theirs, if any."""
    got = requests.join(responses.filter("error is null").select("request_id", F.col("context").alias("_context")), "request_id").select("source_id", "chunk_index", "_context")
    old = F.col("context") if "context" in chunks.columns else F.lit(None).cast("string")
    return chunks.join(got, ["source_id", "chunk_index"], "left").withColumn("context", F.coalesce("_context", old)).drop("_context")
