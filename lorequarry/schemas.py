"""Schemas of the stored tables, defaults, and checks of their constraints."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = (
    "id long, source_id string, title string, source_type string, source_url string, acl string, authority_tier int,"
    " content_category string, raw_content string, last_modified timestamp, metadata string, created_at timestamp"
)
CHUNKS = (
    "id long, document_id long, chunk_index int, content string, embed_text string, embedding array<float>,"
    " heading_path array<string>, chunk_type string, token_count int, metadata string, created_at timestamp"
)
CHUNK_RECORD = (
    "source_id string, chunk_index int, content string, heading_path array<string>, chunk_type string, token_count int, oversized boolean, context string"
)
SIDECAR = (
    "article_id string, alternate_id string, source_type string, source_system string, source_url string, topic_breadcrumb array<string>, topic_id string,"
    " manual_name string, title string, description string, last_modified string, created string, version string, state string, contains_table boolean,"
    " contains_list boolean, heading_outline array<struct<level:int,text:string>>, heading_count int, content_category string, target_audience string,"
    " process_change string, attachments array<struct<name:string,url:string>>, acl string, source_authority_tier int"
)
GOLDEN = (
    "queries array<struct<id:int,query:string,answer:string,source_article_id:string,source_article_id_alt:array<string>,query_type:string,answer_in_table:boolean,tags:array<string>>>"
)
EVAL_RECORD = (
    "id int, query string, expected_answer string, expected_source_ids array<string>, query_type string, answer_in_table boolean, tags array<string>,"
    " retrieved_ids array<string>, context_strings array<string>, answer string, input_tokens long, output_tokens long, top1_source_match boolean, topk_source_match boolean, error string"
)

SIDECAR_NAMES = tuple(re.findall(r"(\w+) (?:string|boolean|int|array)", SIDECAR))

# What a document has where its sidecar says nothing.
DEFAULTS = {"source_type": "va_manual", "acl": "public", "authority_tier": 1}


def document_key(source_id: Column) -> Column:
    """A document's id: stable across runs and machines."""
    return F.xxhash64(source_id)


def chunk_key(source_id: Column, chunk_index: Column) -> Column:
    return F.xxhash64(source_id, chunk_index)


def with_defaults(sidecars: DataFrame) -> DataFrame:
    """Document columns of sidecars with their defaults filled in."""
    have = set(sidecars.columns)
    get = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    out = {c: F.coalesce(get(c), F.lit(v)) for c, v in DEFAULTS.items()}
    out["last_modified"] = F.coalesce(get("last_modified"), get("modified_date")).try_cast("timestamp")
    return sidecars.withColumns(out)


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, violations): nulls in columns that must have none."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*columns))).alias("column_name", "violations"))


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("copies")).filter("copies > 1")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is missing."""
    return children.join(parents.select(key), key, "left_anti")


def create_tables(spark: SparkSession, location: str, buckets: int = 64) -> dict[str, str]:
    """Tables over the folders documents and chunks of a location, in sorted buckets by document, and their names, which the location gives.

    Tables over one location are the same table; what is written through them has its buckets in its file names, so a
    location holds only what came through its tables, always with the same number of buckets.
    """
    location = location.rstrip("/")
    names = {}
    for kind, columns, key in (("documents", DOCUMENTS, "id"), ("chunks", CHUNKS, "document_id")):
        names[kind] = f"{kind}_{zlib.crc32(location.encode()):08x}"
        order = key if kind == "documents" else f"{key}, chunk_index"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {names[kind]} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({order}) INTO {int(buckets)} BUCKETS LOCATION '{location}/{kind}'")
    return names
