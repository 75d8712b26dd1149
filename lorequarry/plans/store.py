"""The stored tables as bucketed tables: documents by id, their chunks by document_id, in the same number of buckets.

Rows are written through the tables, so that files carry their buckets and joins of the two need no
shuffle. Adding is safe to repeat: chunks and documents that are stored already aren't added again, and chunks come
first, so that after a crash between the two a repeated run adds just what is missing. Readers see the chunks
of stored documents only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import chunking, maintenance, models
from ..storage import discard, materialize
from . import ingest

#: Up to so many document keys go to every task.
BROADCAST_IDS = 500_000


class ChunkStore:
    """Documents and chunks under a location; opening it again, in any session, finds what is stored."""

    def __init__(self, spark: SparkSession, location: str, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.names = schemas.create_tables(spark, location, buckets)

    def documents(self) -> DataFrame:
        return self.spark.table(self.names["documents"])

    def chunks(self) -> DataFrame:
        """The chunks of stored documents."""
        return self.all_chunks().join(self.documents().select(self.documents()["id"].alias("document_id")), "document_id", "left_semi")

    def all_chunks(self) -> DataFrame:
        return self.spark.table(self.names["chunks"])

    def joined(self) -> DataFrame:
        """Every chunk beside its document's source_id, title and raw_content: a join within buckets."""
        docs = self.documents().selectExpr("id AS document_id", "source_id", "title", "raw_content")
        return self.all_chunks().join(docs.hint("merge"), "document_id")

    def add(self, chunks: DataFrame, make: Callable[[], models.Embedder] = models.HashEmbedder) -> None:
        """Stores the contextualized chunks of documents that aren't stored yet.

        Only keys are compared. The texts of what is new are dealt to their buckets once; vectors are made there, in the
        order of the files, and documents are put together from their stored chunks, within buckets.
        """
        rows = ingest.keyed(chunks)
        new = materialize(rows.select("document_id").distinct().join(self.documents().select(F.col("id").alias("document_id")), "document_id", "left_anti"), "new-documents")
        n = new.count()
        if n:
            wanted = F.broadcast(new) if n <= BROADCAST_IDS else new
            rows = rows.join(wanted, "document_id", "left_semi")
            # what a run that died has left: chunks without their document
            known = self.documents().select(F.col("id").alias("document_id"))
            left = materialize(self.all_chunks().select("document_id", "id").join(known, "document_id", "left_anti"), "left-chunks")
            missing = rows if left.isEmpty() else maintenance.not_yet(rows, left, ["document_id", "id"])
            self.append("chunks", "document_id", ingest.chunk_rows(self.dealt(missing, "document_id", "chunk_index"), make))
            texts = self.all_chunks().join(wanted, "document_id", "left_semi").groupBy("document_id").agg(chunking.joined("chunk_index", "content").alias("raw_content"))
            docs = ingest.document_meta(rows).withColumn("document_id", schemas.document_key(F.col("source_id"))).join(texts, "document_id")
            self.append("documents", "id", self.dealt(schemas.with_defaults(docs).withColumnRenamed("document_id", "id"), "id"))
            discard(left)
        discard(new)

    def dealt(self, rows: DataFrame, key: str, *order: str) -> DataFrame:
        """Rows in their buckets, in the order of the tables' files, so that writing needs no sort of its own."""
        return rows.repartition(self.buckets, key).sortWithinPartitions(F.pmod(F.hash(key), F.lit(self.buckets)), key, *order)

    def append(self, name: str, key: str, rows: DataFrame) -> None:
        """Appends dealt rows to a table, null where they lack a column; a task writes one bucket."""
        table = self.spark.table(self.names[name])
        have = set(rows.columns)
        rows.selectExpr(*(c if c in have else f"CAST(NULL AS {t}) AS {c}" for c, t in table.dtypes)).write.insertInto(self.names[name])

    def drop(self) -> None:
        """Forgets the tables; their files stay."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
