"""Job 1: takes new documents into a knowledge base, batch by batch.

The input folder is a file stream: a run takes the files that its checkpoint doesn't know yet
(availableNow) and ends. Every batch is checked, compared with what is stored, redacted, cut into chunks, and
written under its number:

    chunks/batch=N/...     chunk_index, content, token_count and chunk_type of new and changed documents
    documents/batch=N/...  one row a document of the batch: its text's hash, whether it is added or changed, its sizes
    rejected/batch=N       rows without id or text, with the reason
    log/batch=N            what the batch read and wrote

A batch that is run again after a crash has the same files and the same number, so it replaces what it wrote
and repeats nothing. `current` gives the chunks of each document's latest version; a batch's chunks count
only once its documents are written, which happens last. An empty text for a stored document is rejected, it
doesn't delete.

Of rows with the same id in a batch the longest text stays, then the greatest; the others count as superseded.

    spark-submit jobs/ingest_documents.py INPUT OUTPUT CHECKPOINT [--config FILE]
"""

from __future__ import annotations

import argparse
import logging
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Column, DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType  # noqa: E402

from jobs import settings as S  # noqa: E402
from lorequarry.functions import text as X  # noqa: E402
from lorequarry.operators import chunking, maintenance  # noqa: E402

log = logging.getLogger("jobs.ingest_documents")


class Store:
    """The output folder of one run: schemas, and how a batch is stored."""

    def __init__(self, spark: SparkSession, output: str, read: StructType, config: dict):
        self.spark, self.output, self.config = spark, output.rstrip("/"), config
        self.id, self.text = config["id_column"], config["text_column"]
        self.kept = [c for c in config["kept_columns"] if c in read.names]
        self.by = ["batch", *(c for c in config["partition_by"] if c in self.kept)]
        key = [StructField("id", read[self.id].dataType), *(StructField(c, read[c].dataType) for c in self.kept)]
        self.documents = StructType([*key, *map(field, ("content_hash", "change", "had_secret", "n_chunks", "n_tokens", "batch"))])
        self.chunks = StructType([*key, *map(field, ("content_hash", "change", "had_secret", "chunk_index", "content", "token_count", "chunk_type", "batch"))])

    def path(self, name: str) -> str:
        return f"{self.output}/{name}"

    def rows(self, name: str) -> DataFrame:
        """The stored documents or chunks of all batches. An empty value of a partition column reads as null."""
        return S.stored(self.spark, self.path(name), self.documents if name == "documents" else self.chunks)

    def take(self, batch: DataFrame, number: int) -> None:
        """Stores one batch of the stream; doing it again gives the same."""
        text = F.col(self.text)
        some = F.exists(F.split(text, "\n"), lambda line: F.trim(line) != "")
        reason = F.when(F.col(self.id).isNull(), "no id").when(~F.coalesce(some, F.lit(False)), "no text")
        came = batch.select(F.col(self.id).alias("id"), *self.kept, text.alias("_text"), reason.alias("reason"))

        # one row an id: sizes and hashes are compared before any text is moved
        usable = came.filter("reason is null").drop("reason").withColumns({"content_hash": F.sha2("_text", 256), "_size": F.char_length("_text")})
        wins = usable.groupBy("id").agg(F.max(F.struct("_size", "content_hash")).alias("_best")).select("id", F.col("_best.content_hash").alias("content_hash"))
        before = self.rows("documents").filter(F.col("batch") < number).groupBy("id").agg(F.max_by("content_hash", "batch").alias("_stored"))
        news = wins.join(before, "id", "left").filter("_stored is null or _stored <> content_hash")
        news = news.select("id", "content_hash", F.when(F.col("_stored").isNull(), "added").otherwise("changed").alias("change"))
        same = ["id", "content_hash"]
        once = usable.groupBy(*same).agg(F.min(F.struct(*self.kept, "_text")).alias("_row"))  # repeats go before they are shuffled
        docs = once.join(news, same).select(*same, "change", "_row.*").withColumn("batch", F.lit(number).cast("long"))

        S.overwrite(self.chunks_of(docs).select(*self.chunks.names), self.path("chunks"), self.by)
        mine = self.rows("chunks").filter(F.col("batch") == number)
        per = mine.groupBy("id", *self.kept, "content_hash", "change", "had_secret", "batch").agg(F.count("*").alias("n_chunks"), F.sum("token_count").alias("n_tokens"))
        S.overwrite(came.filter("reason is not null").select("id", *self.kept, "reason", F.lit(number).cast("long").alias("batch")), self.path("rejected"), ["batch"])
        S.overwrite(per.select(*self.documents.names), self.path("documents"), self.by)

        wrote = self.rows("documents").filter(F.col("batch") == number)
        count = wrote.agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "changed").alias("changed"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
        rejected = S.stored(self.spark, self.path("rejected"), "id string, batch long").filter(F.col("batch") == number)
        figures = {"batch": number, "read": batch.count(), "rejected": rejected.select("batch").count()} | count.first().asDict()  # one row
        figures["unchanged_or_superseded"] = figures["read"] - figures["rejected"] - figures["added"] - figures["changed"]
        line = self.spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in figures.items()])
        line.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(self.path("log"))
        log.info("batch %s", ", ".join(f"{k} {v}" for k, v in figures.items()))

    def chunks_of(self, docs: DataFrame) -> DataFrame:
        """The chunks of documents: paragraphs, small ones put before the next, secrets and addresses masked."""
        secret = maintenance.has_secret(F.col("_text"))
        clean: Column = maintenance.redact(F.col("_text")) if self.config["redact"] else F.col("_text")
        parts = F.filter(F.transform(F.split("_clean", "\n"), lambda x: F.trim(x)), lambda x: x != "")
        docs = docs.withColumns({"had_secret": secret, "_clean": clean})
        merged = chunking.merge_small(parts, X.count_tokens, self.config["small_tokens"])
        rows = docs.select("id", *self.kept, "content_hash", "change", "had_secret", "batch", F.posexplode(merged).alias("chunk_index", "content"))
        return rows.withColumns({"token_count": X.count_tokens(F.col("content")), "chunk_type": X.chunk_type(F.col("content"))})


#: Types of the columns that the job adds.
ADDED = {"chunk_index": IntegerType(), "token_count": IntegerType(), "n_chunks": LongType(), "n_tokens": LongType(), "batch": LongType(), "had_secret": BooleanType()}


def field(name: str) -> StructField:
    return StructField(name, ADDED.get(name, StringType()))


def watched(path: str) -> str:
    """The path as a pattern that matches it alone: a file stream takes a single file only by a pattern."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict | None = None) -> Store:
    """Takes in what is new under source, waits for it, and returns the store."""
    config = S.config("ingest_documents") | (config or {})
    read = spark.read.parquet(source).schema
    store = Store(spark, output, read, config)
    stream = spark.readStream.schema(read)
    if config["files_per_batch"]:
        stream = stream.option("maxFilesPerTrigger", config["files_per_batch"])
    log.info("reading %s", source)
    query = stream.parquet(watched(source)).writeStream.foreachBatch(store.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    log.info("stored under %s", output)
    return store


def current(store: Store) -> DataFrame:
    """The chunks of the latest version of every document."""
    latest = store.rows("documents").groupBy("id").agg(F.max("batch").alias("batch"))
    return store.rows("chunks").join(latest, ["id", "batch"])


def main(arguments: list[str]) -> None:
    parser = argparse.ArgumentParser(description="Takes new documents into a knowledge base.")
    for name in ("input", "output", "checkpoint"):
        parser.add_argument(name)
    parser.add_argument("--config")
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s: %(message)s")
    spark = SparkSession.builder.appName("ingest documents").getOrCreate()
    try:
        run(spark, given.input, given.output, given.checkpoint, S.config("ingest_documents", given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
