"""Streaming forms of the telemetry rollups and of ingestion; extensions beyond the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

LATE = "10 minutes"


def read_events(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 16) -> DataFrame:
    """Events of new files, ts as an instant (watermarks need one)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def rollup(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Counts and sums by event-time window and type, late events up to a limit."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def session_rollup(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def without_repeats(events: DataFrame, late: str = LATE) -> DataFrame:
    """Each event id once within the time that late events may take."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


class Drift(StatefulProcessor):
    """Running count and mean of a value per key, with its change since the batch before."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("moments", "n long, mean double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        n, mean = self.state.get() if self.state.exists() else (0, 0.0)
        before = mean
        for batch in rows:
            values = batch["value"].dropna()
            if len(values):
                mean = (n * mean + float(values.sum())) / (n + len(values))
                n += len(values)
        self.state.update((n, mean))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "mean": [mean], "change": [mean - before]})

    def close(self) -> None:
        pass


def drift(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").transformWithStateInPandas(Drift(), "event_type string, n long, mean double, change double", "Update", "None")


def ingest_files(spark: SparkSession, path: str, handle: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Hands new text files under path to handle as (source_id, content), each once."""
    from ..sources.files import source_id

    rows = spark.readStream.text(path, wholetext=True).select(source_id(F.col("_metadata.file_path")).alias("source_id"), F.col("value").alias("content"))
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: handle(df)).trigger(availableNow=True).start()
