"""What the jobs share: config files, settings that are put back, and how a table is read if it is there."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))


def config(name: str, path: str | None = None) -> dict:
    """The settings of a job: those of the file beside it, with those of another file on top."""
    found = {}
    for file in (os.path.join(HERE, f"{name}.json"), path):
        if file:
            with open(file, encoding="utf-8") as f:
                found |= json.load(f)
    return found


@contextmanager
def settings(spark: SparkSession, **changed: str) -> Iterator[None]:
    """Spark settings (dots as two underscores) that hold inside the block and are put back after it."""
    names = {k.replace("__", "."): v for k, v in changed.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table of a known schema, without rows if nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def overwrite(rows: DataFrame, path: str, by: list[str]) -> None:
    """Writes rows in place of the partitions that they have rows in."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
