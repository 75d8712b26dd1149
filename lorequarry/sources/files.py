"""Files in and out: articles, sidecars, chunk arrays, golden sets, evaluation artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas


def source_id(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, content) of whole text files, HTML or Markdown; path may be a pattern."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(source_id(F.col("_metadata.file_path")).alias("source_id"), F.col("value").alias("content"))


def read_sidecars(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_id, columns of a sidecar): of files of equal name the one from the first path."""
    found = None
    for priority, path in enumerate(paths):
        one = spark.read.schema(schemas.SIDECAR).option("multiLine", True).json(path)
        one = one.select(source_id(F.col("_metadata.file_path")).alias("source_id"), F.lit(priority).alias("_priority"), *schemas.SIDECAR_NAMES)
        found = one if found is None else found.unionByName(one)
    first = F.row_number().over(Window.partitionBy("source_id").orderBy("_priority"))
    return found.withColumn("_row", first).filter("_row = 1").drop("_row", "_priority")


def with_sidecars(docs: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Documents with their sidecar's columns; those without one keep nulls."""
    return docs.join(sidecars, "source_id", "left")


def read_json_array(spark: SparkSession, path: str, schema: str = schemas.CHUNK_RECORD) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an artifact that is either an array or an object with the array in `results`."""
    rows = spark.read.option("multiLine", True).json(path)
    return rows.select(F.explode("results").alias("r")).select("r.*") if "results" in rows.columns else rows


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.GOLDEN).option("multiLine", True).json(path)
    return rows.select(F.explode("queries").alias("q")).select("q.*")


def prefer_context(chunks: DataFrame, contexts: DataFrame) -> DataFrame:
    """Chunks with their context, empty where there is none."""
    return chunks.drop("context").join(contexts.select("source_id", "chunk_index", "context"), ["source_id", "chunk_index"], "left").fillna("", ["context"])


def landed(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest entries marked as downloaded whose file is there."""
    return manifest.filter("downloaded").join(files.select(F.col("source_id").alias("id")), "id", "left_semi")


# --- writers ---------------------------------------------------------------------------------


def article_html(name: Column, meta: dict[str, Column], breadcrumb: Column, content: Column) -> Column:
    """A whole HTML page of an article: title, meta tags, breadcrumb, and a heading unless the content begins with one."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    tags = F.concat_ws("\n", *[F.concat(F.lit(f'<meta name="{k}" content="'), esc(v), F.lit('">')) for k, v in meta.items()])
    crumbs = F.array_join(F.transform(breadcrumb, esc), " &gt; ")
    head = F.when(F.lower(F.ltrim(content)).startswith("<h1"), F.lit("")).otherwise(F.concat(F.lit("<h1>"), esc(name), F.lit("</h1>\n")))
    return F.concat(F.lit('<!DOCTYPE html>\n<html>\n<head>\n<meta charset="utf-8">\n<title>'), esc(name), F.lit("</title>\n"), tags, F.lit('\n</head>\n<body>\n<nav class="breadcrumb">'), crumbs, F.lit("</nav>\n"), head, content, F.lit("\n</body>\n</html>\n"))


def write_version(df: DataFrame, path: str, version: str, partition_by: list[str] | None = None) -> str:
    """Writes df as a new version beside earlier ones; readers move on by its name, so nothing that is read is overwritten."""
    target = f"{path.rstrip('/')}/version={version}"
    df.write.partitionBy(*(partition_by or [])).parquet(target)
    return target


def write_artifact(summary: DataFrame, results: DataFrame, path: str) -> None:
    """A run's summary and rows as two tables."""
    summary.write.json(f"{path.rstrip('/')}/summary")
    results.write.json(f"{path.rstrip('/')}/results")


def insert_new(df: DataFrame, existing: DataFrame, key: str, path: str) -> None:
    """Appends the rows whose key isn't stored yet; the job commits them together."""
    df.join(existing.select(key), key, "left_anti").write.mode("append").parquet(path)


def write_batch(df: DataFrame, path: str, batch: str) -> None:
    """Writes df as the batch's own part of a table; writing it again replaces that part only."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def write_json(df: DataFrame, path: str, version: str) -> str:
    """Writes df as JSON, an object a line, as a new version beside earlier ones."""
    target = f"{path.rstrip('/')}/version={version}"
    df.write.json(target)
    return target
