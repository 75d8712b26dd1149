"""The corpus pipeline: quality filter, line dedup, near-dedup, mixing and packing of `documents`.

Every stage takes documents (doc_id, text, lang, source, n_chars; other columns are left out) and
all but the last return such. Null values in any column and empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorequarry.llm import line_dedup, mixing, packing, quality, simhash
from lorequarry.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_length(docs: DataFrame) -> DataFrame:
    """docs with n_chars as the text's length, where there is a text."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, unchanged."""
    model = quality.learn_from_split(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).filter("predicted = 1").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand, up to one edit, at an earlier place; those that lose every line go."""
    found = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return with_length(found.filter("n_dropped < n_lines or n_dropped = 0"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (sets of five-word shingles at similarity 0.8 or more): the one with the smallest doc_id.

    Rows without doc_id can't be named as the one that stays, so they all do.
    """
    docs = docs.select(*COLUMNS)
    keep = simhash.near_duplicates_at(docs.filter("doc_id is not null")).filter("doc_id = component_id").select("doc_id").distinct()
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "source", "lang"))
    one = docs.join(keep, "doc_id", "left_semi").withColumn("_row", first).filter("_row = 1")
    return one.select(*COLUMNS).unionByName(docs.filter("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture draws, once for each time, in the order of its shards."""
    docs = docs.select(*COLUMNS)
    return with_length(mixing.mixed_documents(docs, mixing.mix(docs)))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of a document in the bins."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("best-fit packing", pack_documents),
]

#: SQL can express neither the learned classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
