"""Job 2: evaluates lexical retrieval over a corpus on a golden set, under a run's name, and compares it with another run.

Every golden text is asked. A document counts as its source if they share a sentence of at least
`sentence_chars` characters (compared in lower case); a golden text that shares one with any document is answerable. Written
are, each partitioned by run, so that runs stand side by side:

    records/run=NAME   one row a golden text: retrieved documents with scores, source matches, share of its terms found
    metrics/run=NAME   (segment, metric, value) over all texts and by segment
    gate/run=NAME      the metrics of all texts against the baseline run's, with a verdict; only with a baseline

A run that is repeated replaces its partitions with the same rows. The command line ends with status 1 if
the gate is shut.

    spark-submit jobs/evaluate_golden.py QUESTIONS CORPUS OUTPUT --run NAME [--baseline NAME] [--config FILE]
"""

from __future__ import annotations

import argparse
import logging
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Column, DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from jobs import settings as S  # noqa: E402
from lorequarry.functions import text as X  # noqa: E402
from lorequarry.operators import lexical  # noqa: E402
from lorequarry.plans import evaluate  # noqa: E402

log = logging.getLogger("jobs.evaluate_golden")

METRICS = ("n", "top1_source_match_rate", "topk_source_match_rate", "answer_keyword_recall_mean", "low_confidence_rate")
METRICS_SCHEMA = "segment string, metric string, value double, run string"


def sentences(text: Column, least: int) -> Column:
    """The distinct sentences and lines of a text with at least so many characters, in lower case."""
    parts = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[.!?\n]+"), lambda s: F.trim(s))
    return F.array_distinct(F.filter(parts, lambda s: F.char_length(s) >= least))


def records(questions: DataFrame, corpus: DataFrame, config: dict) -> DataFrame:
    """One row a golden text of (query_id, text) over corpus (id, text); rows without id or with a repeated one are left out."""
    least = config["sentence_chars"]
    once = questions.filter("query_id is not null").groupBy("query_id").agg(F.min("text").alias("text"))
    asked = once.select("query_id", sentences(F.col("text"), least).alias("sentences"), X.distinctive_terms(F.col("text")).alias("terms"))
    texts = corpus.filter("id is not null").select("id", "text")

    # a sentence that many documents share counts once, before anything is joined by it
    known = texts.select(F.explode(sentences(F.col("text"), least)).alias("sentence")).distinct()
    answerable = asked.select("query_id", F.explode("sentences").alias("sentence")).join(known, "sentence", "left_semi").select("query_id").distinct()

    hits = lexical.bm25(once, texts, config["k"])
    seen = hits.join(asked, "query_id").join(texts, "id")
    # what a document gives is worked out beside its text, so that only small rows are gathered by question
    low = F.lower(F.coalesce("text", F.lit("")))
    given = seen.select(
        "query_id", "rank", "id", "score",
        F.arrays_overlap("sentences", sentences(F.col("text"), least)).alias("source"),
        F.filter("terms", lambda t: F.contains(low, t)).alias("found"),
    )
    per = given.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("retrieved"),
        F.bool_or(F.col("source") & (F.col("rank") == 1)).alias("top1"),
        F.bool_or("source").alias("topk"),
        F.max("score").alias("best_score"),
        F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"),
    )
    rows = asked.join(per, "query_id", "left").join(answerable.withColumn("answerable", F.lit(True)), "query_id", "left")
    no = F.lit(False)
    return rows.select(
        "query_id",
        F.coalesce("answerable", no).alias("answerable"),
        F.when(F.size("terms") > config["long_question_terms"], "long").otherwise("short").alias("length"),
        "retrieved",
        F.coalesce("top1", no).alias("top1_source_match"),
        F.coalesce("topk", no).alias("topk_source_match"),
        F.round(F.when(F.size("terms") > 0, F.coalesce(F.size("found"), F.lit(0)) / F.size("terms")), 6).alias("keyword_recall"),
        F.coalesce("best_score", F.lit(0.0)).alias("best_score"),
    )


def metrics(rows: DataFrame, config: dict) -> DataFrame:
    """(segment, metric, value) of records: over all, and by answerable and length."""
    share = lambda c: F.avg(c.cast("int"))
    figures = [
        F.count("*").cast("double").alias("n"),
        share(F.col("top1_source_match")).alias("top1_source_match_rate"),
        share(F.col("topk_source_match")).alias("topk_source_match_rate"),
        F.avg("keyword_recall").alias("answer_keyword_recall_mean"),
        share(F.col("best_score") < config["low_confidence"]).alias("low_confidence_rate"),
    ]
    name = F.when(F.grouping_id() == 0, F.concat_ws(" ", F.when(F.col("answerable"), "answerable").otherwise("unanswerable"), "length")).otherwise("all")
    grouped = rows.groupingSets([("answerable", "length"), ()], "answerable", "length").agg(name.alias("segment"), *figures)
    pairs = F.create_map(*[x for m in METRICS for x in (F.lit(m), F.round(m, 6))])
    return grouped.select("segment", F.explode(pairs).alias("metric", "value"))


def run(spark: SparkSession, questions: str, corpus: str, output: str, name: str, baseline: str | None = None, config: dict | None = None) -> list[str]:
    """Evaluates and writes; returns the messages of the gate, none if it is open or there is no baseline."""
    config = S.config("evaluate_golden") | (config or {})
    output = output.rstrip("/")
    asked = spark.read.parquet(questions).select(F.col(config["id_column"]).alias("query_id"), F.col(config["question_column"]).alias("text"))
    texts = spark.read.parquet(corpus).select(F.col(config["document_id_column"]).alias("id"), F.col(config["document_column"]).alias("text"))
    log.info("reading %s and %s", questions, corpus)
    made = records(asked, texts, config).withColumn("run", F.lit(name))
    S.overwrite(made, f"{output}/records", ["run"])
    rows = spark.read.schema(made.schema).parquet(f"{output}/records").filter(F.col("run") == name)
    S.overwrite(metrics(rows, config).withColumn("run", F.lit(name)), f"{output}/metrics", ["run"])
    overall = spark.read.schema(METRICS_SCHEMA).parquet(f"{output}/metrics").filter("segment = 'all'")
    for r in overall.filter(F.col("run") == name).collect():  # a row a metric
        log.info("%s: %s %s", name, r.metric, r.value)
    if baseline is None:
        return []
    tolerances = {m: (d, t) for m, (d, t) in config["tolerances"].items()}
    judged = evaluate.gate(overall.filter(F.col("run") == name), overall.filter(F.col("run") == baseline), tolerances)
    S.overwrite(judged.withColumns({"against": F.lit(baseline), "run": F.lit(name)}), f"{output}/gate", ["run"])
    shut = spark.read.parquet(f"{output}/gate").filter((F.col("run") == name) & F.col("failed")).orderBy("metric").collect()  # a row a metric
    messages = [f"{r.metric}: {r.current} against {r.baseline}" for r in shut]
    for m in messages:
        log.warning("gate: %s", m)
    return messages


def main(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(description="Evaluates retrieval on a golden set.")
    for given in ("questions", "corpus", "output"):
        parser.add_argument(given)
    parser.add_argument("--run", required=True)
    parser.add_argument("--baseline")
    parser.add_argument("--config")
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s: %(message)s")
    spark = SparkSession.builder.appName("evaluate golden set").getOrCreate()
    try:
        return 1 if run(spark, given.questions, given.corpus, given.output, given.run, given.baseline, S.config("evaluate_golden", given.config)) else 0
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
