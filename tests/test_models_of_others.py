"""Models that others plug in: generators, judges and contextualizers, and what their failures leave."""

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from lorequarry.operators import models
from lorequarry.plans import evaluate, ingest, run

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this module

GOLDEN = "id int, query string, answer string, source_article_id string, source_article_id_alt array<string>, query_type string"


class Echo:
    """A generator that fails on one question."""

    def answer(self, query, contexts):
        if "broken" in query:
            raise TimeoutError("no answer from the model")
        return models.Answer(f"{len(contexts)} contexts for {query}", 100 + len(contexts), 7)


class Strict:
    metrics = ("faithfulness", "relevancy")

    def measure(self, metric, query, answer, expected, context):
        if metric == "relevancy" and "pay" in query:
            raise ValueError("unreadable verdict")
        return (0.9 if expected and expected in context else 0.2), f"{metric} of {answer[:1]}"


class Place:
    def context(self, title, heading_path, content):
        if content == "bad":
            raise RuntimeError("overloaded")
        return f"{title} / {' > '.join(heading_path)}"


def corpus(spark):
    rows = [(f"s{i}", k, f"housing pay rate {i} {k}", ["h"], "text", 5, False, f"t{i}") for i in range(4) for k in range(2)]
    chunks = spark.createDataFrame(rows, "source_id string, chunk_index int, content string, heading_path array<string>, chunk_type string, token_count int, oversized boolean, title string")
    docs, stored = ingest.stored_tables(ingest.contextualize(chunks))
    return docs.withColumns({"source_url": F.lit("u"), "content_category": F.lit("c")}), stored


def test_an_evaluation_by_other_models(spark):
    docs, stored = corpus(spark)
    golden = spark.createDataFrame([(1, "housing rate", "housing pay rate 1 0", "s1", None, "x"), (2, "broken housing", "a", "s2", None, "x"), (3, "pay rate", "nowhere", "s3", None, "y"), (4, " ", "a", None, None, "y")], GOLDEN)
    records = run.evaluation(golden, stored, docs, k=3, generator=Echo)
    rows = {r.id: r for r in records.collect()}
    assert rows[1].answer == "3 contexts for housing rate" and (rows[1].input_tokens, rows[1].output_tokens, rows[1].error) == (103, 7, None)
    assert rows[2].answer is None and rows[2].error == "TimeoutError: no answer from the model" and rows[2].retrieved_ids
    assert rows[4].error == "invalid query" and rows[4].answer is None
    scores = {r.id: r.scores for r in run.judged(records, Strict).collect()}
    assert set(scores) == {1, 3}
    assert scores[1]["relevancy"].error is None and scores[1]["faithfulness"].reason == "faithfulness of 3"
    assert scores[3]["relevancy"].error == "ValueError: unreadable verdict" and scores[3]["relevancy"].score is None and scores[3]["faithfulness"].success is False
    summary = {r.metric: r.n for r in evaluate.score_summary(run.judged(records, Strict)).collect()}
    assert summary == {"faithfulness": 2, "relevancy": 1}


def test_contexts_by_another_model(spark):
    chunks = spark.createDataFrame([("a", 0, "x", "T", ["h", "k"]), ("a", 1, "bad", None, None), ("b", 0, "y", "U", ["z"])], "source_id string, chunk_index int, content string, title string, heading_path array<string>")
    rows = {(r.source_id, r.chunk_index): (r.context, r.context_error) for r in ingest.contextualize(chunks, make=Place).collect()}
    assert rows == {("a", 0): ("T / h > k", None), ("a", 1): ("", "RuntimeError: overloaded"), ("b", 0): ("U / z", None)}
    known = spark.createDataFrame([("b", 0, "known already"), ("a", 0, "")], "source_id string, chunk_index int, context string")
    rows = {(r.source_id, r.chunk_index): r.context for r in ingest.contextualize(chunks, known, Place).collect()}
    assert rows == {("a", 0): "T / h > k", ("a", 1): "", ("b", 0): "known already"}
