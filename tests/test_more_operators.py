"""Counters, overlaps, drift, batches of requests, stores that can be rerun."""

import math
import os

import pytest
from pyspark.sql import functions as F

from lorequarry.operators import lexical, maintenance, models, telemetry, vector
from lorequarry.plans import evaluate, ingest
from lorequarry.sources import files


def test_audit_counts_and_source_f1(spark):
    docs = spark.createDataFrame([("1", "The Muskogee office pays $45,000 for Housing."), ("2", "Muskogee and Housing at $45,000 too")], "source_id string, content string")
    golden = spark.createDataFrame([(1, "Which Muskogee office handles Payroll?", "Muskogee $45,000 Housing", ["1", "9"]), (2, "x", "", []), (3, "x", None, None)], "id int, query string, answer string, expected_source_ids array<string>")
    assert evaluate.audit_counts(evaluate.audit(golden, docs)).first().asDict() == {"n": 3, "no_source_id": 2, "missing_source": 1, "subject_missing": 1, "has_alternates": 1}
    rows = spark.createDataFrame([(1, ["a", "b"], ["b", "c", "c", "d"]), (2, [], []), (3, None, ["a"])], "id int, e array<string>, g array<string>")
    assert [(r.precision, r.recall, r.f1) for r in evaluate.source_f1(rows, "e", "g").orderBy("id").collect()] == [(0.333333, 0.5, 0.4), (None, None, None), (0.0, None, 0.0)]


def test_failures_by_metrics(spark):
    rows = [(i, m, not (i % 2 == 0 or m == "b" and i % 3 == 0)) for i in range(12) for m in ("a", "b")]
    out = {r.failed: (r.n, r.examples) for r in evaluate.failure_clusters(spark.createDataFrame(rows, "id int, metric string, success boolean")).collect()}
    assert out == {"a, b": (6, [0, 2, 4]), "b": (2, [3, 9])}


def test_coverage_and_probes(spark):
    a, b = spark.createDataFrame([("1",), ("2",), ("2",), ("x",)], "id string"), spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    assert telemetry.index_coverage(a, b, "id").first().asDict() == {"expected": 3, "stored": 2, "missing": 1, "unexpected": 1}
    old = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0])], "id int, embedding array<double>")
    new = spark.createDataFrame([(1, [3.0, 0.0]), (2, [2.0, 0.0]), (4, [1.0, 1.0])], "id int, embedding array<double>")
    assert vector.probe_drift(old, new, "id").first().asDict() == {"n": 2, "mean": 0.5, "least": 0.0, "moved": 1}


def plain_bleu(c, r, max_n=4):
    c, r, logs = c.split(), r.split(), []
    for n in range(1, max_n + 1):
        grams = lambda w: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]  # noqa: E731, B023
        have, want = grams(c), grams(r)
        hits = sum(min(have.count(g), want.count(g)) for g in set(have))
        if not hits:
            return 0.0
        logs.append(math.log(hits / len(have)))
    return round((1 if len(c) >= len(r) else math.exp(1 - len(r) / len(c))) * math.exp(sum(logs) / max_n), 6)


def test_bleu(spark):
    pairs = [("the cat sat on the mat today", "the cat sat on the red mat"), ("a b c d e", "a b c d e"), ("a b c d", "a b c d e f g h"), ("x y", "a b"), ("", "a"), ("the the the the the", "the cat the cat the")]
    out = lexical.bleu(spark.createDataFrame([(i, c, r) for i, (c, r) in enumerate(pairs)], "pair_id int, candidate string, reference string")).orderBy("pair_id").collect()
    assert [r.bleu for r in out] == [plain_bleu(c, r) for c, r in pairs]


def test_results_without_near_repeats(spark):
    rows = [(1, 1, "one two three four five"), (1, 2, "five four three two one"), (1, 3, "one two three four six"), (1, 4, "other words"), (2, 1, None), (2, 2, ""), (2, 3, "one two three four five")]
    hits = spark.createDataFrame(rows, "query_id int, rank int, content string")
    assert sorted((r.query_id, r["rank"]) for r in maintenance.dissimilar_results(hits, "content").collect()) == [(1, 1), (1, 3), (1, 4), (2, 1), (2, 3)]
    assert sorted((r.query_id, r["rank"]) for r in maintenance.dissimilar_results(hits, "content", 0.6).collect()) == [(1, 1), (1, 4), (2, 1), (2, 3)]


def test_request_batches(spark):
    sources = ["a b", "a_b", "a-b!", "c", "x" * 60, "x" * 61]
    chunks = spark.createDataFrame([(s, i, f"text {i}") for s in sources for i in range(2)], "source_id string, chunk_index int, content string")
    requests = ingest.submit(chunks, F.concat(F.lit("Place this: "), "content"))
    ids = {(r.source_id, r.chunk_index): r.request_id for r in requests.collect()}
    assert len(set(ids.values())) == len(ids) == 12 and all(len(i) <= 64 for i in ids.values())
    assert {ids[s, 1] for s in ("a b", "a-b!", "a_b")} == {"a_b__1", "a_b__2__1", "a_b__3__1"}
    assert ingest.submit(chunks, F.col("content"), limit_docs=2).select("source_id").distinct().count() == 2
    came = spark.createDataFrame([(ids["c", 0], "a context", None), (ids["c", 1], None, "overloaded")], "request_id string, context string, error string")
    assert {r.status: r["count"] for r in ingest.poll(requests, came).groupBy("status").count().collect()} == {"pending": 10, "done": 1, "failed": 1}
    got = {(r.source_id, r.chunk_index): r.context for r in ingest.collect_contexts(chunks, requests, came).collect()}
    assert len(got) == 12 and got["c", 0] == "a context" and got["c", 1] is None


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    for rows in (df, df, df.filter("id = 1")):
        files.write_batch(rows, f"{tmp_path}/t", "one")
    files.write_batch(df, f"{tmp_path}/t", "two")
    assert sorted((r.batch, r.id) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [("one", 1), ("two", 1), ("two", 2)]
    assert spark.read.json(files.write_json(df, f"{tmp_path}/j", "1")).count() == 2


def test_a_query_is_scored_with_all_its_texts(spark):
    class Counting:
        def score(self, query, texts):
            return [len(texts) + len(t or "") / 100 for t in texts]

    rows = spark.createDataFrame([("a", "x"), ("b", "yy"), ("a", "zzz"), (None, None)], "q string, t string").coalesce(1)
    out = models.score_pairs(rows, "q", "t", Counting).collect()
    assert [(r.q, r.rerank_score) for r in out] == [("a", 2.01), ("b", 1.02), ("a", 2.03), (None, 1.0)]


VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_token_counts_by_a_vocabulary(spark):
    rows = spark.createDataFrame([("The quick brown fox",), ("",), (None,)], "t string")
    got = [r.n for r in rows.select(models.counted_by(F.col("t"), lambda: models.vocabulary_counter(VOCABULARY)).alias("n")).collect()]
    assert got[0] >= 4 and got[1:] == [0, 0]
