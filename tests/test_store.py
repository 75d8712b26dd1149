"""The bucketed store: repeated and interrupted runs, other sessions, plans without a shuffle; many terms at once; readers without other tests."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lorequarry.operators import enrich
from lorequarry.plans import evaluate
from lorequarry.plans.store import ChunkStore
from lorequarry.sources import files

CHUNKS = "source_id string, chunk_index int, content string, title string, token_count int, chunk_type string, heading_path array<string>, oversized boolean, context string"


def chunks(spark, ids, per=3):
    return spark.createDataFrame([(f"d{i}", k, f"text {k} of {i}", f"title {i}", 4, "text", ["h"], False, "") for i in ids for k in range(per)], CHUNKS)


@pytest.fixture
def store(spark, tmp_path):
    made = ChunkStore(spark, f"{tmp_path}/store", buckets=4)
    yield made
    made.drop()


def test_adding_again_adds_nothing(spark, store, tmp_path):
    store.add(chunks(spark, range(10)))
    store.add(chunks(spark, range(5, 15)))
    assert (store.documents().count(), store.chunks().count()) == (15, 45)
    row = store.documents().filter("source_id = 'd3'").first()
    assert row.raw_content == "text 0 of 3\n\ntext 1 of 3\n\ntext 2 of 3" and row.acl == "public" and row.authority_tier == 1
    assert spark.read.parquet(f"{tmp_path}/store/chunks").count() == 45  # the folder is a plain table too


def test_a_run_after_a_crash_completes(spark, store, monkeypatch):
    """The writer dies between chunks and documents: readers see neither, and the next run adds each once."""
    real = ChunkStore.append

    def dies(self, name, key, rows):
        if name == "documents":
            raise RuntimeError("killed")
        real(self, name, key, rows)

    monkeypatch.setattr(ChunkStore, "append", dies)
    with pytest.raises(RuntimeError, match="killed"):
        store.add(chunks(spark, range(6)))
    assert store.chunks().count() == 0 and store.all_chunks().count() == 18
    monkeypatch.setattr(ChunkStore, "append", real)
    store.add(chunks(spark, range(8)))
    assert (store.documents().count(), store.all_chunks().count(), store.chunks().count()) == (8, 24, 24)


def test_joins_by_document_need_no_shuffle(spark, store, tmp_path):
    store.add(chunks(spark, range(20)))
    other = spark.newSession()
    again = ChunkStore(other, f"{tmp_path}/store", buckets=4)
    summed = again.joined().groupBy("document_id").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))
    plan = summed._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[1] and "SortMergeJoin" in plan
    assert sorted((r.n, r.tokens) for r in summed.collect()) == [(3, 12)] * 20


def test_many_terms_meet_texts_in_parts(spark, monkeypatch):
    """Ten terms an automaton and two automata a pass find what a search for each term finds."""
    monkeypatch.setattr(evaluate, "VOCABULARY", 10)
    monkeypatch.setattr(evaluate, "AUTOMATA", 2)
    rng = random.Random(2)
    texts = [(f"s{i}", "".join(rng.choices("abcd ", k=rng.randint(0, 60)))) for i in range(80)] + [("none", None)]
    terms = sorted({"".join(rng.choices("abcd", k=rng.randint(1, 5))) for _ in range(120)})
    vocabulary = spark.createDataFrame([(t,) for t in [*terms, *terms[:5], "", None]], "term string")
    found = evaluate.containment(spark.createDataFrame(texts, "source_id string, low string"), "source_id", "low", vocabulary)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == sorted((s, t) for s, text in texts for t in terms if t in (text or ""))


def test_json_arrays_and_what_is_downloaded(spark, tmp_path):
    path = tmp_path / "chunks.json"
    path.write_text(json.dumps([{"source_id": "a", "chunk_index": 0, "content": "x"}, {"source_id": "b", "chunk_index": 1, "content": None}]))
    rows = files.read_json_array(spark, str(path), "source_id string, chunk_index int, content string").collect()
    assert sorted(map(tuple, rows)) == [("a", 0, "x"), ("b", 1, None)]
    manifest = spark.createDataFrame([("1", True), ("2", False), ("3", True)], "id string, downloaded boolean")
    there = spark.createDataFrame([("1",), ("2",)], "source_id string")
    assert [r.id for r in files.landed(manifest, there).collect()] == ["1"]


def test_counts_of_categories_and_headings(spark):
    metas = spark.createDataFrame([("p", 3), ("p", 0), (None, 2)], "content_category string, heading_count int")
    assert {r.content_category: r.n for r in enrich.category_counts(metas).collect()} == {"p": 2, None: 1}
    assert enrich.heading_stats(metas).first().asDict() == {"articles": 3, "with_headings": 2, "mean_headings": 2.5}


def test_vectors_are_made_in_their_buckets(spark, store, monkeypatch):
    """Nothing is shuffled or sorted once chunks have vectors, and where no document is new nothing is written."""
    real, plans = ChunkStore.append, {}

    def watched(self, name, key, rows):
        plans.setdefault(name, []).append(rows._jdf.queryExecution().executedPlan().toString())
        real(self, name, key, rows)

    monkeypatch.setattr(ChunkStore, "append", watched)
    store.add(chunks(spark, range(10)))
    store.add(chunks(spark, range(10)))
    assert {name: len(p) for name, p in plans.items()} == {"chunks": 1, "documents": 1}
    above = plans["chunks"][0].split("ArrowEvalPython")[0]
    assert "Exchange" not in above and "Join" not in above and "Sort" not in above
    assert store.chunks().count() == 30
