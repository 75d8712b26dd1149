"""The evaluation and the search take every benchmark row with its whole text."""

import shutil

import pytest

from lorequarry import queries


@pytest.fixture(scope="module")
def long_dir(spark, sf_dir, tmp_path_factory):
    """The small corpus with benchmark texts beyond the earlier cuts and one beyond the request check."""
    top = tmp_path_factory.mktemp("whole")
    shutil.copy(f"{sf_dir}/documents.parquet", top / "documents.parquet")
    rows = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    text = rows[0][1]
    rows += [(901, (text + " ") * (700 // len(text) + 1)), (902, (text + " ") * (2100 // len(text) + 1))]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(str(top / "benchmark.parquet"))
    return str(top), dict(rows)


def test_evaluation(spark, long_dir, monkeypatch):
    monkeypatch.setattr(queries.evaluate, "proxies", lambda records: records)
    path, texts = long_dir
    records = {r.id: r for r in queries.evaluation_run(spark, path).select("id", "query", "error").collect()}
    assert {i: r.query for i, r in records.items()} == texts
    assert {i for i, r in records.items() if r.error == "invalid query"} == {902}


def test_search(spark, long_dir, monkeypatch):
    asked = []
    whole = queries.search.search
    monkeypatch.setattr(queries.search, "search", lambda requests, *a, **b: asked.append(requests) or whole(requests, *a, **b))
    path, texts = long_dir
    found = {r.query_id for r in queries.search_batch(spark, path).select("query_id").collect()}
    assert {r.query_id: r.query for r in asked[0].collect()} == texts
    assert found == set(texts) - {902}
