"""A document's scores for all queries are summed in one task: rows of a query and a document are never shuffled."""

import re

import pytest

from lorequarry.operators import lexical


@pytest.mark.parametrize("few", [True, False])
def test_scores_stay_with_their_document(spark, monkeypatch, few):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, None), (4, "red blue red den")], "id long, text string")
    asked = spark.createDataFrame([(7, "red fox"), (8, "den")], "query_id long, text string")
    if few:
        plan = lexical.bm25(asked, docs, 2)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(id" in plan and not re.search(r"hashpartitioning\(query_id#\d+L?, id#", plan)
    else:
        monkeypatch.setattr(lexical, "BROADCAST_TERMS", 0)
    got = [(r.query_id, r.id, r["rank"]) for r in lexical.bm25(asked, docs, 2).orderBy("query_id", "rank").collect()]
    assert got == [(7, 1, 1), (7, 2, 2), (8, 4, 1)] or got == [(7, 1, 1), (7, 4, 2), (8, 4, 1)]
