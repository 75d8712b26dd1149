"""Title links dealt out by blocks of ids: shares of tasks, blocks of any size, and odd keys and titles against the SQL."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lorequarry.operators import maintenance

NAMES = [("red bolt", "Brand#1"), ("bolt RED", "brand 1"), ("red ring", "Brand#1"), ("old ring", "Brand#2"), ("bolt", "Brand#1"), (None, "Brand#1"), ("red bolt", None), ("", ""), ("?!", "-"), ("red red bolt", "Brand#1")]


def linked(rows):
    words = {i: frozenset(t.split()) for i, t in rows}
    return Counter((a, b) for a in words for b in words if a < b and len(words[a] & words[b]) >= 0.6 * len(words[a] | words[b]))


@pytest.mark.parametrize("ids", [1, 7, 128])
def test_blocks_of_any_size(spark, monkeypatch, ids):
    monkeypatch.setattr(maintenance, "BLOCK_IDS", ids, raising=False)
    rows = [(i, ["a b c d", "d c b a", "a b c e", "x y", "a b c"][i % 5]) for i in range(100)]
    found = maintenance.title_links(spark.createDataFrame(rows, "id long, title string"), "id", "title", 0.6).collect()
    assert Counter((r.a, r.b) for r in found) == linked(rows)


def test_pairs_are_made_by_several_tasks(spark, monkeypatch):
    """Few titles, each of many documents: their links are few rows, and one task's, but the pairs are many."""
    monkeypatch.setattr(maintenance, "BLOCK_IDS", 16, raising=False)
    rows = [(i, ["a b c d", "a b c e", "a b c f"][i % 3]) for i in range(600)]
    found = maintenance.title_links(spark.createDataFrame(rows, "id long, title string"), "id", "title", 0.6)
    shares = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 600 * 599 // 2 and len(shares) > 1 and max(shares) < 0.6 * sum(shares)


def test_odd_keys_and_titles_as_in_sql(spark, tmp_path):
    rows = [(i, *NAMES[i % len(NAMES)]) for i in range(40)] + [(3, "red bolt", "Brand#1"), (3, "old gear", "Brand#9"), (4, "old gear", "Brand#9"), (None, "red bolt", "Brand#1"), (None, "old gear", "Brand#9")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["title_similarity_links"]).fetchall()
    found = __spark_entry__.queries()["title_similarity_links"](spark, str(tmp_path)).collect()
    assert Counter(map(tuple, found)) == Counter(want) and want
