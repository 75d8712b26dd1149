"""Requests as a stream with late, failed, repeated and missing responses; batches within their limits."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from lorequarry.streaming import requests

EVENTS = "request_id string, ts timestamp, what string, context string, error string"
T0 = datetime(2026, 1, 1)


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_life_cycle(spark, tmp_path, rocksdb):
    """One file a trigger; a minute's timeout, three attempts."""

    def at(seconds):
        return T0 + timedelta(seconds=seconds)

    files = [
        [("ok", at(0), "submit", None, None), ("bad", at(0), "submit", None, None), ("gone", at(0), "submit", None, None), ("twice", at(1), "submit", None, None), (None, at(1), "submit", None, None)],
        [("ok", at(10), "response", "context of ok", None), ("bad", at(10), "response", None, "overloaded"), ("twice", at(10), "response", None, "overloaded"), ("nobody", at(11), "response", "x", None)],
        [("ok", at(20), "response", "again", None), ("bad", at(20), "response", None, "overloaded"), ("twice", at(21), "submit", None, None), ("twice", at(22), "response", "second try", None)],
        [("bad", at(30), "response", None, "broken"), ("tick", at(65), "submit", None, None)],
        [("tick", at(66), "response", "t", None), ("tock", at(130), "submit", None, None)],
        [("tock", at(131), "response", "t", None), ("end", at(400), "submit", None, None)],
        [("end", at(401), "response", "e", None), ("gone", at(402), "response", "too late", None)],
    ]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        query = requests.life_cycle(stream, 60).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(120)
    seen = defaultdict(list)
    for r in spark.read.parquet(f"{tmp_path}/out").orderBy("ts", "attempt").collect():
        seen[r.request_id].append((r.status, r.attempt, (r.ts - T0).total_seconds(), r.context, r.error))
    assert seen["ok"] == [("pending", 1, 0, None, None), ("collected", 1, 10, "context of ok", None), ("ignored", 0, 20, "again", None)]
    assert seen["bad"] == [("pending", 1, 0, None, None), ("retry", 2, 10, None, "overloaded"), ("retry", 3, 20, None, "overloaded"), ("failed", 3, 30, None, "broken")]
    assert seen["twice"] == [("pending", 1, 1, None, None), ("retry", 2, 10, None, "overloaded"), ("collected", 2, 22, "second try", None)]
    assert seen["gone"] == [("pending", 1, 0, None, None), ("retry", 2, 60, None, "no response"), ("retry", 3, 120, None, "no response"), ("expired", 3, 180, None, "no response"), ("ignored", 0, 402, "too late", None)]
    assert [s[0] for s in seen["tock"]] == ["pending", "collected"] and seen["nobody"][0][0] == "ignored"


@pytest.mark.parametrize(("max_requests", "max_bytes"), [(7, 10**9), (10**9, 300), (20, 500)])
def test_batches_keep_their_limits(spark, monkeypatch, max_requests, max_bytes):
    monkeypatch.setattr(requests, "BUCKET_REQUESTS", 40)
    rng = random.Random(1)
    rows = [(f"r{i}", "é" * rng.randint(0, 60), 1) for i in range(300)] + [("same", "body", 1)] * 5 + [("none", None, 1)]
    df = spark.createDataFrame(rows, "request_id string, prompt string, batch int").drop("batch")
    out = requests.request_batches(df, "request_id", "prompt", max_requests, max_bytes).collect()
    assert sorted((r.request_id, r.prompt or "") for r in out) == sorted((a, b or "") for a, b, _ in rows)
    batches = defaultdict(list)
    for r in out:
        batches[r.batch].append(len(r.request_id) + 2 * len((r.prompt or "").replace("body", "")) + 4 * (r.prompt == "body"))
    assert all(len(b) <= max_requests and sum(b) <= max_bytes for b in batches.values())
    assert len(batches) <= 2 + len(rows) / max_requests + sum(map(sum, batches.values())) / (max_bytes - 124)
    again = requests.request_batches(df, "request_id", "prompt", max_requests, max_bytes).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_a_request_over_the_limit_is_an_error(spark):
    df = spark.createDataFrame([("r", "x" * 100)], "request_id string, prompt string")
    with pytest.raises(ValueError, match="at most 50"):
        requests.request_batches(df, "request_id", "prompt", max_bytes=50)
    assert requests.request_batches(df.limit(0), "request_id", "prompt").count() == 0
