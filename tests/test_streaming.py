import pytest
from pyspark.sql import functions as F

from lorequarry.operators import telemetry
from lorequarry.streaming import telemetry as streaming


@pytest.fixture()
def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_rollup_equals_batch(spark, sf_dir, events):
    stream = streaming.read_events(spark, f"{sf_dir}/events*.parquet", events.schema)
    got = run(streaming.rollup(stream), "rollup", "complete")
    batch = telemetry.windows(events)
    key = lambda r: (r.window_start, r.event_type, r.n, round(r.total, 3))
    assert sorted(map(key, got.collect()), key=str) == sorted(map(key, batch.collect()), key=str)


def test_repeats_drop_out(spark, sf_dir, events, tmp_path):
    events.unionByName(events).write.parquet(str(tmp_path / "in"))
    got = run(streaming.without_repeats(streaming.read_events(spark, str(tmp_path / "in"), events.schema)), "once", "append")
    assert got.count() == events.count()


def test_session_rollup(spark, sf_dir, events):
    got = run(streaming.session_rollup(streaming.read_events(spark, f"{sf_dir}/events*.parquet", events.schema)), "sessions", "complete")
    assert got.agg(F.sum("n")).first()[0] == events.count() and got.count() == telemetry.sessions(events).count()


def test_drift(spark, sf_dir, events):
    stream = streaming.read_events(spark, f"{sf_dir}/events*.parquet", events.schema)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = {r.event_type: (r.n, round(r["mean"], 6)) for r in run(streaming.drift(stream), "drift", "update").collect()}
    want = {r.event_type: (r.n, round(r.m, 6)) for r in events.groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("m")).collect()}
    assert got == want


def test_files_are_handed_over_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.html").write_text(f"<p>{name}</p>\n<p>more</p>")
        streaming.ingest_files(spark, str(tmp_path / "in"), lambda df: seen.extend(r.source_id for r in df.collect()), str(tmp_path / "state")).awaitTermination(60)
    assert seen == ["a", "b"]
