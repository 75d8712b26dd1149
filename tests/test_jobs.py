"""The jobs: growing input, crashes, odd rows, the gate, and equality with SQL over whole tables."""

import json
import subprocess
import sys

import duckdb
import pytest

from jobs import evaluate_golden, ingest_documents, settings
from jobs.queries import ORACLE_SQL, QUERIES

ROOT = ingest_documents.__file__.rsplit("/", 2)[0]
SCHEMA = "doc_id long, text string, lang string, source string, batch string"


def land(spark, folder, name, rows):
    """One more file in the input folder; a column has a name that the job uses too."""
    spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def take(spark, tmp, **config):
    return ingest_documents.run(spark, f"{tmp}/in/*", f"{tmp}/out", f"{tmp}/checkpoint", config)


def texts(store):
    rows = ingest_documents.current(store).orderBy("id", "chunk_index").collect()
    return {i: [r.content for r in rows if r.id == i] for i in {r.id for r in rows}}


def log(spark, tmp):
    return {r.batch: r.asDict() for r in spark.read.json(f"{tmp}/out/log").collect()}


def test_only_what_is_new_is_taken(spark, tmp_path):
    land(spark, f"{tmp_path}/in", "a", [(1, "one\n\ntwo", "en", "s"), (2, "first " * 60 + "\nsecond", "de", None)])
    assert texts(take(spark, tmp_path)) == {1: ["one\ntwo"], 2: [("first " * 60).strip(), "second"]}
    land(spark, f"{tmp_path}/in", "b", [(1, "one\n\ntwo", "en", "s"), (2, "now other", "de", None), (3, "new", None, "s")])
    store = take(spark, tmp_path)
    assert texts(store) == {1: ["one\ntwo"], 2: ["now other"], 3: ["new"]}
    figures = log(spark, tmp_path)
    assert (figures[0]["read"], figures[0]["added"]) == (2, 2)
    assert (figures[1]["read"], figures[1]["added"], figures[1]["changed"], figures[1]["unchanged_or_superseded"]) == (3, 1, 1, 1)
    before = sorted(store.rows("chunks").inputFiles())
    assert sorted(take(spark, tmp_path).rows("chunks").inputFiles()) == before  # a run without news writes nothing
    assert sorted(log(spark, tmp_path)) == [0, 1]


def test_one_file_a_batch_gives_the_same_chunks(spark, tmp_path):
    for i in range(3):
        land(spark, f"{tmp_path}/in", f"f{i}", [(d, f"version {i} of {d}", "en", "s") for d in range(i, 5)])
    store = take(spark, tmp_path, files_per_batch=1)
    assert store.rows("documents").select("batch").distinct().count() == 3
    assert texts(store) == {d: [f"version {min(d, 2)} of {d}"] for d in range(5)}


def test_a_batch_that_crashed_is_done_again(spark, tmp_path, monkeypatch):
    """The writer dies after the chunks: readers see the state before, and the next run repairs it."""
    land(spark, f"{tmp_path}/in", "a", [(1, "old", "en", "s")])
    take(spark, tmp_path)
    land(spark, f"{tmp_path}/in", "b", [(1, "new", "en", "s"), (2, "more", "en", "s"), (None, "lost", "en", "s")])
    real = settings.overwrite

    def dies(rows, path, by):
        if path.endswith("documents"):
            raise RuntimeError("killed")
        real(rows, path, by)

    monkeypatch.setattr(settings, "overwrite", dies)
    with pytest.raises(Exception, match="killed"):
        take(spark, tmp_path)
    store = ingest_documents.Store(spark, f"{tmp_path}/out", spark.read.parquet(f"{tmp_path}/in/*").schema, settings.config("ingest_documents"))
    assert texts(store) == {1: ["old"]}
    monkeypatch.setattr(settings, "overwrite", real)
    store = take(spark, tmp_path)
    assert texts(store) == {1: ["new"], 2: ["more"]}
    assert store.rows("chunks").filter("batch = 1").count() == 2
    assert spark.read.parquet(f"{tmp_path}/out/rejected").count() == 1


def test_odd_rows(spark, tmp_path):
    long = "\n".join(f"paragraph {i} " + "word " * 60 for i in range(3000))
    rows = [
        (None, "no id", "en", "s"), (1, None, "en", "s"), (2, "", "en", "s"), (3, " \n  \n", "en", "s"), (4, "\tpassword=hunter22 me@site.org\r", "", "s"), (5, "same", "en", "s"),
        (5, "same", "en", "s"), (5, "same", "de", "s"), (6, "short", "en", "s"), (6, "the longer version", "en", "s"), (7, long, None, None), (7, long, None, None),
    ]
    land(spark, f"{tmp_path}/in", "a", rows)
    store = take(spark, tmp_path)
    got = texts(store)
    assert set(got) == {4, 5, 6, 7} and len(got[7]) == 3000 and got[6] == ["the longer version"] and got[5] == ["same"]
    assert "hunter22" not in got[4][0] and "[email]" in got[4][0]
    assert {r.id: r.had_secret for r in store.rows("documents").collect()} == {4: True, 5: False, 6: False, 7: False}
    reasons = sorted((str(r.id), r.reason) for r in spark.read.parquet(f"{tmp_path}/out/rejected").collect())
    assert reasons == [("1", "no text"), ("2", "no text"), ("3", "no text"), ("None", "no id")]
    assert spark.read.parquet(f"{tmp_path}/out/documents").filter("id = 5").first().lang == "de"  # the least of equal texts' rows
    land(spark, f"{tmp_path}/empty", "a", [])
    assert ingest_documents.current(ingest_documents.run(spark, f"{tmp_path}/empty/*", f"{tmp_path}/o2", f"{tmp_path}/c2")).count() == 0


def evaluate(spark, tmp, name, baseline=None, **config):
    return evaluate_golden.run(spark, f"{tmp}/q", f"{tmp}/d", f"{tmp}/out", name, baseline, {"sentence_chars": 10, **config})


def golden(spark, tmp, found=True):
    docs = [(1, "The tuition rate is 1200 dollars a month. See the handbook."), (2, "Housing allowances depend on the location of the school."), (3, None), (4, ""), (None, "lost words here")]
    asked = [(10, "The tuition rate is 1200 dollars a month."), (11, "Housing allowances depend on the location of the school!" if found else "zzz qqq"), (12, "Unrelated question about xylophones."), (13, None), (None, "nobody")]
    spark.createDataFrame(docs, "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp}/d")
    spark.createDataFrame(asked, "item_id long, text string").write.mode("overwrite").parquet(f"{tmp}/q")


def test_evaluation_and_its_gate(spark, tmp_path):
    golden(spark, tmp_path)
    assert evaluate(spark, tmp_path, "base") == []
    rows = {r.query_id: r for r in spark.read.parquet(f"{tmp_path}/out/records").collect()}
    assert set(rows) == {10, 11, 12, 13}
    assert rows[10].answerable and rows[10].top1_source_match and rows[10].keyword_recall == 1.0 and rows[10].retrieved[0].id == 1
    assert not rows[12].answerable and rows[13].retrieved is None and rows[13].keyword_recall is None
    figures = {(r.segment, r.metric): r.value for r in spark.read.parquet(f"{tmp_path}/out/metrics").collect()}
    assert figures["all", "n"] == 4 and figures["all", "top1_source_match_rate"] == 0.5 and figures["answerable short", "top1_source_match_rate"] == 1.0

    assert evaluate(spark, tmp_path, "next", "base") == []
    golden(spark, tmp_path, found=False)
    shut = evaluate(spark, tmp_path, "worse", "base")
    assert [m.split(":")[0] for m in shut] == ["answer_keyword_recall_mean", "top1_source_match_rate", "topk_source_match_rate"]
    assert evaluate(spark, tmp_path, "worse", "base") == shut  # a repeated run replaces its rows
    assert spark.read.parquet(f"{tmp_path}/out/records").groupBy("run").count().collect() and spark.read.parquet(f"{tmp_path}/out/records").filter("run = 'worse'").count() == 4
    assert spark.read.parquet(f"{tmp_path}/out/gate").filter("run = 'next' and failed").count() == 0


def test_settings_are_put_back(spark):
    spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    before = spark.conf.get("spark.sql.files.maxRecordsPerFile", None)
    with pytest.raises(KeyError), settings.settings(spark, spark__sql__files__maxRecordsPerFile="7"):
        assert spark.conf.get("spark.sql.files.maxRecordsPerFile") == "7"
        raise KeyError
    assert spark.conf.get("spark.sql.files.maxRecordsPerFile", None) == before


def test_command_lines(spark, tmp_path):
    land(spark, f"{tmp_path}/in", "a", [(1, "some text here", "en", "s")])
    golden(spark, tmp_path)
    (tmp_path / "own.json").write_text(json.dumps({"k": 1}))
    jobs = [
        ["ingest_documents.py", f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/checkpoint"],
        ["evaluate_golden.py", f"{tmp_path}/q", f"{tmp_path}/d", f"{tmp_path}/eval", "--run", "one", "--config", f"{tmp_path}/own.json"],
    ]
    for job in jobs:
        done = subprocess.run([sys.executable, f"{ROOT}/jobs/{job[0]}", *job[1:]], capture_output=True, text=True, timeout=300, check=False)
        assert done.returncode == 0, done.stderr[-2000:]
        assert "reading" in done.stderr
    assert spark.read.parquet(f"{tmp_path}/out/chunks").count() == 1
    assert spark.read.parquet(f"{tmp_path}/eval/records").filter("size(retrieved) > 1").count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda rows: sorted(str(tuple(round(x, 5) if isinstance(x, float) else x for x in r)) for r in rows)
    assert plain(got.select(want.columns).collect()) == plain(want.fetchall())
