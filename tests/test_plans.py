import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorequarry import schemas
from lorequarry.functions import text as X
from lorequarry.operators import enrich, hierarchy, maintenance, models, telemetry, vector
from lorequarry.plans import evaluate, ingest, run, search
from lorequarry.sources import files, portal


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    (root / "html").mkdir()
    (root / "md").mkdir()
    (root / "extra").mkdir()
    body = "The monthly housing allowance is paid at the end of each month. " * 20
    (root / "html" / "100.html").write_text(f"<html><body><h1>Housing</h1><h2>Rates</h2><p>{body}</p><table><tr><th>a</th></tr><tr><td>1</td></tr></table></body></html>")
    (root / "html" / "200.html").write_text("<html><body><h1>Tuition</h1><p>" + "Tuition and fees are paid to the school directly. " * 20 + "</p></body></html>")
    (root / "md" / "guide.md").write_text("# Guide\n\n## Books\n" + "Book stipends go to the student once a term. " * 20)
    (root / "html" / "100.json").write_text(json.dumps({"article_id": "100", "title": "Housing", "acl": "staff", "last_modified": "2017-06-19T20:08:59.000Z"}, indent=2))
    (root / "extra" / "100.json").write_text(json.dumps({"article_id": "100", "title": "Second"}))
    (root / "extra" / "guide.json").write_text(json.dumps({"title": "Guide", "source_url": "u"}))
    chunks = ingest.ingest(spark, f"{root}/html/*.html", f"{root}/md/*.md", [f"{root}/html/*.json", f"{root}/extra/*.json"])
    docs, stored = ingest.stored_tables(ingest.contextualize(chunks))
    return root, docs.cache(), stored.cache()


def test_ingestion(spark, corpus):
    root, docs, stored = corpus
    d = {r.source_id: r for r in docs.collect()}
    assert set(d) == {"100", "200", "guide"} and d["100"].title == "Housing" and d["200"].title is None and d["guide"].source_url == "u"
    assert d["100"].acl == "staff" and d["200"].acl == "public" and d["200"].authority_tier == 1 and d["100"].last_modified.year == 2017
    rows = stored.collect()
    assert {r.document_id for r in rows} == {r.id for r in d.values()} and all(len(r.embedding) == 256 for r in rows)
    assert any(r.heading_path == ["Housing", "Rates"] for r in rows) and schemas.orphans(stored, docs.select(F.col("id").alias("document_id")), "document_id").isEmpty()
    assert schemas.duplicates(stored, ["id"]).isEmpty()
    target = f"{root}/store"
    ingest.store_new(ingest.contextualize(ingest.ingest(spark, f"{root}/html/*.html")), None, f"{target}/docs", f"{target}/chunks")
    ingest.store_new(ingest.contextualize(ingest.ingest(spark, f"{root}/html/*.html", f"{root}/md/*.md")), spark.read.parquet(f"{target}/docs"), f"{target}/docs", f"{target}/chunks")
    assert sorted(r.source_id for r in spark.read.parquet(f"{target}/docs").collect()) == ["100", "200", "guide"]


def ask(spark, rows):
    return spark.createDataFrame(rows, "query_id long, query string, k string, pool string")


def test_search(spark, corpus):
    _, docs, stored = corpus
    rows = ask(spark, [(1, " When is the housing allowance paid? ", "3", "20"), (2, "", "5", "20"), (3, "x" * 2001, "5", "20"), (4, "tuition fees school", "999", "99999"), (5, "book stipends", "none", None), (6, None, "1", "1")])
    out = search.search(rows, stored, docs).collect()
    by = {}
    for r in out:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {1, 4, 5} and len(by[1]) == min(3, stored.count()) and len(by[4]) == min(20, stored.count())
    best = {q: min(v, key=lambda r: r.rerank_rank) for q, v in by.items()}
    assert best[1].source_id == "100" and best[4].source_id == "200" and best[5].source_id == "guide"
    assert set(search.RESULT) <= set(out[0].asDict()) and isinstance(out[0].cosine_score, float)
    assert {r.source_id for r in search.search(rows, stored, docs, groups=[]).collect()} == {"200", "guide"}
    assert {r.source_id for r in search.search(rows, stored, docs, groups=["staff"]).collect()} == {"100", "200", "guide"}


def test_requests(spark, corpus):
    for bad in ("", "  ", None, "x" * 2001):
        with pytest.raises(ValueError):
            search.check_query(bad)
    assert search.check_query(" a ") == "a" and "Question: a" in search.cite_prompt("a")
    assert search.get_document(corpus[1], "200").first().raw_content
    with pytest.raises(KeyError):
        search.get_document(corpus[1], "nothing")
    rows = ask(spark, [(i, "q", k, p) for i, (k, p) in enumerate([("0", "1"), ("5", "99999"), ("999", "text"), ("text", None), ("-3", "0")])])
    got = [(r.k, r.pool) for r in search.split_valid(rows)[0].orderBy("query_id").collect()]
    assert got == [(1, 1), (5, 100), (20, 20), (5, 20), (1, 1)]


def test_knn_paths_agree(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, [float(v) for v in r.normal(size=8)]) for i in range(400)] + [(900, None), (901, [0.0] * 8), (None, [1.0] * 8)]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = corpus.filter("id % 40 = 0").withColumnRenamed("id", "query_id")
    one = sorted(map(tuple, vector.knn(queries, corpus, 7, True).select("query_id", "id", "score", "rank").collect()))
    monkeypatch.setattr(vector, "MATRIX_QUERIES", 3)
    monkeypatch.setattr(vector, "BLOCK", 64)
    assert sorted(map(tuple, vector.knn(queries, corpus, 7, True).select("query_id", "id", "score", "rank").collect())) == one
    x = np.array([v for _, v in rows[:400]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    for q in range(0, 400, 40):
        s = np.round(x @ x[q], 6)
        s[q] = -9
        want = sorted(range(400), key=lambda i: (-s[i], i))[:7]
        assert [i for a, i, _, _ in sorted((t for t in one if t[0] == q), key=lambda t: t[3])] == want


def test_knn_of_mixed_widths(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(i, [float(v) for v in r.normal(size=2 + i % 3)]) for i in range(90)]
    rows += [(100, None), (101, []), (102, [0.0, 0.0]), (103, [1.0, None]), (104, [float("nan"), 1.0]), (105, [float("inf"), 1.0]), (106, [1e300, 1e300]), (None, [1.0, 1.0]), (3, [0.5, 0.5])]
    queries = [(7, [1.0, 1.0]), (8, [1.0, 0.0, 0.0]), (9, None), (10, [1.0, None]), (11, [0.0, 0.0]), (None, [1.0, 1.0]), (12, [1.0] * 9)]
    asked = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    want = []
    for q, a in ((7, [1.0, 1.0]), (8, [1.0, 0.0, 0.0])):
        hits = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and len(v) == len(a) and np.isfinite(v).all() and any(v)]
        scored = [(-round(float(v / np.abs(v).max() @ a / np.linalg.norm(v / np.abs(v).max()) / np.linalg.norm(a)), 6) + 0.0, i) for i, v in hits]
        want += [(q, i, -s, rank) for rank, (s, i) in enumerate(sorted(scored)[:5], 1)]
    for queries_at_once in (100, 2):
        monkeypatch.setattr(vector, "MATRIX_QUERIES", queries_at_once)
        for parts, order in ((1, rows), (7, rows[::-1])):
            corpus = spark.createDataFrame(order, "id long, embedding array<double>").repartition(parts)
            got = sorted(map(tuple, vector.knn(asked, corpus, 5).select("query_id", "id", "score", "rank").collect()), key=lambda t: (t[0], t[3]))
            assert [(a, b, round(c, 6), d) for a, b, c, d in got] == [(a, b, round(c, 6), d) for a, b, c, d in want]


def test_a_task_keeps_k_rows_a_query(spark, monkeypatch):
    """All blocks meet in two lanes of the corpus, so at most 2 k rows a query reach the last ranking, however many blocks there are."""
    r = np.random.default_rng(3)
    corpus = spark.createDataFrame([(i, [float(v) for v in r.normal(size=4)]) for i in range(3000)], "id long, embedding array<double>").repartition(2)
    queries = corpus.filter("id % 10 = 0").withColumnRenamed("id", "query_id")
    want = sorted(map(tuple, vector.knn(queries, corpus, 5).select("query_id", "id", "rank").collect()))
    monkeypatch.setattr(vector, "BLOCK", 50)
    monkeypatch.setattr(vector, "grid", lambda rows, columns, cells: (3, 2))
    monkeypatch.setattr(vector, "MATRIX_BYTES", 0)
    for held, most in ((64 << 20, 2 * 5), (0, 10**9)):
        monkeypatch.setattr(vector, "HELD_BYTES", held)
        found = vector._blockwise(*(df.select(F.col(c), "embedding") for df, c in ((queries, "query_id"), (corpus, "id"))), 5, False)
        assert found.groupBy("query_id").count().agg(F.max("count")).first()[0] <= most
        assert sorted(map(tuple, vector.knn(queries, corpus, 5).select("query_id", "id", "rank").collect())) == want


def test_lanes_grow_with_the_blocks():
    assert vector.grid(0, 0, 16) == (1, 1) and vector.grid(4, 4, 16) == (1, 1)
    for rows, columns in ((4, 10**6), (1000, 1000), (10**4, 3)):
        a, b = vector.grid(rows, columns, 16)
        assert 1 <= a <= rows and 1 <= b <= columns and 8 <= rows * columns / (a * b) <= 32


def test_gate(spark):
    m = lambda *v: spark.createDataFrame(list(zip(evaluate.TOLERANCES, v)), "metric string, value double")
    base = m(0.9, 0.9, 0.9, 0.1)
    assert evaluate.check_regression(base, base) == []
    failed = {r.metric: r.failed for r in evaluate.gate(m(0.849, 0.86, 0.95, 0.201), base).collect()}
    assert failed == {"top1_source_match_rate": True, "topk_source_match_rate": False, "answer_keyword_recall_mean": False, "idk_rate": True}
    assert len(evaluate.check_regression(m(0.9, 0.9, 0.9, None), base.filter("metric <> 'topk_source_match_rate'"))) == 2


def test_proxies(spark):
    rows = [(1, "Muskogee pays $45,000", ["in muskogee they paid"], "I don't know.", True, True, 10, 5), (2, None, None, None, False, True, None, None), (3, "the of", ["x"], "fine", False, False, 21, 6)]
    r = evaluate.proxies(spark.createDataFrame(rows, "id int, expected_answer string, context_strings array<string>, answer string, top1_source_match boolean, topk_source_match boolean, input_tokens long, output_tokens long")).first()
    assert (r.n, r.answer_keyword_recall_n, r.avg_input_tokens, r.avg_output_tokens) == (3, 1, 10, 3)
    assert abs(r.answer_keyword_recall_mean - 0.5) < 1e-9 and abs(r.idk_rate - 1 / 3) < 1e-9 and abs(r.topk_source_match_rate - 2 / 3) < 1e-9


def test_audit(spark):
    docs = spark.createDataFrame([("1", "The Muskogee office pays $45,000 for Housing."), ("2", "Muskogee and Housing at $45,000 too"), ("3", "nothing")], "source_id string, content string")
    golden = spark.createDataFrame([(1, "Which Muskogee office handles Payroll?", "Muskogee $45,000 Housing", ["1", "9"]), (2, "x", "", [])], "id int, query string, answer string, expected_source_ids array<string>")
    out = {r.id: r for r in evaluate.audit(golden, docs).collect()}
    assert out[1].missing_ids == ["9"] and "Payroll" in out[1].subject_missing and "Muskogee" not in out[1].subject_missing and out[1].answer_hit == 1.0 and out[1].alternates == ["2"]
    assert out[2].missing_ids is None and out[2].alternates is None


def test_text_functions(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    e = lambda *a: val(X.embed_text(*a))
    path = F.array(F.lit("T"), F.lit("H"))
    assert e(F.lit("body"), F.lit(False), F.lit("T"), path, F.lit("ctx ")) == "ctx\n\nbody"
    assert e(F.lit("body"), F.lit(True), F.lit("T"), path, F.lit(None)) == "T | H"
    assert e(F.lit("b" * 600), F.lit(True), F.lit(None), F.lit(None).cast("array<string>"), F.lit("")) == "b" * 500
    assert val(X.rerank_text(F.lit("c" * 3000), path)) == "T > H\n\n" + "c" * 2000
    assert val(X.request_id(X.request_token(F.lit("--a b/c.d--")), F.lit(3))) == "a_b_c_d__3"
    assert val(X.parse_request_id(F.lit("a__b__12"))).asDict() == {"token": "a__b", "chunk_index": 12}
    assert val(X.identifier_words(F.lit("parseHTTPResponse_v2"))) == ["parse", "http", "response", "v2"]
    assert val(X.key_terms(F.lit("Muskogee muskogee BAH 80 % 2020-08-01 the office"))) == ["Muskogee", "BAH", "80 %", "2020-08-01", "office"]
    assert val(X.vector_literal(F.array(F.lit(0.5), F.lit(-1.25)))) == "[0.500000,-1.250000]"


ARTICLE = '<ns2:article type="x" id="12"><ns2:name> A </ns2:name><ns2:content>&amp;lt;p&amp;gt;x&amp;nbsp;&amp;lt;/p&amp;gt;</ns2:content><topicBreadcrumb><name>R</name><name>S</name></topicBreadcrumb><customAttribute><attributeName>k</attributeName><attributeValue>v</attributeValue></customAttribute><ns2:attachment><name>f</name><url>u</url></ns2:attachment><version>3</version></ns2:article>'
TOPICS = '<r><ns2:topic childCount="1" id="1"><ns2:name>Root</ns2:name><ns2:articleCount>0</ns2:articleCount></ns2:topic><ns2:topic childCount="0" id="2"><ns2:name>Leaf</ns2:name><ns2:parentTopicId>1</ns2:parentTopicId><ns2:articleCount>2</ns2:articleCount><ns2:articleTotalCount>2</ns2:articleTotalCount></ns2:topic></r>'


def test_crawl(spark):
    def fetch(path, params):
        if path == "topic/9":
            return 500, ""
        if path.startswith("topic/"):
            return 200, TOPICS
        if path == "article":
            n = int(params["$rangestart"])
            return 200, f'<r><count>{25 if n < 50 else 0}</count><maxRange>60</maxRange><article id="{n}"><name>N{n}</name></article></r>'
        return 200, ARTICLE.replace("&amp;lt;p&amp;gt;x&amp;nbsp;&amp;lt;/p&amp;gt;", "<![CDATA[<p>y</p>]]>") if path.endswith("/13") else ARTICLE

    topics = enrich.topics(portal.read_portal(spark, fetch, "topics", ["1", "9"]))
    t = {r.id: r for r in topics.collect()}
    assert set(t) == {"1", "2"} and t["2"].parent_id == "1" and t["1"].parent_id is None and t["2"].article_count == 2 and t["1"].child_count == 1
    crumbs = {r.id: r.breadcrumb for r in hierarchy.breadcrumbs(topics).collect()}
    assert crumbs == {"1": ["Root"], "2": ["Root", "Leaf"]}
    assert [r.asDict() for r in hierarchy.children(topics).collect()] == [{"id": "1", "child_ids": ["2"]}]
    pages = portal.read_portal(spark, fetch, "listing", ["2"], delay=0).select(F.explode(enrich.listing(F.col("value"))["articles"]).alias("a")).select("a.*")
    assert sorted(r.id for r in pages.collect()) == ["0", "25", "50"]
    assert sorted(r.id for r in portal.to_fetch(pages, spark.createDataFrame([("25",)], "id string")).collect()) == ["0", "50"]
    found = portal.read_portal(spark, fetch, "article", ["12", "13"], delay=0).select("key", enrich.article_fields(F.col("value")).alias("article")).orderBy("key")
    a, b = found.collect()
    assert a.article.id == "12" and a.article.name == "A" and a.article.content_html == "<p>x\xa0</p>" and a.article.topic_breadcrumb == ["R", "S"] and a.article.custom_attributes == {"k": "v"} and a.article.attachments[0].url == "u"
    assert b.article.content_html == "<p>y</p>"
    meta = enrich.source_metadata(found, "https://portal.example/").first()
    assert meta.source_url == "https://portal.example/12" and meta.contains_table is False


def test_cycles_end(spark):
    nodes = spark.createDataFrame([("a", "b", "A"), ("b", "c", "B"), ("c", "a", "C"), ("d", "zz", "D")], "id string, parent_id string, name string")
    out = {r.id: r.breadcrumb for r in hierarchy.breadcrumbs(nodes).collect()}
    assert out == {"a": ["C", "B", "A"], "b": ["A", "C", "B"], "c": ["B", "A", "C"], "d": ["D"]}


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"results": [{"id": 1}, {"id": 2}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": 3}]))
    assert [r.id for r in files.read_results(spark, str(tmp_path / "a.json")).collect()] == [1, 2]
    assert [r.id for r in files.read_results(spark, str(tmp_path / "b.json")).collect()] == [3]
    (tmp_path / "g.json").write_text(json.dumps({"queries": [{"id": 1, "query": "q", "source_article_id": 5, "source_article_id_alt": [6]}]}))
    g = files.read_golden(spark, str(tmp_path / "g.json")).select(evaluate.expected_ids(F.col("source_article_id"), F.col("source_article_id_alt")).alias("e")).first()
    assert g.e == ["5", "6"]
    html = spark.range(1).select(files.article_html(F.lit('A & "B"'), {"acl": F.lit("x<y")}, F.array(F.lit("R"), F.lit("S")), F.lit("<p>c</p>"))).first()[0]
    assert "<title>A &amp; &quot;B&quot;</title>" in html and 'content="x&lt;y"' in html and "R &gt; S" in html and "<h1>A" in html
    df = spark.range(3)
    assert spark.read.parquet(files.write_version(df, str(tmp_path / "t"), "1")).count() == 3
    files.insert_new(spark.range(5), df, "id", str(tmp_path / "t" / "version=1"))
    assert spark.read.parquet(str(tmp_path / "t" / "version=1")).count() == 5
    files.write_artifact(df.selectExpr("count(*) n"), df, str(tmp_path / "art"))
    assert spark.read.json(str(tmp_path / "art" / "results")).count() == 3


def test_upkeep(spark):
    ctx = spark.createDataFrame([("a", 0, "c"), ("a", 1, "")], "source_id string, chunk_index int, context string")
    chunks = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "source_id string, chunk_index int")
    assert sorted(map(tuple, maintenance.not_contextualized(chunks, ctx).collect())) == [("a", 1), ("b", 0)]
    assert [r.context for r in files.prefer_context(chunks, ctx).orderBy("source_id", "chunk_index").collect()] == ["c", "", ""]
    hits = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 3, "y")], "query_id int, rank int, text string")
    assert sorted(r["rank"] for r in maintenance.distinct_results(hits, "text").collect()) == [1, 3]
    noise = spark.createDataFrame([("thanks a lot!",), ("ok",), ("How do I claim the housing allowance",)], "t string")
    assert [r[0] for r in noise.select(maintenance.is_noise(F.col("t"))).collect()] == [True, True, False]
    assert telemetry.cost(telemetry.BATCH, {"input": F.lit(1000000)}) is not None


def test_models(spark):
    a, b, c = models.HashEmbedder().encode(["the housing allowance", "housing allowance the", ""])
    assert a @ b > 0.5 and np.linalg.norm(a) == pytest.approx(1) and not c.any()
    answer = spark.range(1).select(models.answer_column(F.lit("housing allowance"), F.array(F.lit("Nothing here. The housing allowance is monthly. End."))), models.answer_column(F.lit("zebra stripes"), F.array(F.lit("Nothing here.")))).first()
    assert answer[0] == "The housing allowance is monthly." and X.IDK in answer[1]


def test_verdicts(spark):
    rows = spark.createDataFrame([("idk_rate", 0.1), ("idk_rate", -0.1), ("topk", 0.1), ("topk", 0.0005), ("topk", None)], "m string, d double")
    assert [r[0] for r in rows.select(evaluate.verdict(F.col("m"), F.col("d"))).collect()] == ["worse", "better", "better", "same", "missing"]


def test_evaluation_run(spark, corpus):
    _, docs, stored = corpus
    golden = spark.createDataFrame(
        [(1, "When is the housing allowance paid?", "at the end of each month", "100", None, "a"), (2, "zebra", "x", None, ["200"], "b"), (3, " ", "x", "1", None, "b")],
        "id int, query string, answer string, source_article_id string, source_article_id_alt array<string>, query_type string",
    )
    out = {r.id: r for r in run.evaluation(golden, stored, docs).collect()}
    assert out[1].top1_source_match and out[1].topk_source_match and "[Chunk 1]\nSource: 100" in out[1].context_strings[0] and "month" in out[1].answer and out[1].error is None
    assert out[2].answer == X.IDK + "." and out[3].error == "invalid query" and out[3].answer is None
    records = run.evaluation(golden, stored, docs)
    p = evaluate.proxies(records).first()
    assert p.n == 3 and abs(p.idk_rate - 1 / 3) < 1e-9
    summary = {r.metric: r for r in evaluate.score_summary(run.judged(records)).collect()}
    assert summary["faithfulness"].mean > 0 and set(summary) <= {"faithfulness", "answer_relevancy", "contextual_precision", "contextual_recall", "contextual_relevancy"}
    assert [r.id for r in run.evaluation(golden, stored, docs, ids=[2]).collect()] == [2]
    a, b = evaluate.same_queries(golden, golden.filter("id > 1"))
    assert a.count() == b.count() == 2


def test_traces_and_caches(spark, corpus):
    _, docs, stored = corpus
    rows = ask(spark, [(1, "housing allowance", "3", "20")])
    hits = search.search(rows, stored, docs)
    span = run.spans(hits, rows, F.timestamp_millis(F.lit(1000)), F.timestamp_millis(F.lit(1250))).first()
    assert span.latency_ms == 250 and span.top_rerank_score is not None and '"source_id":"100"' in span.output_value
    same = spark.createDataFrame([("Housing  ALLOWANCE?",), ("other",)], "query string")
    known = same.limit(1).select(F.md5(run.normalized(F.lit("housing allowance")).cast("binary")).alias("query_hash"), F.lit("yes").alias("answer"))
    assert {r.query: r.answer for r in run.cached(same, known).collect()} == {"Housing  ALLOWANCE?": "yes", "other": None}
    with pytest.raises(ValueError):
        run.tenant_only(same, "")
    assert run.hypothetical(same, lambda q: F.lit(None).cast("string")).count() == 2


def test_breadcrumbs_of_deep_trees_cycles_and_repeats(spark):
    rows = [(i, i - 1 if i else None, f"n{i}") for i in range(300)]  # a chain
    rows += [(1000, 1001, "a"), (1001, 1002, "b"), (1002, 1000, "c"), (1003, 1000, "d"), (1004, 1004, "e"), (1005, 9999, "f"), (1006, 1005, None), (1005, 9999, "f"), (None, 1, "x")]
    rows += [(2000 + i, i % 7, None) for i in range(500)]
    parent = {i: (p, n) for i, p, n in rows if i is not None}
    got = {r.id: r.breadcrumb for r in hierarchy.breadcrumbs(spark.createDataFrame(rows, "id long, parent_id long, name string")).collect()}
    assert got.keys() == parent.keys()
    for i in parent:
        path, at = [], i
        while at in parent and at not in path:
            path.append(at)
            at = parent[at][0]
        assert got[i] == [parent[x][1] for x in reversed(path)], i
    assert hierarchy.breadcrumbs(spark.createDataFrame([], "id long, parent_id long, name string")).collect() == []
