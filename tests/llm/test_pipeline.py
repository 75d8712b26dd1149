"""The pipeline's stages against plain versions of them, and all of them over odd tables."""

from collections import Counter, defaultdict

import pytest
from test_line_dedup import brute as brute_lines
from test_mixing import water, words
from test_near_text import brute_groups

import corpus_pipeline
from lorequarry.llm import line_dedup, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage is given and returns, over the small corpus."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf_dir).cache()
        out.append((docs.collect(), made.collect(), made.columns))
        docs = made
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing", "best-fit packing"]
    assert all(columns == list(corpus_pipeline.COLUMNS) for _, _, columns in stages[:-1])


def test_quality(spark, stages, sf_dir):
    given, made, _ = stages[0]
    model = quality.learn_from_split(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {r.doc_id for r in given if model.score(quality.measures(r.text)[None])[0] >= 0.3}
    assert {r.doc_id for r in made} == kept
    marked = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(i in kept for i, q in marked.items() if q == 1) and not any(i in kept for i, q in marked.items() if q == 0)


def test_lines(stages):
    given, made, _ = stages[1]
    want = {i: t for i, t, n, dropped in brute_lines([(r.doc_id, r.text) for r in given], line_dedup.MIN_CHARS) if dropped < n or not dropped}
    assert {r.doc_id: r.text for r in made} == want and all(r.n_chars == len(r.text) for r in made)


def test_near_duplicates(stages):
    given, made, _ = stages[2]
    parts = brute_groups({r.doc_id: r.text for r in given})
    assert sorted(r.doc_id for r in made) == sorted(set(parts.values()))
    assert {r.doc_id: r.text for r in made}.items() <= {r.doc_id: r.text for r in given}.items()


def test_mixture(stages):
    given, made, _ = stages[3]
    sizes, got, text = defaultdict(int), Counter(), {r.doc_id: r.text for r in given}
    for r in given:
        sizes[r.source] += len(words(r.text))
    for r in made:
        got[r.source] += len(words(r.text))
        assert text[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    for source, target in water(sizes).items():
        assert abs(got[source] - target) <= 0.5


def test_packing(stages):
    given, made, _ = stages[4]
    size, placed, bins = Counter(), Counter(), defaultdict(list)
    for r in given:
        size[r.doc_id] += len(words(r.text))
    for r in made:
        placed[r.doc_id] += r.n_words
        bins[r.bin_id].append(r)
    assert placed == size
    assert all(sum(r.n_words for r in b) <= 2048 and len({r.source for r in b}) == len(b) == len({r.cluster for r in b}) for b in bins.values())


def test_run_writes_between_stages(spark, sf_dir, stages):
    assert sorted(corpus_pipeline.run(spark, sf_dir).collect()) == sorted(stages[-1][1])


@pytest.mark.parametrize("empty", [True, False])
def test_odd_tables(spark, tmp_path, odd_rows, empty):
    rows = [] if empty else [(i, t, lang, src, None) for i, t, lang, src in odd_rows]
    spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS size", "1 AS copy", "2 AS component_id").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(out) != empty
