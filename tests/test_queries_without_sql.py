"""The registered queries that have no SQL, over whole tables against plain loops or what must hold of every row."""

import re
from collections import defaultdict

import numpy as np
import pytest

from lorequarry.functions.stemming import STOP_WORDS, stem
from lorequarry.queries import ORACLE_SQL, QUERIES

CHECKED = {}


def checks(f):
    CHECKED[f.__name__] = f
    return f


def texts_of(spark, sf_dir, name="documents", key="doc_id"):
    return {r[key]: r.text for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key, "text").collect()}


def vector(text):
    out = defaultdict(list)
    for place, word in enumerate(re.findall(r"[^\W_]+", (text or "").lower()), 1):
        if word not in STOP_WORDS:
            out[stem(word)].append(place)
    return out


@checks
def tsvector_english(spark, sf_dir, rows):
    want = {(i, lexeme): places for i, t in texts_of(spark, sf_dir).items() for lexeme, places in vector(t).items()}
    assert {(r.doc_id, r.lexeme): r.positions for r in rows} == want


@checks
def phrase_match_english(spark, sf_dir, rows):
    found = {(r.item_id, r.sentence_no, r.doc_id): r.starts for r in rows}
    docs = {i: {p: w for w, ps in vector(t).items() for p in ps} for i, t in texts_of(spark, sf_dir).items()}
    want = {}
    for item, text in texts_of(spark, sf_dir, "benchmark", "item_id").items():
        for k, phrase in enumerate(re.split(r"[.!?\n]+", text)):
            asked = sorted((p, w) for w, ps in vector(phrase).items() for p in ps)
            for i, words in docs.items():
                starts = sum(all(words.get(s + p - asked[0][0]) == w for p, w in asked) for s in words) if asked else 0
                if starts:
                    want[item, k, i] = starts
    assert found == want


@checks
def search_batch(spark, sf_dir, rows):
    by_query = defaultdict(list)
    for r in rows:
        by_query[r.query_id].append(r)
    assert set(by_query) == set(texts_of(spark, sf_dir, "benchmark", "item_id"))
    docs = texts_of(spark, sf_dir)
    for hits in by_query.values():
        hits.sort(key=lambda r: r.rerank_rank)
        assert len(hits) == 5 and len({r.rerank_rank for r in hits}) == 5
        assert [r.rerank_score for r in hits] == sorted((r.rerank_score for r in hits), reverse=True)
        assert all(r.content in docs[int(r.source_id)] and -1.0001 <= r.cosine_score <= 1.0001 for r in hits)


@checks
def query_clusters(spark, sf_dir, rows):
    asked = {r.vec_id: np.array(r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r.vec_id % 50 == 0}
    cluster = {r.query_id: r.cluster for r in rows}
    assert len(rows) == len(cluster) and set(cluster) == set(asked) and set(cluster.values()) <= set(range(4))
    # every query is nearest to the middle of its own cluster
    units = {q: v / np.linalg.norm(v) for q, v in asked.items()}
    middles = {c: np.mean([units[q] for q in cluster if cluster[q] == c], axis=0) for c in set(cluster.values())}
    assert all(min(middles, key=lambda c: np.linalg.norm(units[q] - middles[c])) == c0 for q, c0 in cluster.items())


@checks
def query_time_chunks(spark, sf_dir, rows):
    docs = texts_of(spark, sf_dir)
    pieces = defaultdict(dict)
    for r in rows:
        pieces[r.query_id, r.id][r.chunk_index] = r.content
    for (_, i), found in pieces.items():
        assert sorted(found) == list(range(len(found)))
        place = 0
        for k in sorted(found):  # the chunks stand in the document in their order
            place = docs[i].index(found[k].split("\n")[0], place)


@checks
def recursive_split(spark, sf_dir, rows):
    docs = texts_of(spark, sf_dir)
    pieces = defaultdict(dict)
    for r in rows:
        pieces[r.doc_id][r.piece] = r.content
    assert set(pieces) == {i for i, t in docs.items() if t and t.strip()}
    for i, found in pieces.items():
        assert sorted(found) == list(range(len(found)))
        # pieces may overlap, but together hold every word of the text and no other
        assert set(" ".join(found.values()).split()) == set(docs[i].split())


@checks
def markdown_chunks(spark, sf_dir, rows):
    docs = texts_of(spark, sf_dir)
    assert not [r for r in rows if r.error] and {int(r.source_id) for r in rows} == {i for i, t in docs.items() if t and t.strip()}
    for i in docs:
        mine = sorted((r for r in rows if r.source_id == str(i)), key=lambda r: r.chunk_index)
        assert [r.chunk_index for r in mine] == list(range(len(mine)))
        words = set(" ".join(r.content for r in mine).split())
        assert set((docs[i] or "").split()) - words == set()


@checks
def html_structural_chunks(spark, sf_dir, rows):
    pages = {str(r.page_id): r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert not [r for r in rows if r.error] and {r.source_id for r in rows} == set(pages)
    for i in pages:
        mine = sorted((r for r in rows if r.source_id == i), key=lambda r: r.chunk_index)
        assert [r.chunk_index for r in mine] == list(range(len(mine)))
        assert all(r.content.strip() and r.token_count > 0 and r.chunk_type in ("text", "list", "table") for r in mine)


@checks
def enrich_metadata(spark, sf_dir, rows):
    pages = {str(r.page_id): r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert {r.source_id for r in rows} == set(pages) and all(r.heading_count == len(r.heading_outline) for r in rows)
    for r in rows:
        html = pages[r.source_id].lower()
        assert r.contains_table == ("<table" in html) and r.contains_list == ("<ul" in html or "<ol" in html)
        assert (r.acl, r.source_authority_tier) == ("public", 1)


@checks
def offline_answers(spark, sf_dir, rows):
    docs, asked = texts_of(spark, sf_dir), texts_of(spark, sf_dir, "benchmark", "item_id")
    assert {(r.item_id, r.metric) for r in rows} == {(i, m) for i in asked if i in docs for m in ("faithfulness", "answer_relevancy", "contextual_precision", "contextual_recall", "contextual_relevancy")}
    for r in rows:
        assert r.answer == "I don't know." or r.answer in docs[r.item_id]
        assert r.score is None and r.success is None or 0 <= r.score <= 1 and r.success == (r.score >= 0.7)


@checks
def evaluation_run(spark, sf_dir, rows):
    (r,) = rows
    assert r.n == len(texts_of(spark, sf_dir, "benchmark", "item_id"))
    assert 0 <= r.top1_source_match_rate <= r.topk_source_match_rate <= 1 and 0 < r.answer_keyword_recall_mean <= 1 and 0 <= r.idk_rate < 1
    assert r.avg_input_tokens > r.avg_output_tokens > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query(spark, sf_dir, name):
    CHECKED[name](spark, sf_dir, QUERIES[name](spark, sf_dir).collect())
