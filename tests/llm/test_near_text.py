import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_mixing import words

import corpus_pipeline
from lorequarry.llm import near_text


def brute_groups(texts, k=5, similarity=(4, 5)):
    """Components over all pairs, by plain sets of shingles."""
    sets = {i: {" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if (w := words((t or "").lower())) else set() for i, t in sorted(texts.items())}
    part = {i: i for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and part[i] != part[j] and (a == b or len(a & b) * similarity[1] >= similarity[0] * len(a | b)):
                old, new = max(part[i], part[j]), min(part[i], part[j])
                part = {x: new if c == old else c for x, c in part.items()}
    return part


def copies(seed=5, groups=12, each=8):
    """Groups of copies with up to a few words changed, a passage left out, or words from elsewhere."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts, n = {}, 0
    for _ in range(groups):
        base = [word() for _ in range(r.choice((3, 5, 6, 30, 120, 400)))]
        for _ in range(each):
            made = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                made[r.randrange(len(made))] = word()
            if r.random() < 0.3:
                del made[: len(made) // 8]
            texts[n], n = " ".join(made), n + 1
    return texts


def test_groups_are_those_of_all_pairs(spark, docs_of, odd_rows):
    texts = copies() | {1000 + i: t for i, t, *_ in odd_rows if i is not None}
    rows = [(i, t, "en", "a") for i, t in texts.items()]
    got = {r.doc_id: r.component_id for r in near_text.near_duplicates(docs_of(rows)).collect()}
    assert got == brute_groups(texts)
    assert near_text.near_duplicates(docs_of([])).collect() == []


def sets_of(spark, texts):
    return spark.createDataFrame([(i, near_text.shingles(near_text.words_of(t)).view(np.int64).tolist()) for i, t in texts.items()], "node long, tokens array<long>")


@pytest.mark.parametrize("similarity", [(1, 2), (4, 5), (1, 1)])
@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_buckets_give_the_components_of_all_their_pairs(spark, monkeypatch, similarity, rounds):
    """All texts in one bucket, cut into parts; with leaders and without."""
    monkeypatch.setattr(near_text, "ROUNDS", rounds)
    monkeypatch.setattr(near_text, "MEMBERS", 7)
    texts = copies(9, 15, 8)
    sets = sets_of(spark, texts)
    buckets = sets.select(F.lit(1).cast("long").alias("bucket"), "node", F.size("tokens").alias("size"))
    got = {r.node: r.component for r in near_text.components(buckets, sets, similarity[0] / similarity[1], part=25).collect()}
    want = brute_groups(texts, similarity=similarity)
    assert {i: got.get(i, i) for i in texts} == want


def test_a_large_group_meets_its_leader_and_not_each_other(spark, monkeypatch):
    base = [f"word{i * 37 % 1009}" for i in range(150)]
    texts = {}
    for i in range(1500):
        made = list(base)
        made[i % 150] = f"other{i}"
        texts[i] = " ".join(made)
    seen, write = [], near_text.materialize

    def spy(df, name):
        seen.append((name, out := write(df, name)))
        return out

    monkeypatch.setattr(near_text, "materialize", spy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.component_id for r in near_text.near_duplicates(docs).collect()} == {0}
    links = [t.count() for name, t in seen if name == "near-links"]
    assert sum(links) <= near_text.BANDS * len(texts) and links[-1] == 0


def test_shingles_fold_case_and_white_space_and_keep_the_order():
    made = lambda t: near_text.shingles(near_text.words_of(t)).tolist()
    assert made("A  b\tc") == made("a b c") != made("b a c") and made(None) == made(" ") == []
    assert len(made("a b c d e f")) == 2 and len(made("a a a a a a a")) == 1


def test_many_texts_are_looked_up_by_a_shuffle(spark, docs_of, monkeypatch):
    monkeypatch.setattr(near_text, "BROADCAST_IDS", 0)
    texts = copies(3, 4, 5)
    got = {r.doc_id: r.component_id for r in near_text.near_duplicates(docs_of([(i, t, None, None) for i, t in texts.items()])).collect()}
    assert got == brute_groups(texts)


def test_stage_drops_copies_with_an_edited_passage(spark, docs_of, sf_dir):
    base = [f"word{i * 37 % 1009}" for i in range(200)]
    near, far = list(base), list(base)
    near[50:60] = [f"other{i}" for i in range(10)]
    far[50:90] = [f"other{i}" for i in range(40)]
    docs = docs_of([(1, " ".join(base), "en", "a"), (2, " ".join(near), "en", "b"), (3, " ".join(far), "en", "c")])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()) == [1, 3]
