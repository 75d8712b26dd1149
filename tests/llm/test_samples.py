"""Samples of rows that repeat an id, and both models against plain loops."""

import math

import numpy as np
import pytest

from lorequarry.llm import common, language_id, quality


@pytest.mark.parametrize("doc_id", range(1, 6))
def test_many_rows_of_one_id(spark, doc_id):
    rows = [(doc_id, f"the text number {i}", "en") for i in range(3000)] + [(100 + i, f"le texte {i}", "fr") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    ids = common.bounded_sample(docs, "lang", "doc_id", 100)
    assert sorted((r.lang, r["count"]) for r in ids.groupBy("lang").count().collect()) == [("en", 1), ("fr", 50)]
    got = common.sampled_texts(docs, ids, "lang", 100).collect()
    texts = {lang: [r.text for r in got if r.lang == lang] for lang in ("en", "fr")}
    assert len(texts["en"]) == len(set(texts["en"])) == 100 and len(texts["fr"]) == 50


def test_equal_rows_count_once(spark):
    docs = spark.createDataFrame([(7, "same", "en")] * 2000 + [(i, f"other {i}", "en") for i in range(10, 40)] + [(8, None, "en")], "doc_id long, text string, lang string")
    got = common.sampled_texts(docs, common.bounded_sample(docs, "lang", "doc_id", 500), "lang", 500).collect()
    assert len(got) == 32 and sum(r.text == "same" for r in got) == 1


def test_a_sample_is_fixed_and_bounded(spark):
    rows = [(i, "ab"[i % 2], "x") for i in range(4000)]
    schema = "id long, label string, other string"
    a = {(r.label, r.id) for r in common.bounded_sample(spark.createDataFrame(rows, schema), "label", "id", 60).collect()}
    b = {(r.label, r.id) for r in common.bounded_sample(spark.createDataFrame(rows[::-1], schema).repartition(7), "label", "id", 60).collect()}
    assert a == b and len(a) == 120


def test_language_votes_by_loops():
    draw = np.random.default_rng(3)
    languages = ["ca", "da", "de", "es", "fr", "it", "tlh"]
    centres = {c: draw.normal(size=language_id.DIMS) for c in languages}
    langs = [languages[i % 7] for i in range(140)]
    model = language_id.fit(np.array([centres[c] + draw.normal(size=language_id.DIMS) for c in langs], np.float32), langs)
    assert set(model.families) == {("ca", "es", "fr", "it"), ("da", "de"), ("tlh",)}
    for text in ("une maison et le pain", "der Hund und das Haus", "nuqneH tlhIngan", "a", "el agua es buena y la casa"):
        x = [*language_id.features(text).tolist(), 1.0]
        score = [4 * sum(w * v for w, v in zip(machine.tolist(), x)) for machine in model.family_machines]
        family = model.families[score.index(max(score))]
        sure = math.exp(max(score)) / sum(map(math.exp, score))
        votes, belief = {c: 0 for c in family}, {c: 0.0 for c in family}
        for a in family:
            for b in family:
                if (a, b) in model.pairs:
                    m = sum(w * v for w, v in zip(model.pairs[a, b].tolist(), x))
                    votes[a] += m > 0
                    votes[b] += m <= 0
                    belief[a] += 1 / (1 + math.exp(-4 * m))
                    belief[b] += 1 / (1 + math.exp(4 * m))
        want = sorted(family, key=lambda c: (votes[c], belief[c]))[-1]
        lang, p = model.predict(text)
        assert lang == want and p == pytest.approx(sure * (belief[want] / (len(family) - 1) if len(family) > 1 else 1), abs=1e-5)


def test_machines_part_their_classes():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(200, 6)).astype(np.float32)
    y = np.where(x @ np.array([1, -2, 0.5, 0, 0, 3]) > 0.3, 1, -1).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = language_id.linear_svm(x, y)

    def loss(w):
        total = 0.0
        for row, label in zip(x.tolist(), y.tolist()):
            margin = sum(a * b for a, b in zip(row, w[:-1])) + w[-1]
            total += 0.5 / (y == label).sum() * max(0.0, 1 - label * margin) ** 2
        return total + 1e-3 / 2 * sum(v * v for v in w)

    best = loss(w.tolist())
    for k in range(len(w)):  # no step along an axis is better
        for step in (-0.02, 0.02):
            moved = w.astype(float).copy()
            moved[k] += step
            assert loss(moved.tolist()) > best - 1e-4


def test_strengths_by_loops():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(120, 4))
    labels = (x @ np.array([2.0, -1.0, 0.0, 0.5]) + draw.normal(size=120) * 0.5 > 0).astype(int)
    model = quality.fit(x, labels, pairs=3000)
    scaled = [[min(8.0, max(-8.0, (v - m) / s)) for v, m, s in zip(row, x.mean(0).tolist(), x.std(0).tolist())] for row in x.tolist()]
    good, bad = [r for r, q in zip(scaled, labels) if q], [r for r, q in zip(scaled, labels) if not q]

    def loss(w):  # over all pairs, of which the fit draws some
        strength = lambda r: sum(a * b for a, b in zip(r, w))
        return sum(math.log1p(math.exp(strength(b) - strength(g))) for g in good for b in bad) / (len(good) * len(bad)) + 1e-3 / 2 * sum(v * v for v in w)

    best = loss(model.weights.tolist())
    for k in range(4):
        for step in (-0.5, 0.5):
            moved = model.weights.copy()
            moved[k] += step
            assert loss(moved.tolist()) > best - 2e-3
    # the cut agrees best with the labels, each label weighing the same
    strengths = [sum(a * b for a, b in zip(r, model.weights.tolist())) for r in scaled]
    wrong = lambda cut: sum((s >= cut) != bool(q) and 1 / (len(good) if q else len(bad)) for s, q in zip(strengths, labels))
    assert wrong(model.threshold) <= min(map(wrong, strengths)) + 1e-9
    for r, s in zip(x, strengths):
        want = 1 / (1 + math.exp(-((s - model.threshold) / model.width + math.log(0.3 / 0.7))))
        assert float(model.score(r)) == pytest.approx(want, abs=1e-6)


def test_columns_with_the_same_names(spark):
    docs = spark.createDataFrame([(1, "the house", "en", 0.5, 9, "row"), (2, None, None, None, None, None)], "doc_id long, text string, lang string, score double, predicted int, row string")
    model = quality.fit(np.zeros((0, 0)), np.zeros(0))
    out = quality.score(docs, model)
    assert out.columns == docs.columns and {r.predicted for r in out.collect()} == {1}
    assert quality.learn(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).weights.any() == False  # noqa: E712
    said = language_id.identify(docs, language_id.learn(docs)).collect()
    assert {(r.doc_id, r.lang_pred) for r in said} == {(1, "en"), (2, "und")}
