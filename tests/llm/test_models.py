import zlib

import numpy as np
from pyspark.sql import functions as F

from lorequarry.llm import language_id, quality

WORDS = {"en": "the of and to in is was house water good time", "de": "der die und das ist nicht haus wasser gut zeit ein", "fr": "le la et les est pas maison eau bon temps une", "es": "el los y las es no casa agua bueno tiempo una"}


def sentences(lang, n, seed):
    r = np.random.default_rng(seed)
    words = WORDS[lang].split()
    return [" ".join(r.choice(words, r.integers(5, 40))) for _ in range(n)]


def test_languages_and_families(docs_of, odd_rows):
    rows, i = [], 0
    for seed, lang in enumerate(WORDS):
        for t in sentences(lang, 60, seed):
            rows.append((i, t, lang, None))
            i += 1
    docs = docs_of(rows)
    held_out = language_id.remainder(F.col("doc_id"), 4) == 2
    model = language_id.learn(docs.filter(~held_out), per_language=20)
    assert model.families == (("de", "en"), ("es", "fr"))
    out = language_id.identify(docs, model).select("doc_id", held_out.alias("h"), "lang_pred", "score").collect()
    truth = {i: lang for i, _, lang, _ in rows}
    assert len(out) == len(rows) and np.mean([r.lang_pred == truth[r.doc_id] for r in out if r.h]) > 0.98
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    odd = language_id.identify(docs_of([*odd_rows, (50, "123 ... ²", None, None)]), model).collect()
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {1, 2, 3, 50} and all(r.score == 0 for r in odd if r.lang_pred == "und")
    assert len(odd) == len(odd_rows) + 1 and language_id.identify(docs_of([]), model).collect() == []


def test_languages_without_or_with_one_label(docs_of):
    none = language_id.learn(docs_of([(1, "some text", None, None), (2, None, "en", None)]))
    assert none.predict("some text") == ("und", 0.0)
    one = language_id.learn(docs_of([(1, "some text", "xx", None), (None, "more", "yy", None)]))
    assert one.predict("other") == ("xx", 1.0)


def labelled(n, seed):
    r = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        good = " ".join(r.choice(WORDS["en"].split(), r.integers(5, 60))).capitalize() + "."
        bad = [good.upper() + "!!!", "buy " * int(r.integers(5, 60)), good.replace(" ", "### ")][i % 3]
        rows.append((i, good if i % 2 else bad, None, None))
        labels.append((i, i % 2, 0))
    return rows, labels


def test_quality_ranking(spark, docs_of, odd_rows):
    rows, labels = labelled(400, 1)
    docs, marks = docs_of(rows), spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0), (9999, 1, None)], "doc_id long, quality int, toxic int")
    model = quality.learn_from_split(docs, marks)
    out = {r.doc_id: r for r in quality.score(docs, model).collect()}
    held_out = [i for i, _, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([out[i].predicted == i % 2 for i in held_out]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())
    assert quality.score(docs_of(odd_rows), model).count() == len(odd_rows) and quality.score(docs_of([]), model).collect() == []
    empty = {r.score for r in quality.score(docs_of([(1, None, None, None), (2, "", None, None)]), model).collect()}
    assert len(empty) == 1


def test_labels_held_out_teach_nothing(spark, docs_of):
    rows, labels = labelled(300, 2)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    models = [quality.learn_from_split(docs_of(rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, turned)]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].threshold == models[1].threshold


def test_quality_without_both_labels(spark, docs_of):
    rows, labels = labelled(20, 3)
    model = quality.learn(docs_of(rows), spark.createDataFrame([(i, 1, 0) for i, _, _ in labels], "doc_id long, quality int, toxic int"))
    assert {r.predicted for r in quality.score(docs_of(rows), model).collect()} == {1}
