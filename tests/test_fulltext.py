"""Stems against published examples, search vectors and phrases against plain loops, the block index against scoring everything."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lorequarry.functions.stemming import STOP_WORDS, stem
from lorequarry.operators import fulltext, impact_index, lexical

#: Words and stems of the published sample vocabulary.
SAMPLE = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consolation consol
consolatory consolatori console consol consolidate consolid consolidating consolid consolingly consol consonant conson consort consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci
conspirator conspir conspiring conspir constable constabl constance constanc constancy constanc knack knack knackeries knackeri knavish knavish kneaded knead kneeling kneel knightly knight
knitted knit knives knive knocker knocker knopp knopp ties tie cries cri gas gas this this gaps gap kiwis kiwi hopped hop hoping hope luxuriated luxuri generate generat generally general
generous generous communication communic arsenal arsenal national nation relational relat replacement replac adoption adopt happy happi say say by by roll roll skies sky dying die news news
inning inning proceed proceed exceed exceed agreed agre feed feed apologist apologist apologies apolog hopefulness hope sensibility sensibl formative format electricity electr
""".split()


@pytest.mark.parametrize(("word", "wanted"), list(zip(SAMPLE[::2], SAMPLE[1::2], strict=True)))
def test_stem(word, wanted):
    assert stem(word) == wanted


def test_any_word_has_a_stem():
    rng = random.Random(3)
    for _ in range(20000):
        word = "".join(rng.choices("aeiouystlnedgi", k=rng.randint(1, 14)))
        assert stem(word) and len(stem(word)) <= len(word) + 1


def plain(text, config):
    found = {}
    for place, word in enumerate(re.findall(r"[^\W_]+", (text or "").lower()), 1):
        if config == "simple":
            found.setdefault(word, []).append(place)
        elif word not in STOP_WORDS:
            found.setdefault(stem(word), []).append(place)
    return found


TEXTS = [
    (1, "The nations are connected: connections of a nation, connecting nations!", "x", 0), (2, None, "x", 0), (3, "", None, 1), (4, "of the and", "x", 1),
    (5, "a rose is a rose is a rose", "x", 2), (6, "Größe 12, naïve 日本 text; 12 12", "x", 3), (7, "rates change. The rate changed again, rates of change", "x", 4),
]


def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string, term string, place int")


@pytest.mark.parametrize("config", fulltext.CONFIGS)
@pytest.mark.parametrize("known", [3, 200_000])
def test_vectors(spark, config, known, monkeypatch):
    monkeypatch.setattr(fulltext, "KNOWN_WORDS", known)
    monkeypatch.setattr(fulltext, "WORDS_AT_ONCE", known)
    rows = {(r.doc_id, r.lexeme): r.positions for r in fulltext.lexemes(docs(spark), ["doc_id", "term", "place"], "text", config).collect()}
    assert rows == {(i, lexeme): places for i, text, _, _ in TEXTS for lexeme, places in plain(text, config).items()}
    with pytest.raises(ValueError, match="no configuration"):
        fulltext.lexemes(docs(spark), ["doc_id"], "text", "klingon")


def brute_phrases(texts, asked, config):
    out = {}
    for q, phrase in asked:
        wanted = sorted((p, w) for w, ps in plain(phrase, config).items() for p in ps)
        for i, text in texts:
            places = {p: w for w, ps in plain(text, config).items() for p in ps}
            starts = sum(all(places.get(s + p - wanted[0][0]) == w for p, w in wanted) for s in places) if wanted else 0
            if starts:
                out[q, i] = starts
    return out


@pytest.mark.parametrize("config", fulltext.CONFIGS)
@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_phrases(spark, config, broadcast, monkeypatch):
    monkeypatch.setattr(fulltext, "BROADCAST_LEXEMES", broadcast)
    monkeypatch.setattr(fulltext, "BROADCAST_PLACES", broadcast)
    rng = random.Random(6)
    vocabulary = ["the", "rate", "rates", "rated", "of", "nation", "nations", "x"]
    texts = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for i in range(60)] + [(99, None)]
    asked = [(q, " ".join(rng.choices(vocabulary, k=rng.randint(0, 4)))) for q in range(40)] + [(77, None), (78, "a rose"), (79, "the of the")]
    index = fulltext.lexemes(spark.createDataFrame(texts, "doc_id long, text string"), ["doc_id"], "text", config)
    ask = fulltext.phrases(spark.createDataFrame(asked, "q long, phrase string"), "phrase", ["q"], config)
    found = {(r.q, r.doc_id): r.starts for r in fulltext.phrase_match(index, ask, ["q"], "doc_id").collect()}
    assert found == brute_phrases(texts, asked, config) and found


def corpus(rng, n):
    """Documents of very different length over words of very different frequency, with repeated texts and gaps."""
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    texts = [" ".join(rng.choices(words, weights, k=rng.choice([1, 5, 20, 80, 300]))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts + texts[:20] + [None, "", "?!"])]


@pytest.mark.parametrize("k", [1, 7, 500])
def test_block_index_equals_scoring_everything(spark, tmp_path, k):
    rng = random.Random(k)
    rows = corpus(rng, 400)
    texts = spark.createDataFrame(rows, "id long, text string")
    asked = [(q, rows[rng.randrange(400)][1]) for q in range(25)] + [(900, None), (901, "unknown words only"), (902, "w0"), (903, "w399 w0 unknown")]
    questions = spark.createDataFrame(asked, "query_id long, text string")
    impact_index.build(texts, str(tmp_path / "index"), block=8)
    index = impact_index.load(spark, str(tmp_path / "index"))
    search = impact_index.Search(index, questions, k)
    top = ["query_id", "id", "score", "rank"]
    found = {tuple(r) for r in search.top().select(top).collect()}
    assert found == {tuple(r) for r in lexical.bm25(questions, texts, k).select(top).collect()} and found
    if k == 1:  # few of the postings are read for the best document alone
        spent = sum(step.agg(F.sum("n")).first()[0] or 0 for step in search.read)
        whole = search.asked.select("query_id", "term").join(index.terms, "term").agg(F.sum("df")).first()[0]
        assert spent < 0.8 * whole


def test_block_index_of_nothing(spark, tmp_path):
    impact_index.build(spark.createDataFrame([(None, "lost")], "id long, text string"), str(tmp_path / "index"))
    index = impact_index.load(spark, str(tmp_path / "index"))
    assert impact_index.bm25(index, spark.createDataFrame([(1, "lost")], "query_id long, text string"), 3).count() == 0
