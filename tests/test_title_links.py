"""Title links against comparing everything, with frequent words, equal titles and titles without words."""

import random

import pytest

from lorequarry.operators import maintenance


def similarity(a, b):
    return len(a & b) / len(a | b)


def titles(rng):
    """A few very frequent words, some rare ones, a third of the titles equal."""
    hot, rare = ["guide", "benefits", "manual"], [f"w{i}" for i in range(40)]
    rows = [(i, " ".join({*rng.choices(hot, k=rng.randint(0, 3)), *rng.choices(rare, k=rng.randint(0, 3))})) for i in range(150)]
    rows += [(i, rng.choice(["The same title", "title the SAME!", "same, the title the"])) for i in range(150, 225)]
    return [*rows, (900, None), (901, ""), (902, "?!"), (903, "\u00c9t\u00e9 12"), (904, "12 \u00e9t\u00e9")]


@pytest.mark.parametrize("at_once", [3, 2000])
@pytest.mark.parametrize("threshold", [0.34, 0.5, 0.6, 1.0])
def test_links(spark, monkeypatch, at_once, threshold):
    monkeypatch.setattr(maintenance, "TITLES_AT_ONCE", at_once)
    rows = titles(random.Random(7))
    df = spark.createDataFrame(rows, "id long, title string")
    sets = {i: frozenset((t or "").lower().replace("!", "").replace("?", "").replace(",", "").split()) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and similarity(sets[a], sets[b]) >= threshold}
    found = maintenance.title_links(df, "id", "title", threshold).collect()
    assert len(found) == len(want) and {(r.a, r.b) for r in found} == want
    assert all(abs(r.similarity - similarity(sets[r.a], sets[r.b])) < 1e-6 for r in found)
    members = maintenance.title_classes(df, "id", "title")
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    assert {r.id: r.class_id for r in members.collect()} == {i: first[s] for i, s in sets.items() if s}
    links = maintenance.class_links(members, threshold).collect()
    assert {(r.a, r.b) for r in links} == {(a, b) for a, b in want if first[sets[a]] == a and first[sets[b]] == b and sets[a] != sets[b]} and len(links) == len({(r.a, r.b) for r in links})


def test_nothing_to_link(spark):
    df = spark.createDataFrame([], "id long, title string")
    assert maintenance.title_links(df, "id", "title").count() == 0
