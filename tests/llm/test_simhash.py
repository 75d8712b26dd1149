import random
import re

import pytest
import xxhash

from lorequarry.llm import simhash


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> i & 1 for h in hashes) > len(hashes)) << i for i in range(64))


def brute_components(prints, bits=2):
    ids = list(prints)
    parent = {i: i for i in ids}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def test_fingerprints():
    r = random.Random(2)
    for n in (0, 1, 2, 3, 4, 50):
        text = " ".join(r.choice(["Ab", "cÉ", "the", "x y"]) for _ in range(n))
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \t\n") == 0


@pytest.mark.parametrize(("crowded", "bits"), [(10**6, 2), (3, 2), (3, 1), (0, 2), (0, 0)])
def test_links_have_the_components_of_all_pairs(spark, crowded, bits):
    r = random.Random(4)
    prints = set()
    for _ in range(12):
        center = r.getrandbits(64)
        prints.add(center)
        for _ in range(25):
            x = center
            for _ in range(r.randint(1, 4)):
                x ^= 1 << r.randrange(64)
            prints.add(x)
    prints |= {0, (1 << 64) - 1, 1, 1 << 63}
    signed = {simhash.signed(p): p for p in prints}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    links = simhash.near_links(df, bits, crowded).collect()
    assert all((signed[x.a] ^ signed[x.b]).bit_count() <= bits for x in links)
    parts = {r.node: r.component for r in simhash.connected_components(simhash.near_links(df, bits, crowded), "a", "b").collect()}
    expected = brute_components(dict(sorted(signed.items())), bits)
    assert {s: parts.get(s, s) for s in signed} == expected


def test_operator(spark, docs_of, odd_rows, sf_dir):
    rows = [(r.doc_id, r.text, None, None) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(100_000 + (i or 900), t, a, b) for i, t, a, b in odd_rows]
    out = simhash.near_duplicates(docs_of(rows)).collect()
    assert len(out) == len(rows)
    prints = {i: brute_fingerprint(t) for i, t, _, _ in rows}
    assert {r.doc_id: r.fp for r in out} == {i: simhash.signed(p) for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in out} == brute_components(prints)
    assert simhash.near_duplicates(docs_of([])).collect() == []
    assert simhash.near_duplicates(docs_of([(None, "a", None, None)])).collect()[0].component_id is None
