"""The pipeline's near-dedup goes by SimHash fingerprints first: near copies within two bits are found without any min-hash bucket."""

import random

from lorequarry.llm import near_text, simhash


def test_without_buckets(spark, docs_of, monkeypatch):
    r = random.Random(1)
    base = [f"w{r.randrange(5000)}" for _ in range(1500)]
    near, other = " ".join([*base, "end"]), " ".join(f"v{r.randrange(5000)}" for _ in range(1500))
    sets = [near_text.shingles(near_text.words_of(t)) for t in (" ".join(base), near)]
    a, b = map(near_text.fingerprint, sets)
    assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
    rows = [(3, " ".join(base), "en", "a"), (5, near, "en", "a"), (7, other, "en", "a"), (8, None, "en", "a")]
    shared = near_text.shared_buckets
    monkeypatch.setattr(near_text, "shared_buckets", lambda groups: shared(groups).limit(0))
    assert dict(simhash.near_duplicates_at(docs_of(rows)).collect()) == {3: 3, 5: 3, 7: 7, 8: 8}
