import random
from collections import Counter, defaultdict

from lorequarry.llm import packing


def plain(sizes, sources, clusters, capacity):
    """Best fit by looking at every bin; of equally tight bins the one that came to that residual first."""
    free, held, since, clock, where = [], [], [], 0, []
    for size, s, c in zip(sizes, sources, clusters):
        fits = [k for k in range(len(free)) if free[k] >= size and not held[k][0] & s and not held[k][1] & c]
        k = min(fits, key=lambda k: (free[k], since[k])) if fits else len(free)
        if not fits:
            free.append(capacity)
            held.append((0, 0))
            since.append(0)
        clock += 1
        free[k], held[k], since[k] = free[k] - size, (held[k][0] | s, held[k][1] | c), clock
        where.append(k)
    return where


def test_same_bins_as_plain_best_fit():
    r = random.Random(8)
    for _ in range(30):
        n = r.randint(0, 120)
        sizes = sorted((r.randint(0, 50) for _ in range(n)), reverse=True)
        sources = packing.bits([r.choice("aaabcd") for _ in sizes], True)
        clusters = packing.bits([r.choice([1, 1, 2, *range(3, 90)]) for _ in sizes], False)
        assert packing.best_fit(sizes, sources, clusters, 50) == plain(sizes, sources, clusters, 50)


def test_operator(docs_of, odd_rows):
    rows = [*odd_rows, *((1000 + i, " ".join(["copy of", f"text {i % 3}"] + ["w"] * (i % 90)), None, f"s{i % 4}") for i in range(400))]
    out = packing.pack(docs_of(rows), capacity=100, shard_pieces=150).collect()
    words = Counter()
    for i, t, _, _ in rows:
        words[i] += len((t or "").split())
    placed, bins = Counter(), defaultdict(list)
    for p in out:
        placed[p.doc_id] += p.n_words
        bins[p.bin_id].append(p)
        assert 0 <= p.n_words <= 100 and p.start_word == p.piece * 100
    assert placed == words and {i for i, *_ in rows} == set(placed)
    for b in bins.values():
        assert sum(p.n_words for p in b) == b[0].bin_words <= 100
        assert len({p.source for p in b}) == len(b) and len({p.cluster for p in b}) == len(b)
        assert sorted(p.slot for p in b) == list(range(len(b)))
    assert packing.pack(docs_of([])).collect() == []


def test_copies_share_a_cluster(spark):
    df = spark.createDataFrame([("A  b\tC\n",), ("a B c",), ("a b",), (None,), ("",)], "text string")
    a, b, c, d, e = (r[0] for r in df.select(packing.same_text(df.text)).collect())
    assert a == b != c and d == e


def test_equal_rows_are_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN", 100)
    docs = spark.createDataFrame([(7, "one and the same row", "a")] * 3000 + [(1000 + i, f"row {i}", "b") for i in range(300)], "doc_id long, text string, source string")
    out = packing.pack(docs, shard_pieces=500).collect()
    assert sum(p.doc_id == 7 for p in out) == 3000
    shards = Counter(p.bin_id // packing.SHARD_BINS for p in out)
    assert len(shards) == 7 and max(shards.values()) < 700


def test_clusters_of_a_column(spark):
    rows = [(i, "w " * (10 + i % 3), f"s{i}", i % 4, "x") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mine int, cluster string")
    bins = defaultdict(list)
    for p in packing.pack(docs, capacity=100, cluster="mine").collect():
        bins[p.bin_id].append(p)
        assert p.cluster == p.doc_id % 4
    assert all(len({p.cluster for p in b}) == len(b) for b in bins.values())
    assert sum(p.bin_words for b in bins.values() for p in b[:1]) == sum(10 + i % 3 for i in range(40))
    assert len(bins) == 10  # as many as a cluster has documents
