import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lorequarry.llm import mixing


def water(sizes, weights=(1, 2, 3), cap=3):
    """Targets by sharing out, round after round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, fixed = {}, set()
    while True:
        left = sum(sizes.values()) - sum(target[s] for s in fixed)
        free = [s for s in names if s not in fixed]
        for s in free:
            target[s] = left * weight[s] / sum(weight[f] for f in free)
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            return target
        for s in over:
            target[s] = cap * sizes[s]
        fixed |= over


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows_of(n=300):
    sources = ["b", "a", None, "", "é", "Z", "tiny"]
    out = []
    for i in range(n):
        s = "b" if i % 3 == 0 else sources[i % 6]
        out.append((i, " ".join(f"w{i}x{k}" for k in range(i * 7 % 60)) or (None if i % 2 else ""), None, s))
    return [*out, (1000, "one two three", None, "tiny"), (7, "a repeated id", None, "a"), (7, "a repeated id", None, "a"), (None, "no id at all", None, "a"), (1001, "long " * 30_000, None, "Z")]


def test_targets_and_draws(docs_of):
    rows = rows_of()
    made = mixing.mix(docs_of(rows), shards=8, blocks_per_shard=4)
    docs, draws = made.documents.collect(), made.draws.collect()
    assert len(docs) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    expected = water(sizes)
    size = {(d.doc_id, d.copy): d.size for d in docs}
    source = {(d.doc_id, d.copy): d.source for d in docs}
    taken, by_source = Counter(), Counter()
    for d in draws:
        taken[d.doc_id, d.copy] += d.words
        by_source[source[d.doc_id, d.copy]] += d.words
        assert 0 < d.words <= size[d.doc_id, d.copy] and 0 <= d.shard < 8
    for d in docs:
        assert d.source_size == sizes[d.source] and abs(d.target - expected[d.source]) < 1e-6
    for s in sizes:
        assert abs(by_source[s] - expected[s]) <= 0.5
    assert all(n <= 3 * size[k] for k, n in taken.items())
    assert len({(d.doc_id, d.copy, d.epoch) for d in draws}) == len(draws)
    again = mixing.mix(docs_of(rows[::-1]), shards=8, blocks_per_shard=4).draws
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, draws))


def test_tree_deals_exact_quotas(spark):
    quotas = {"a": 50, None: 31, "c": 1, "d": 80}
    out = mixing.split_tree(spark.createDataFrame(list(quotas.items()), "source string, blocks long"), 8, "s").collect()
    per_shard = Counter()
    for s, n in quotas.items():
        turns = sorted(t for r in out if r.source == s for t in range(r.low, r.high + 1))
        assert turns == list(range(1, n + 1))
    for r in out:
        per_shard[r.shard] += r.high - r.low + 1
    assert max(per_shard.values()) - min(per_shard.values()) <= 3


def test_tree_halves_follow_the_law(spark):
    """Counts of one source in a half of the slots: mean and spread of the hypergeometric distribution."""
    quotas = spark.createDataFrame([("a", 30), ("b", 70)], "source string, blocks long")
    tries = [mixing.split_tree(quotas, 2, f"seed {i}").filter("source = 'a' and shard = 0").select((F.col("high") - F.col("low") + 1).alias("n")) for i in range(60)]
    counts = [tries[0]]
    for t in tries[1:]:
        counts[0] = counts[0].unionByName(t)
    n = [r.n for r in counts[0].collect()]
    mean = sum(n) / len(n)
    spread = sum((x - mean) ** 2 for x in n) / len(n)
    assert abs(mean - 15) < 1.5 and 2 < spread < 11  # 15 and 5.3


def test_mixed_documents(docs_of):
    rows = rows_of()
    docs = docs_of(rows)
    made = mixing.mix(docs, shards=4, blocks_per_shard=4)
    out = mixing.mixed_documents(docs, made)
    assert out.columns == docs.columns
    got = out.collect()
    assert sum(len(words(r.text)) for r in got) == made.draws.agg(F.sum("words")).first()[0]
    full = defaultdict(list)
    for i, t, _, _ in rows:
        full[i].append(t)
    assert all(any(t and t.startswith(r.text) for t in full[r.doc_id]) for r in got)


def test_empty(docs_of):
    for rows in ([], [(1, None, None, None), (2, "", None, "a")]):
        made = mixing.mix(docs_of(rows))
        assert made.draws.collect() == [] and made.documents.count() == len(rows)
        assert mixing.mixed_documents(docs_of(rows), made).count() == 0


def test_shards_and_slices_follow_the_words(docs_of, monkeypatch):
    assert [mixing.shards_for(n << 28) for n in (0, 1, 64, 65, 128, 129, 60_000)] == [64, 64, 64, 128, 128, 256, 65536]
    monkeypatch.setattr(mixing, "SLICE_WORDS", 500)
    docs = docs_of(rows_of())
    made = mixing.mix(docs, shards=4, blocks_per_shard=4)
    out = mixing.mixed_documents(docs, made)
    assert made.slices > 5 and sum(len(words(r.text)) for r in out.collect()) == made.draws.agg(F.sum("words")).first()[0]


def test_the_tree_deals_what_is_taken(spark, docs_of):
    """Many sources: words by shard add up to what is taken, shards are even in blocks, and each source keeps its quota."""
    rows = [(i, "w " * (i % 37 + 1), None, f"host{i % 400:03d}") for i in range(2000)]
    made = mixing.mix(docs_of(rows), shards=8, blocks_per_shard=64)
    whole = {(d.doc_id, d.copy): d for d in made.documents.collect()}
    by_source = Counter()
    for r in mixing.taken_by_shard(made).collect():
        assert r.taken == sum(s.words for s in r.shards) and [s.shard for s in r.shards] == sorted({s.shard for s in r.shards})
        by_source[whole[r.doc_id, r.copy].source] += r.taken
    for d in whole.values():
        assert abs(by_source[d.source] - d.target) <= 0.5
    assert {r.shard for r in made.draws.select("shard").distinct().collect()} == set(range(8))


def test_query_equals_sql(spark, sf_dir):
    import duckdb

    from lorequarry.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op9_mixing"])
    got = QUERIES["op9_mixing"](spark, sf_dir)
    plain = lambda rows: sorted(str(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.select(want.columns).collect()) == plain(want.fetchall())
