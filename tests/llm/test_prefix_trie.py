"""The trie against plain dictionaries, the loser tree against sorting, and small limits against large ones."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from lorequarry.llm import prefix_trie
from lorequarry.llm.prefix_trie import KEY, Limits, LoserTree, shared
from lorequarry.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth string, prefix int"
SMALL = Limits(run=7, run_bytes=600, range=9, range_bytes=1 << 20, kids=2, ids=3, spread=5)


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, key, (role, text)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in kids[node])
    out = set()
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if full[c] == node)
        out.add((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie(spark, rows, limits=Limits()):
    found = prefix_trie.prefix_trie(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3), limits).collect()
    made = {tuple(r) for r in found}
    assert len(made) == len(found)
    return made


def talks(rng, n, texts=3, longest=6):
    return [(c, t, rng.choice(["user", "assistant"]) if texts > 2 else "user", rng.choice("abc"[:texts]) * rng.randint(1, 2) + " w") for c in range(n) for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("limits", [Limits(), SMALL], ids=["large", "small"])
@pytest.mark.parametrize("seed", range(3))
def test_random_talks(spark, seed, limits):
    rng = random.Random(seed)
    rows = talks(rng, 90, texts=1 + seed)
    rng.shuffle(rows)
    assert trie(spark, rows, limits) == brute(rows)


def test_copies_over_many_ranges_and_two_folds(spark, monkeypatch):
    """A third of the conversations are copies, and ranges are folded two at a time."""
    monkeypatch.setattr(prefix_trie, "FAN", 2)
    rng = random.Random(9)
    rows = talks(rng, 60, texts=2, longest=4) + [(1000 + c, t, "user", f"the copy {t}") for c in range(40) for t in range(5)]
    assert trie(spark, rows, SMALL) == brute(rows)


def test_parents_by_salted_join(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BROADCAST_PARENTS", 0)
    rows = talks(random.Random(4), 50)
    assert trie(spark, rows, SMALL) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (20, None, None, None), (20, 0, "user", "a"), (20, 0, "user", "a"), (20, 0, "user", None), (21, 5, "", "x" * 100_000), (21, 5, "u", ""),
        (22, 1, "user", "a"), (40, 1, "user", "one two"), (41, 1, "us", "era"), (42, 1, "user", "a"), (None, 1, "user", "lost"), (55, 1, "user", "alone"),
        (-3, 1, "user", "below zero"), (-20, 1, "user", "base"), (45, 3, "é", "𝄞   x\x0by"),
    ]
    assert trie(spark, rows) == brute(rows)
    assert trie(spark, []) == set()
    assert trie(spark, [(None, 1, "user", "lost")]) == set()


def test_deep_talks(spark):
    rows = [(c, t, "user", "same" if t < 300 or c % 2 else f"own {c}") for c in range(6) for t in range(310)]
    assert trie(spark, rows, SMALL) == brute(rows)


def test_loser_tree_sorts_and_looks_at_shared_turns_once():
    rng = random.Random(1)
    talks = [b"".join(bytes([rng.choice(b"abc")]) * KEY for _ in range(rng.randint(0, 5))) for _ in range(400)]
    talks += [b"s" * (KEY * 200) + bytes([i]) * KEY for i in range(100)]
    items = [(t, c) for c, t in enumerate(talks)]
    rng.shuffle(items)
    for k in (1, 2, 3, 5, 8, 13):
        runs = []
        for i in range(k):
            part = sorted(items[i::k])
            runs.append([(0 if j == 0 else shared(part[j - 1][0], t), t, c, []) for j, (t, c) in enumerate(part)])
        tree = LoserTree(runs)
        came = list(tree)
        assert [(t, c) for _, t, c, _ in came] == sorted(items)
        assert all(lcp == shared(a[1], t) for a, (lcp, t, _, _) in zip(came, came[1:], strict=False))
        # each run's shared 200 turns are read once or twice, not at every comparison
        assert tree.compared < 200 * 2 * k + len(items) * 6 * 4
    assert list(LoserTree([])) == []


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = con.sql(ORACLE_SQL["op12_prefix_trie"])
    got = QUERIES["op12_prefix_trie"](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(want.columns).collect()))) == sorted(map(str, want.fetchall()))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in got.collect()} == brute(rows)
