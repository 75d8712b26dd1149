"""Near copies of different sources don't share a bin."""

import random
from collections import defaultdict

from lorequarry.llm import packing, queries


def test_near_copies_of_other_sources_are_kept_apart(spark, tmp_path, odd_rows):
    r, rows = random.Random(3), []
    for g in range(30):
        base = [f"w{r.randrange(10**6)}" for _ in range(60)]
        for k in range(4):
            made = list(base)
            made[30] = f"changed{k}"
            rows.append((g * 4 + k, " ".join(made).upper() if k == 3 else " ".join(made), "en", f"source{k}"))
    odd = [(1000 + (i or 900), t, a, b) for i, t, a, b in odd_rows]
    spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op10_packing(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in out} == {i for i, *_ in [*rows, *odd]}
    bins, of = defaultdict(list), defaultdict(set)
    for p in out:
        bins[p.bin_id].append(p)
        if p.doc_id < 1000:
            of[p.doc_id // 4].add(p.cluster)
    assert all(len(c) == 1 for c in of.values()) and len(set.union(*of.values())) == 30
    assert all(len({p.cluster for p in b}) == len(b) == len({p.source for p in b}) and b[0].bin_words <= packing.CAPACITY for b in bins.values())
