import random

from lorequarry.llm import line_dedup


def distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
    return a == b or a[p + 1 :] == b[p + 1 :] or a[p:] == b[p + 1 :] or a[p + 1 :] == b[p:]


def brute(rows, min_chars):
    places = sorted((i, k, x.strip(" \t\r")) for i, t in set(rows) if i is not None and t is not None for k, x in enumerate(t.split("\n")) if x.strip(" \t\r"))

    def copy(x, y):
        return x == y or (min(len(x), len(y)) >= min_chars and distance_at_most_one(x, y))

    drop = {(i, k) for at, (i, k, x) in enumerate(places) if any(copy(x, y) and (j, m) < (i, k) for j, m, y in places[:at])}
    out = []
    for i, t in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for k, x in enumerate(lines) if i is None or (i, k) not in drop]
        out.append((i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(docs, **more):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs, **more).collect()), key=str)


def test_against_all_pairs(docs_of):
    r = random.Random(6)
    base = ["".join(r.choice("abé ") for _ in range(r.randint(4, 40))) for _ in range(30)]

    def edited(x):
        k, at, c = r.randint(0, 3), r.randrange(len(x) + 1), r.choice("abéz")
        return [x, x[:at] + c + x[at:], x[:at] + x[at + 1 :], x[:at] + c + x[at + 1 :]][k]

    rows = [(i, "\n".join(edited(edited(r.choice(base))) if r.random() < 0.9 else r.choice(["", " ", "\t"]) for _ in range(r.randint(1, 8)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (None, base[0]), (203, "x" * 50_000), (204, "x" * 49_999 + "y"), (203, "x" * 50_000)]
    for min_chars, blocks in ((1, 4), (5, 2), (5, 4), (9, 3)):
        assert run(docs_of([(i, t, None, None) for i, t in rows]), min_chars=min_chars, blocks=blocks) == brute(rows, min_chars)


def rows_written(monkeypatch):
    """The rows of every table that the operator stores, by name."""
    seen, write = {}, line_dedup.materialize

    def spy(df, name):
        stored = write(df, name)
        seen[name] = stored.count()
        return stored

    monkeypatch.setattr(line_dedup, "materialize", spy)
    return seen


def test_a_template_with_many_lines(docs_of, monkeypatch):
    rows = [(i, f"This very common line of a template says that item {i * 7919 % 9000:04d} was sold") for i in range(1500)]
    seen = rows_written(monkeypatch)
    assert run(docs_of([(i, t, None, None) for i, t in rows])) == brute(rows, line_dedup.MIN_CHARS)
    assert seen["line-pairs"] <= 4 * len(rows) and max(seen.values()) <= 30 * len(rows)  # all pairs would be 750 for each


def test_lines_that_differ_by_one_sign(docs_of, monkeypatch):
    line = "A passage that stands in thousands of documents, but for the sign {} in its middle, is written once."
    rows = [(i, line.format(chr(0x4E00 + i))) for i in range(2000)] + [(3000, line.format("")), (3001, line.format("ab"))]
    seen = rows_written(monkeypatch)
    got = run(docs_of([(i, t, None, None) for i, t in rows]))
    # the last line is two edits from all but the one without a sign, of which it is two as well
    assert [r[0] for r in got if r[3] == 0] == [0, 3001]
    assert seen["line-pairs"] <= 2 * len(rows) and max(seen.values()) <= 30 * len(rows)


def test_a_frequent_line_and_columns_with_names_of_our_own(spark):
    rows = [(i if i % 5 else None, f"read more\nonly {i} here {i * i}", i, -i, "x", 1.5) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _drops int, _doc int, `drops` string, `a.b c` double")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    want = {i: (t, a, b) for i, (_, t, a, b, _, _) in enumerate(rows)}
    for r in out.collect():
        text, a, b = want[r["_drops"]]
        assert (r["_drops"], r["_doc"], r["a.b c"]) == (a, b, 1.5)
        assert r["text"] == (text if r["doc_id"] in (None, 1) else text.split("\n")[1])


def test_documents_pass_whole(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"] and out.count() == len(odd_rows)
    assert run(docs) == brute([(i, t) for i, t, _, _ in odd_rows], line_dedup.MIN_CHARS)
    assert run(docs_of([])) == []


def test_large_lookups_take_the_other_join(docs_of, odd_rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_IDS", 0)
    assert run(docs_of(odd_rows)) == brute([(i, t) for i, t, _, _ in odd_rows], line_dedup.MIN_CHARS)
