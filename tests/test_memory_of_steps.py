"""What steps leave out: vectors as objects, fingerprints that nobody asked for, parsing where no table can be."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lorequarry.functions import html_ops as H
from lorequarry.llm import near_text
from lorequarry.operators import models


def test_vectors_become_a_column_without_objects():
    """10,000 vectors of 256 floats are 10 MB, not an object for each number."""
    x = np.random.default_rng(0).normal(size=(10_000, 256)).astype(np.float32)
    models.vectors_array(x[:1])  # what is loaded once doesn't count
    tracemalloc.start()
    column = models.vectors_array(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20 and np.array_equal(np.array(column[77].as_py(), np.float32), x[77])


def test_fingerprints_only_where_proposed(spark):
    """op10_packing: near copies without proposals need no fingerprints."""
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")], "doc_id long, text string")
    assert [r.fp for r in near_text.sketches(docs, 5, False).collect()] == [None] * 3
    assert {(r.doc_id, r.component_id) for r in near_text.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_pages_without_tables_are_not_parsed_for_them(monkeypatch):
    """both table repairs leave such a page as it is."""
    monkeypatch.setattr(H, "parse", lambda html: 1 / 0)
    page = "<div><p>a & b<ul><li>x</ul></div>"
    assert H.unwrap_layout_tables(page) == page and H.unwrap_table_divs(page) == page


def test_results_of_a_batch_are_not_objects_at_once():
    """4,000 results of 10 KB are 40 MB of a column, but few of them are strings at a time."""
    values = pa.array(["x"] * 3999 + [None])
    H.applied(str, values[:1], pa.string())
    tracemalloc.start()
    made = H.applied(lambda x: x * 10_000, values, pa.string())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20 and len(made) == 4000 and made[3999].as_py() is None and len(made[3998].as_py()) == 10_000
