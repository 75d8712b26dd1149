"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Unit vectors are turned by their principal axes and by a rotation learned to bring them close to
the corners of the cube (iterative quantisation), and kept as sign bits. They aren't centred, as
then the chance that a bit differs follows the angle, which the bound is on. Several such
codes, each from another random start, are cut into substrings; every substring is a table, and
vectors with equal substrings are retrieved together. What is retrieved is reranked with the
original vectors: a pair links when its cosine, in double precision, reaches the bound. A pair
that meets in several tables counts in the first of them.

Equal vectors of a label are one class from the start, so copies are never compared with each
other. Buckets are counted on ids alone; vectors follow only into buckets that classes share. Buckets with many classes are cut by
hash into parts of bounded size, and each pair of parts is a key of its own and so a task's unit of work: it reports how
many links each class has there and pairs that keep the parts' components together (a spanning forest), never all pairs.

The rotations are fitted on a bounded sample (`sample` vectors, by a hash of vec_id); every
vector is coded and looked up. Whether a pair at the bound is retrieved is a matter of chance. The
number of tables is chosen so that a pair at the bound, whose bits agree with probability p = 1 - angle / pi each,
meets in none of them once in `1 / MISS` cases: (1 - p ** width) ** tables. At cosine 0.93 and a width of 12 bits these
are 25 tables, whatever the dimension; short vectors get them from more rotations. The width
grows with the largest label, so that a bucket of unrelated vectors stays about as large.

Defined results: a null label, and a vector that is null, empty, zero or holds a null or
non-finite component, links with nothing and is a component of its own; only vectors of equal
dimension link; rows that repeat are vectors of their own; an empty table gives an empty result;
only vec_id, label and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

BITS = 64
#: Widths of a table's keys.
SUBSTRING, WIDEST = 12, 24
#: Share of the pairs at the bound that may meet in no table.
MISS = 1 / 400
#: Unrelated vectors of a label in a bucket, about, before keys get wider.
BUCKET = 32
SAMPLE = 8192
#: Classes in a part of a bucket, about.
PART = 512


def fit_rotation(x: np.ndarray, bits: int, seed: int, rounds: int = 40) -> np.ndarray:
    """Projection for codes of so many bits, learned by iterative quantisation of unit vectors x."""
    dim = x.shape[1]
    draw = np.random.default_rng(seed)
    learned = len(x) > bits
    axes = np.linalg.svd(x, full_matrices=False)[2] if learned and len(x) >= dim else np.linalg.qr(draw.normal(size=(dim, dim)))[0]
    axes = axes[:bits].T
    turn = np.linalg.qr(draw.normal(size=(bits, bits)))[0]
    v = x @ axes
    for _ in range(rounds if learned else 0):
        u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return axes @ turn


def vector_of(value: pa.Scalar) -> np.ndarray | None:
    """A vector in double precision, or None if it can't link."""
    if not value.is_valid or value.values.null_count or not len(value.values):
        return None
    x = np.asarray(value.values.to_numpy(zero_copy_only=False), np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(-1, keepdims=True)  # lengths can't overflow or vanish
    return x / np.sqrt((x * x).sum(-1, keepdims=True))


def tables_for(bound: float, width: int, miss: float = MISS) -> int:
    """How many tables of so many bits a pair at the bound needs."""
    agree = 1 - np.arccos(np.clip(bound, -1, 1)) / np.pi
    met = min(1 - 1e-12, agree**width)
    return max(1, int(np.ceil(np.log(miss) / np.log1p(-met))))


class Coder:
    """Sign codes of vectors by dimension, cut into substrings: tables_for(bound, substring) of them."""

    def __init__(self, sample: dict[int, np.ndarray], bound: float, bits: int = BITS, substring: int = SUBSTRING):
        if not 0 < substring <= 30:
            raise ValueError("substrings of more than 30 bits don't fit their keys")
        self.bits, self.substring, self.bound = bits, substring, bound
        self.fitted = {dim: self.fit(x) for dim, x in sample.items()}

    def fit(self, x: np.ndarray) -> list[np.ndarray]:
        """The projection of each table."""
        bits = min(self.bits, x.shape[1])
        width = min(self.substring, bits)
        tables, out, seed = tables_for(self.bound, width), [], 0
        while len(out) < tables:
            p = fit_rotation(x, bits, seed)
            out += [p[:, at : at + width] for at in range(0, bits - width + 1, width)]
            seed += 1
        return out[:tables]

    def substrings(self, x: np.ndarray) -> np.ndarray:
        """One row of table keys for each unit vector of x."""
        fitted = self.fitted.get(x.shape[1]) or self.fit(np.zeros((0, x.shape[1])))
        return np.stack([(x @ p >= 0) @ (1 << np.arange(p.shape[1])) for p in fitted], 1).astype(np.int32)


def learn(rows: DataFrame, bound: float, bits: int = BITS, substring: int = SUBSTRING, sample: int = SAMPLE, bucket: int = BUCKET) -> Coder:
    """A coder for the bound, fitted on at most `sample` vectors; keys of `substring` bits or more for a large label."""
    usable = rows.filter("label is not null and embedding is not null").select("vec_id", "label", "embedding")
    n, most = usable.groupBy("label").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    near = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < int(3 * sample * (1 << 40) / max(1, n))
    picked = usable.filter(near).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select(F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))

    by_dim: dict[int, list[np.ndarray]] = {}
    for value in picked.toArrow().column(0):
        x = vector_of(value)
        if x is not None:
            by_dim.setdefault(len(x), []).append(unit(x))
    width = max(substring, min(WIDEST, (most // bucket).bit_length()))
    return Coder({d: np.array(v) for d, v in by_dim.items()}, bound, bits, width)


def coded(classes: DataFrame, coder: Coder) -> DataFrame:
    """(rep, copies, label, dim, vec, keys) of the classes that can link; vec holds the components as they came."""
    kind = classes.schema["label"].dataType.simpleString()
    width = width_of(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: dict[int, list] = {}
            for at, value in enumerate(batch.column(3)):
                x = vector_of(value)
                if x is not None:
                    got.setdefault(len(x), []).append((at, x))
            for dim, rows in got.items():
                at = pa.array([i for i, _ in rows], pa.int64())
                x = np.array([v for _, v in rows])
                keys = coder.substrings(unit(x))
                kept = [batch.column(i).take(at) for i in range(3)]
                more = [pa.array([dim] * len(rows), pa.int32()), pa.array([v.astype(width).tobytes() for v in x], pa.binary()), pa.array(list(keys), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*kept, *more], ["rep", "copies", "label", "dim", "vec", "keys"])

    return classes.select("rep", "copies", "label", "embedding").mapInArrow(run, f"rep long, copies long, label {kind}, dim int, vec binary, keys array<int>")


def width_of(classes: DataFrame) -> str:
    """How vectors are packed: single precision only where they came so."""
    return "f4" if classes.schema["embedding"].dataType.elementType.simpleString() == "float" else "f8"


def matrices(rows: pa.StructArray, dim: int, width: str) -> tuple[np.ndarray, ...]:
    """Parts, ids, copies, unit vectors and keys of rows of one dimension."""
    n = len(rows)
    x = np.frombuffer(b"".join(rows.field("vec").to_pylist()), width).astype(np.float64).reshape(n, dim)
    keys = rows.field("keys").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return (*(rows.field(c).to_numpy(zero_copy_only=False) for c in ("part", "rep", "copies")), unit(x), keys)


def units_of_work(batch: pa.RecordBatch, width: str) -> Iterator[tuple[int, tuple, tuple]]:
    """(table, a, b) for each row (dim, table, low, high, rows) of a batch: two parts, or one twice, as ids, copies, unit vectors and keys."""
    dims, tables, lows, highs = (batch.column(i).to_numpy() for i in range(4))
    lists = batch.column(4)
    sizes, flat = lists.value_lengths().to_numpy(), lists.flatten()
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(dims).tolist():
        own = np.flatnonzero(dims == dim)
        at = np.cumsum(sizes[own]) - sizes[own]
        some = flat if len(own) == len(dims) else flat.take(pa.array(np.repeat(starts[own] - at, sizes[own]) + np.arange(sizes[own].sum())))
        part, *columns = matrices(some, dim, width)
        for i, start, n in zip(own.tolist(), at.tolist(), sizes[own].tolist()):
            rows = tuple(c[start : start + n] for c in columns)
            if lows[i] == highs[i]:
                yield int(tables[i]), rows, rows
            else:
                low = part[start : start + n] == lows[i]
                yield int(tables[i]), tuple(c[low] for c in rows), tuple(c[~low] for c in rows)


def linked(a, b, table: int, bound: float) -> np.ndarray:
    """Which pairs of two parts (or of one with itself, the upper half) link and meet in no earlier table."""
    (_, _, x, kx), (_, _, y, ky) = a, b
    close = x @ y.T >= bound
    if a is b:
        close &= np.tri(len(x), k=-1, dtype=bool).T
    if close.any():
        for t in range(table):
            close &= kx[:, t, None] != ky[None, :, t]
    return close


def forest(close: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Pairs of positions (columns count on from the rows unless they are the same) that keep the components of a link matrix.

    A search over whole rows at a time: each new vertex is joined to its component's first.
    """
    n = len(close)
    m = n if same else n + close.shape[1]
    seen = np.zeros(m, bool)
    out = []
    for start in np.flatnonzero(close.any(1)).tolist():
        if seen[start]:
            continue
        seen[start] = True
        edge = np.array([start])
        while len(edge):
            near = np.zeros(m, bool)
            rows = edge[edge < n]
            if same:
                near |= close[rows].any(0) | close[:, rows].any(1)
            else:
                near[n:] |= close[rows].any(0)
                near[:n] |= close[:, edge[edge >= n] - n].any(1)
            edge = np.flatnonzero(near & ~seen)
            seen[edge] = True
            out += [(start, v) for v in edge.tolist()]
    return out


def in_buckets(codes: DataFrame, part: int) -> DataFrame:
    """(rep, label, dim, table, key, part, parts): where each class stands in the buckets that it shares."""
    hits = codes.select("rep", "label", "dim", F.posexplode("keys").alias("table", "key"))
    bucket = ["label", "dim", "table", "key"]
    sizes = hits.groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / part).cast("int")
    # Spark takes exploded rows for as small as the files that they come from and would broadcast them
    return hits.hint("merge").join(sizes, bucket).select("rep", *bucket, F.pmod(F.xxhash64("rep", "table"), parts).cast("int").alias("part"), parts.alias("parts"))


def link_counts(codes: DataFrame, bound: float, part: int, width: str) -> DataFrame:
    """(rep, other, links): for each unit of work the links of a class (other null), and pairs that keep the components (links null)."""
    hits = materialize(in_buckets(codes, part), "vector-buckets")
    # a part meets itself and every other part of its bucket, each pair of parts under a key of its own
    met = hits.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = met.hint("merge").join(codes.select("rep", "copies", "vec", "keys"), "rep")
    unit_of_work = ["label", "dim", "table", "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")]
    work = rows.groupBy(*unit_of_work).agg(F.collect_list(F.struct("part", "rep", "copies", "vec", "keys")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table, a, b in units_of_work(batch, width):
                close = linked(a, b, table, bound)
                if not close.any():
                    continue
                at, of_a, of_b = (a[0] if b is a else np.concatenate([a[0], b[0]])), close @ b[1], a[1] @ close
                links = of_a + of_b if b is a else np.concatenate([of_a, of_b])
                who = np.flatnonzero(links)
                edges = np.array(forest(close, b is a))
                n, m = len(who), len(edges)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([at[who], at[edges[:, 0]]])), pa.array([None] * n + at[edges[:, 1]].tolist(), pa.int64()), pa.array(links[who].tolist() + [None] * m, pa.int64())],
                    ["rep", "other", "links"],
                )

    return work.select("dim", "table", "low", "high", "rows").mapInArrow(run, "rep long, other long, links long")


def near_duplicates(rows: DataFrame, bound: float = 0.93, coder: Coder | None = None, part: int = PART) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, label, embedding)."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    coder = coder or learn(rows, bound)
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    marked = rows.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("vec", F.when(F.col("usable"), F.col("embedding")))
    known = marked.filter("usable")
    classes = materialize(known.groupBy("label", F.col("vec").alias("embedding")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vector-classes")
    codes = materialize(coded(classes, coder), "vector-codes")
    found = materialize(link_counts(codes, bound, part, width_of(classes)), "vector-links")
    counts = found.filter("links is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("other is not null").select("rep", "other"), "rep", "other")
    facts = classes.select("rep", "copies", "label", F.col("embedding").alias("vec")).join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    facts = facts.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linking = known.select("vec_id", "label", "vec").join(facts, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = marked.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linking.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
