"""Exact top-k inner-product search by norm buckets.

Vectors are ordered by length and cut into buckets, kept as one matrix each. A query first meets
the bucket of the longest vectors; its k-th best product there is a lower bound of its final one.
In any other bucket that bound, divided by the query's and the bucket's greatest length, is the
cosine that a vector must reach. Above one the bucket is skipped. At a high cosine the bucket is
pruned by coordinates (a unit vector that close to the query must lie in an interval in each
of the query's largest coordinates), otherwise by length (only vectors long enough for the bound
remain). What is left is verified with exact integer products.

Queries form blocks, and every block meets every bucket of its dimension that its bounds don't
rule out: a stated query set against all rows, in blocks. Buckets and query blocks are dealt to a
grid of lanes whose sides grow with their numbers, so that a key of the join has about
`cell` pairs of block and bucket and a task holds one of each at a time.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor
do rows without vec_id; only vectors of equal dimension are compared; rows that repeat a vec_id
are all candidates for other ids, and as a query the id is answered once, for the smallest of its
vectors; ties go to the smaller vec_id; products beyond the range of a long are held at its
ends; an empty table gives an empty result; only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.vector import grid
from .common import materialize

BUCKET_ROWS = 4096
QUERY_ROWS = 512
#: Pairs of query block and bucket under a key of the join, about.
CELL = 8
#: The longest buckets go to every task where they have up to so many bytes, one for each dimension.
BROADCAST_BYTES = 64 << 20
#: Queries whose results a task holds (20 results each are 10 MB).
HELD = 32768
#: From this local cosine on, coordinates prune better than lengths.
COORDINATE_COSINE = 0.8
#: Coordinates looked at, the query's largest.
FOCUS = 4
LONG = np.iinfo(np.int64)
EXACT = float(2**53)


def quantized(value: pa.Array, scale: float) -> list[np.ndarray | None]:
    """floor(scale * x) of each vector as 64-bit floats, or None for vectors that take no part."""
    out: list[np.ndarray | None] = []
    for v in value:
        if not v.is_valid:
            out.append(None)
            continue
        x = v.values
        if x.null_count or not len(x):
            out.append(None)
            continue
        x = np.asarray(x.to_numpy(zero_copy_only=False), np.float64)
        with np.errstate(over="ignore"):
            q = np.floor(scale * x)
        out.append(q if np.isfinite(x).all() and np.isfinite(q).all() else None)
    return out


def vectors(rows: DataFrame, scale: float) -> DataFrame:
    """(vec_id, dim, norm, vec): vec holds the quantized components as 64-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(i, q) for i, q in zip(batch.column(0).to_pylist(), quantized(batch.column(1), scale)) if q is not None]
            with np.errstate(over="ignore"):
                norms = [float(np.minimum(np.sqrt(q @ q), 1e300)) for _, q in got]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in got], pa.int64()), pa.array([len(q) for _, q in got], pa.int32()), pa.array(norms, pa.float64()), pa.array([q.tobytes() for _, q in got], pa.binary())],
                ["vec_id", "dim", "norm", "vec"],
            )

    known = rows.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return known.mapInArrow(run, "vec_id long, dim int, norm double, vec binary")


BLOCK = "dim int, high double, low double, n int, ids binary, norms binary, matrix binary"


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows as matrices of up to size vectors of one dimension, in falling order of length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, float, bytes]] = []
        dim = None

        def block() -> pa.RecordBatch:
            norms = [n for _, n, _ in held]
            values = [dim, max(norms), min(norms), len(held), np.array([i for i, _, _ in held], np.int64).tobytes(), np.array(norms).tobytes(), b"".join(v for _, _, v in held)]
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["dim", "high", "low", "n", "ids", "norms", "matrix"])

        for batch in batches:
            for i, d, n, v in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (d != dim or len(held) == size):
                    yield block()
                    held = []
                dim = d
                held.append((i, n, v))
        if held:
            yield block()

    order = [F.col("dim"), F.col("norm").desc(), F.col("vec_id")]
    ordered = rows.select("vec_id", "dim", "norm", "vec").repartitionByRange(*order).sortWithinPartitions(*order, "vec")
    return ordered.mapInArrow(run, BLOCK)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products of rows, as 64-bit integers held at the ends of their range."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    if np.abs(q).max() * np.abs(x).max() * q.shape[1] < EXACT:
        return (q @ x.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in x], object).T
    return np.vectorize(lambda v: min(max(v, LONG.min), LONG.max), otypes=[np.int64])(exact)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to smaller ids."""
    if len(scores) > k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= bound)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def survivors(query: np.ndarray, length: float, bound: float, bucket: np.ndarray, norms: np.ndarray) -> np.ndarray | None:
    """Rows of a bucket that may reach the bound, or None for all of them."""
    if bound <= 0 or length <= 0 or norms[0] <= 0:
        return None
    slack = 1e-9
    cosine = bound / (length * norms[0])
    if cosine > 1 + slack:
        return np.zeros(0, np.int64)
    if cosine >= COORDINATE_COSINE:
        unit = query / length
        angle = np.arccos(min(1.0, cosine))
        alive = np.flatnonzero(norms > 0)
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            # a unit vector within angle of the query is within angle of it along every axis
            axis = np.arccos(np.clip(unit[f], -1, 1))
            x = bucket[alive, f] / norms[alive]
            alive = alive[(x >= np.cos(min(np.pi, axis + angle)) - slack) & (x <= np.cos(max(0.0, axis - angle)) + slack)]
        return alive
    n = int(np.searchsorted(-norms, -(bound / length) * (1 - slack), side="right"))
    return None if n == len(norms) else np.arange(n)


def answers(q_ids, q_norms, q, bounds, x_ids, x_norms, x, k) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query of a block its k best of one bucket that reach its bound: query, ids, scores."""
    whole: list[int] = []
    for i in range(len(q_ids)):
        rows = survivors(q[i], q_norms[i], bounds[i], x, x_norms)
        if rows is None:
            whole.append(i)
        elif len(rows):
            yield i, *chosen(products(q[i : i + 1], x[rows])[0], x_ids[rows], q_ids[i], bounds[i], k)
    if whole:
        for i, scores in zip(whole, products(q[whole], x)):
            yield i, *chosen(scores, x_ids, q_ids[i], bounds[i], k)


def chosen(scores: np.ndarray, ids: np.ndarray, own: int, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = (ids != own) & (scores >= bound)
    scores, ids = scores[keep], ids[keep]
    top = best(scores, ids, k)
    return ids[top], scores[top]


def unpack(ids: bytes, norms: bytes, matrix: bytes, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(norms), np.frombuffer(matrix).reshape(-1, dim)


def exact_top_k(rows: DataFrame, is_query: Column, k: int, scale: float = 64.0, bucket_rows: int = BUCKET_ROWS, query_rows: int = QUERY_ROWS, cell: int = CELL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest products of every query with all other rows (vec_id, embedding)."""
    all_vectors = materialize(vectors(rows, scale), "vectors")
    buckets = materialize(blocks(all_vectors, bucket_rows), "buckets")
    once = all_vectors.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "norm", "vec")).alias("m")).select("vec_id", "m.*")
    queries = blocks(once, query_rows).withColumnsRenamed({"high": "q_high", "low": "q_low", "n": "q_n", "ids": "q_ids", "norms": "q_norms", "matrix": "q_matrix"})

    # one bucket per dimension: the one that begins with the longest vector
    head = F.struct("high", "n", "ids")
    longest = materialize(buckets.groupBy("dim").agg(*[F.max_by(c, head).alias(c) for c in ("ids", "norms", "matrix")]), "longest-buckets")
    size = longest.agg(F.coalesce(F.sum(F.octet_length("matrix")), F.lit(0))).first()[0]
    longest = F.broadcast(longest) if size <= BROADCAST_BYTES else longest

    def first_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                r = one.to_pylist()[0]
                q_ids, q_norms, q = unpack(r["q_ids"], r["q_norms"], r["q_matrix"], r["dim"])
                x_ids, x_norms, x = unpack(r["ids"], r["norms"], r["matrix"], r["dim"])
                bounds = np.full(len(q_ids), -np.inf)
                for i, _, scores in answers(q_ids, q_norms, q, bounds, x_ids, x_norms, x, k):
                    if len(scores) == k:
                        bounds[i] = scores[-1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = np.where(q_norms > 0, bounds / q_norms, -np.inf)
                values = [pa.array([float(least.min())]), pa.array([bounds.tobytes()], pa.binary())]
                kept = [one.column(one.schema.get_field_index(c)) for c in ("dim", "q_ids", "q_norms", "q_matrix")]
                yield pa.RecordBatch.from_arrays([*kept, *values], ["dim", "q_ids", "q_norms", "q_matrix", "least", "bounds"])

    bounded = queries.join(longest, "dim").mapInArrow(first_bounds, "dim int, q_ids binary, q_norms binary, q_matrix binary, least double, bounds binary")
    bounded = materialize(bounded, "query-blocks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of all buckets that a query block meets in this task, with bounds that rise on the way.

        Results of up to HELD queries wait here, those of the block met longest ago leave first.
        """
        waiting: dict[tuple[int, bytes], tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]] = {}

        def leave(key: tuple[int, bytes]) -> Iterator[pa.RecordBatch]:
            q_ids, (_, best_of) = np.frombuffer(key[1], np.int64), waiting.pop(key)
            if best_of:
                columns = [np.concatenate([np.full(len(ids), q_ids[i]) for i, (ids, _) in best_of.items()]), *(np.concatenate([v[c] for v in best_of.values()]) for c in (0, 1))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                key = r["dim"], r["q_ids"]
                bounds, best_of = waiting.pop(key) if key in waiting else (np.frombuffer(r["bounds"]).copy(), {})
                waiting[key] = bounds, best_of
                q_ids, q_norms, q = unpack(r["q_ids"], r["q_norms"], r["q_matrix"], r["dim"])
                x_ids, x_norms, x = unpack(r["ids"], r["norms"], r["matrix"], r["dim"])
                for i, ids, scores in answers(q_ids, q_norms, q, bounds, x_ids, x_norms, x, k):
                    if i in best_of:
                        ids, scores = np.concatenate([best_of[i][0], ids]), np.concatenate([best_of[i][1], scores])
                        top = best(scores, ids, k)
                        ids, scores = ids[top], scores[top]
                    best_of[i] = ids, scores
                    if len(scores) == k:
                        bounds[i] = max(bounds[i], float(scores[-1]))
                while sum(len(b) for b, _ in waiting.values()) > HELD:
                    yield from leave(next(iter(waiting)))
        while waiting:
            yield from leave(next(iter(waiting)))

    q_lanes, x_lanes = grid(bounded.count(), buckets.count(), cell)
    lane = lambda ids, n: F.pmod(F.xxhash64(ids), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = bounded.withColumn("row", lane("q_ids", q_lanes)).withColumn("column", every(x_lanes))
    dealt = buckets.withColumn("column", lane("ids", x_lanes)).withColumn("row", every(q_lanes))
    # a bucket too short for every query of a block isn't even sent to it; Spark takes the copies for as small as the files that they come from
    met = asked.hint("merge").join(dealt, ["dim", "row", "column"]).filter(F.col("high") * (1 + 1e-9) >= F.col("least"))
    found = met.select("dim", "q_ids", "q_norms", "q_matrix", "bounds", "ids", "norms", "matrix").mapInArrow(search, "query_id long, vec_id long, score long")
    # no more than k rows for each query and task
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
