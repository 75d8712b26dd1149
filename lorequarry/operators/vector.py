"""Vector search and vector statistics: exact top-k by cosine, drift, guardrail, links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many query vectors of so many bytes go to every task as one matrix (8192 x 1024 floats are 32 MB).
MATRIX_QUERIES, MATRIX_BYTES = 8192, 64 << 20
#: Bytes of blocks of one side that a task holds, about.
HELD_BYTES = 64 << 20
#: Rows of a block where queries and corpus meet block by block.
BLOCK = 2048
#: Pairs of blocks that a task scores at once, about.
BLOCK_PAIRS = 64
#: Scores that a task holds at once.
CELLS = 1 << 21
#: Scores are rounded to this many decimals, so that engines agree on ties.
DIGITS = 6


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, as an expression."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def units(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Positions and unit vectors of a list column's rows by their width; rows without a direction (null, empty, zero, with null or non-finite parts) are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    widths = np.where(column.is_valid().to_numpy(False), pc.fill_null(column.value_lengths(), 0).to_numpy(False), 0)
    flat = column.flatten().cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)  # nulls become NaN
    starts = np.cumsum(widths) - widths
    out = {}
    for width in np.unique(widths[widths > 0]).tolist():
        at = np.flatnonzero(widths == width)
        x = flat[starts[at][:, None] + np.arange(width)]
        most = np.abs(x).max(1)
        keep = np.isfinite(most) & (most > 0)
        x = x[keep] / most[keep, None]
        out[width] = at[keep], x / np.sqrt((x * x).sum(1))[:, None]
    return out


FOUND = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


class Best:
    """The k corpus rows of highest score for each query of a matrix, over any number of corpus matrices; ties go to the smaller id."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int, skip_self: bool):
        self.q_ids, self.q, self.k, self.skip_self = q_ids, q, k, skip_self
        self.bound = np.full(len(q_ids), -np.inf)
        self.found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        step = max(64, CELLS // max(1, len(self.q_ids)))
        slack = 2 * 10.0**-DIGITS  # of what rounding may lift to a bound
        for at in range(0, len(ids) if len(self.q_ids) else 0, step):
            some = ids[at : at + step]
            scores = self.q @ x[at : at + step].T
            if self.skip_self:
                own = np.flatnonzero(np.isin(some, self.q_ids))
                scores[:, own] = np.where(self.q_ids[:, None] == some[own], -np.inf, scores[:, own])
            bound = self.bound
            if len(some) > self.k and np.isneginf(bound).any():
                bound = np.maximum(bound, np.partition(scores, len(some) - self.k, axis=1)[:, len(some) - self.k])
            rows, columns = np.nonzero(scores >= np.maximum(bound - slack, -2)[:, None])
            self.waiting.append((rows, some[columns], np.round(scores[rows, columns], DIGITS) + 0.0))
            self.n_waiting += len(rows)
            if self.n_waiting >= self.k * len(self.q_ids):
                self.settle()

    def settle(self) -> None:
        row, ids, scores = (np.concatenate(c) for c in zip(self.found, *self.waiting))
        order = np.lexsort((ids, -scores, row))
        row, ids, scores = row[order], ids[order], scores[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        self.bound[row[last]] = scores[last]
        keep = place < self.k
        self.found, self.waiting, self.n_waiting = (row[keep], ids[keep], scores[keep]), [], 0

    def rows(self) -> pa.RecordBatch:
        self.settle()
        row, ids, scores = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.q_ids[row]), pa.array(ids), pa.array(scores)], ["query_id", "id", "score"])


def knn(queries: DataFrame, corpus: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the k corpus vectors of highest cosine for every query, ties to the smaller id.

    queries is (query_id, embedding) and corpus (id, embedding); only vectors of equal width meet. A query set of
    bounded size goes to every task as matrices and the corpus isn't shuffled; a larger one meets the corpus
    block by block. Either way a task keeps k rows per query and the global ranking reads those.
    Rows without an id or a direction (null, empty, zero, with null or non-finite parts) take no part.
    """
    queries = queries.select(F.col("query_id").cast("long"), "embedding").filter("query_id is not null and embedding is not null")
    corpus = corpus.select(F.col("id").cast("long"), "embedding").filter("id is not null and embedding is not null")
    head = queries.limit(MATRIX_QUERIES + 1).toArrow()
    if head.num_rows <= MATRIX_QUERIES and head.nbytes <= MATRIX_BYTES:
        ids = head.column(0).to_numpy()
        asked = {width: (ids[at], x) for width, (at, x) in units(head.column(1)).items()}

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {width: Best(*q, k, skip_self) for width, q in asked.items()}
            for batch in batches:
                for width, (at, x) in units(batch.column(1)).items():
                    if width in best:
                        best[width].meet(batch.column(0).to_numpy(zero_copy_only=False)[at], x)
            yield from (b.rows() for b in best.values())

        found = corpus.mapInArrow(local, "query_id long, id long, score double")
    else:
        found = _blockwise(queries, corpus, k, skip_self)
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn_within(queries: DataFrame, corpus: DataFrame, key: str, k: int, skip_self: bool = False) -> DataFrame:
    """As knn, but a query meets the corpus rows of equal key only; of a query with several keys the k best over all of them.

    queries is (query_id, key, embedding) and corpus (id, key, embedding); rows without a key take no part.
    """
    asked = queries.select(F.col("query_id").cast("long"), "embedding", F.col(key).alias("key")).dropna()
    rows = corpus.select(F.col("id").cast("long"), "embedding", F.col(key).alias("key")).dropna()
    return _ranked(_blockwise(asked, rows, k, skip_self), k)


def grid(rows: int, columns: int, cells: int) -> tuple[int, int]:
    """Into how many lanes rows and columns of blocks are dealt, so that a pair of lanes is about `cells` block pairs and least is copied.

    Rows are copied to every lane of columns and columns to every lane of rows.
    """
    rows, columns = max(1, rows), max(1, columns)
    tasks = max(1.0, rows * columns / cells)
    a = min(rows, max(1, round((tasks * rows / columns) ** 0.5)))
    return a, min(columns, max(1, round(tasks / a)))


def _blocks(df: DataFrame, id_column: str) -> DataFrame:
    """(key, width, ids, matrix): the unit vectors of each partition in blocks of up to BLOCK rows of one key and width."""
    kind = df.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        current = None

        def block(width: int) -> pa.RecordBatch:
            ids, x = (np.concatenate(c) for c in zip(*held.pop(width)))
            return pa.RecordBatch.from_arrays([current, pa.array([width], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["key", "width", "ids", "matrix"])

        for batch in batches:
            start = 0
            for end in pc.run_end_encode(batch.column(2)).run_ends.to_pylist():
                own = batch.slice(start, end - start)
                start = end
                if current is not None and current[0] != own.column(2)[0]:  # keys come in order
                    for width in list(held):
                        yield block(width)
                current = own.column(2).slice(0, 1)
                for width, (at, x) in units(own.column(1)).items():
                    ids = own.column(0).to_numpy(zero_copy_only=False)[at]
                    for i in range(0, len(ids), BLOCK):
                        held.setdefault(width, []).append((ids[i : i + BLOCK], x[i : i + BLOCK]))
                        if sum(len(v) for v, _ in held[width]) >= BLOCK:
                            yield block(width)
        for width in list(held):
            yield block(width)

    # in a fixed order, so that a lost task makes the same blocks again
    return df.select(id_column, "embedding", "key").sortWithinPartitions("key", id_column, "embedding").mapInArrow(run, f"key {kind.simpleString()}, width int, ids binary, matrix binary")


def _blockwise(queries: DataFrame, corpus: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """(query_id, id, score): at least the k best of each query, from every pair of lanes of its key's and width's blocks.

    A task has one pair of lanes at a time, each block once, whatever the size of the tables. Rows without a key column are of one key.
    """
    keyed = [df if "key" in df.columns else df.withColumn("key", F.lit(0)) for df in (queries, corpus)]
    counts = [df.groupBy("key").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).agg(F.max("n").alias("n"), F.max("width").alias("width")).first() for df in keyed]
    n_q, n_x = ((c.n or 0) // BLOCK + df.rdd.getNumPartitions() for c, df in zip(counts, keyed))
    block_bytes = 8 * BLOCK * max(1, *(c.width or 0 for c in counts))
    q_lanes, x_lanes = grid(n_q, n_x, max(1, min(BLOCK_PAIRS, HELD_BYTES // block_bytes)))
    lane = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = _blocks(keyed[0], "query_id").select("*", lane(q_lanes).alias("i"), every(x_lanes).alias("j"))
    rows = _blocks(keyed[1], "id").select("*", lane(x_lanes).alias("j"), every(q_lanes).alias("i"))

    def local(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out = [pa.RecordBatch.from_pylist([], FOUND)]
        blocks = [(np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(x.as_buffer()).reshape(len(ids.as_buffer()) // 8, -1)) for ids, x in zip(rows["ids"], rows["matrix"])]
        for q_ids, q in zip(asked["ids"], asked["matrix"]) if blocks else ():
            q_ids = np.frombuffer(q_ids.as_buffer(), np.int64)
            best = Best(q_ids, np.frombuffer(q.as_buffer()).reshape(len(q_ids), -1), k, skip_self)
            for ids, x in blocks:
                best.meet(ids, x)
            out.append(best.rows())
        return pa.Table.from_batches(out, FOUND)

    pairs = [df.groupBy("key", "width", "i", "j") for df in (asked, rows)]
    return pairs[0].cogroup(pairs[1]).applyInArrow(local, "query_id long, id long, score double")


def drift(vectors: DataFrame, group: str) -> DataFrame:
    """Mean and spread of vector lengths by group, for drift alerts."""
    sized = vectors.select(group, norm(F.col("embedding")).alias("length"))
    return sized.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg("length"), 6).alias("mean_length"), F.round(F.var_pop("length"), 6).alias("var_length"))


def guardrail(answers: DataFrame, chunks: DataFrame, key: str, threshold: float) -> DataFrame:
    """Each answer's best cosine with its own retrieved chunks, and whether it is grounded; null where no chunk of its key can be compared."""
    numbered = chunks.select(key, F.monotonically_increasing_id().alias("id"), F.col("chunk_vec").alias("embedding"))
    found = knn_within(answers.select(F.col("answer_id").alias("query_id"), key, F.col("answer_vec").alias("embedding")), numbered, key, 1)
    best = found.groupBy(F.col("query_id").alias("answer_id")).agg(F.max("score").alias("best"))
    met = answers.join(chunks.select(key).distinct(), key, "left_semi").select("answer_id").distinct()
    return met.join(best, "answer_id", "left").select("answer_id", "best").withColumn("grounded", F.col("best") >= threshold)


def probe_drift(before: DataFrame, now: DataFrame, key: str, limit: float = 0.99) -> DataFrame:
    """One row on a probe set (key, embedding) embedded twice: probes, mean and least cosine, and how many moved below the limit."""
    both = before.select(key, F.col("embedding").alias("a")).join(now.select(key, F.col("embedding").alias("b")), key)
    moved = both.select(F.round(cosine(F.col("a"), F.col("b")), DIGITS).alias("cos"))
    return moved.agg(F.count("*").alias("n"), F.round(F.avg("cos"), DIGITS).alias("mean"), F.min("cos").alias("least"), F.count_if(F.col("cos") < limit).alias("moved"))
