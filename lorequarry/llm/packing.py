"""Conflict-constrained best-fit packing of documents into bins of equal capacity.

Documents are measured in words; those over the capacity are cut into pieces of it. Pieces are
dealt by hash to shards of bounded size (rows that repeat are counted first and then dealt one by one), and each shard is packed by itself: pieces in falling
size, each put into the tightest bin that can take it. Bins stand ordered by residual space; each
carries a bitmap of its sources and one of its duplicate clusters. A piece fits a bin with enough
space that holds neither its source nor its cluster; the successor search goes on from the first
residual of enough space upwards until such a bin is found, or opens a new bin. Clusters are
exact copies, letter case and white space aside, unless they are given (near_clusters makes those of near copies).

A source that holds most documents thus gets one piece per bin, and bins are at least as many as
its pieces. Defined results: every word is placed once, a document without words as one piece of
none; a null source is a source of its own; rows that repeat are placed each; an empty table
gives an empty result; only doc_id, text and source are read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near_text
from .common import materialize, word_count

CAPACITY = 2048
#: Pieces in a shard, on average.
SHARD_PIECES = 5000
#: Rows that repeat are dealt in runs of so many.
RUN = 10_000
#: Bin numbers of a shard leave room for so many bins.
SHARD_BINS = 1 << 24


def same_text(text: Column) -> Column:
    """Cluster key of copies: equal words in equal order, letter case and white space aside."""
    return F.xxhash64(F.regexp_replace(F.lower(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))), r"[\x20\x09-\x0D]+", " "))


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin of each piece; sizes must fall. sources and clusters are bitmaps of one bit, or 0 for what conflicts with nothing."""
    where: list[int] = []
    free: list[int] = []
    held: list[tuple[int, int]] = []
    #: residuals in rising order, and for each its bins with the bits that all of them hold
    residuals: list[int] = []
    bins: dict[int, dict[int, None]] = {}
    common: dict[int, list[int]] = {}

    def put(k: int) -> None:
        r, (s, c) = free[k], held[k]
        if r in bins:
            bins[r][k] = None
            common[r][0] &= s
            common[r][1] &= c
        else:
            insort(residuals, r)
            bins[r], common[r] = {k: None}, [s, c]

    def take(k: int) -> None:
        r = free[k]
        del bins[r][k]
        if not bins[r]:
            del bins[r], common[r], residuals[bisect_left(residuals, r)]

    for size, source, cluster in zip(sizes, sources, clusters):
        found = -1
        for at in range(bisect_left(residuals, size), len(residuals)):
            r = residuals[at]
            s, c = common[r]
            if s & source or c & cluster:
                continue  # every bin of this residual conflicts
            for k in bins[r]:
                s, c = held[k]
                if not (s & source or c & cluster):
                    found = k
                    break
            if found >= 0:
                break
        if found < 0:
            found = len(free)
            free.append(capacity)
            held.append((0, 0))
        else:
            take(found)
        free[found] -= size
        s, c = held[found]
        held[found] = (s | source, c | cluster)
        put(found)
        where.append(found)
    return where


def bits(values: list, lonely: bool) -> list[int]:
    """A bit for each distinct value; without lonely, values that occur once get none."""
    counts: dict = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    number = {v: 1 << i for i, v in enumerate(v for v, n in counts.items() if lonely or n > 1)}
    return [number.get(v, 0) for v in values]


OUT = "bin_id long, slot int, doc_id {0}, piece int, start_word long, n_words long, source string, cluster long, bin_words long"


def row_id() -> Column:
    """64 bits that stand for a document's doc_id and text."""
    return F.xxhash64("doc_id", "text")


def near_clusters(docs: DataFrame) -> DataFrame:
    """(row, cluster, words): for each row_id of docs its component of near copies, and how many words it has."""
    found = near_text.near_duplicates(docs.select(row_id().alias("doc_id"), "text"))
    return found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("cluster"), F.col("n_words").alias("words")).distinct()


def dealt_pieces(docs: DataFrame, capacity: int, cluster: str | DataFrame | None) -> DataFrame:
    """(doc_id, source, cluster, copy, piece, start_word, n_words): copy tells rows that repeat apart."""
    named = [F.col("doc_id"), F.col("source").cast("string").alias("source")]
    if isinstance(cluster, DataFrame):
        sized = docs.select(*named, row_id().alias("row")).join(cluster, "row").select("doc_id", "source", "words", "cluster")
    else:
        sized = docs.select(*named, word_count(F.col("text")).alias("words"), (same_text(F.col("text")) if cluster is None else F.col(cluster).cast("long")).alias("cluster"))
    # a row that repeats without end is dealt out again in runs
    counted = sized.groupBy("doc_id", "source", "words", "cluster").agg(F.count("*").alias("n"))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    runs = runs.repartition("doc_id", "words", "cluster", "run")
    last = F.greatest(F.ceil(F.col("words") / capacity), F.lit(1)).cast("int") - 1
    each = runs.withColumn("copy", F.explode(F.sequence(F.col("run"), F.least(F.col("n"), F.col("run") + RUN) - 1))).withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece").cast("long") * capacity
    return each.select("doc_id", "source", "cluster", "copy", "piece", start.alias("start_word"), F.least(F.col("words") - start, F.lit(capacity)).alias("n_words"))


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, cluster: str | DataFrame | None = None) -> DataFrame:
    """One row per piece: bin_id, slot in the bin, doc_id, piece, start_word, n_words, source, cluster, and the words in the bin.

    cluster, if given, names an integer column of docs or is (row, cluster, words) for every row_id, as near_clusters
    makes it: rows that share a value are of one duplicate cluster.
    """
    pieces = materialize(dealt_pieces(docs, capacity, cluster), "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n_words", "cluster", "copy"), F.lit(shards))).drop("copy")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_words", "descending"), ("source", "ascending"), ("cluster", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sizes = table["n_words"].to_pylist()
        sources, clusters = bits(table["source"].to_pylist(), True), bits(table["cluster"].to_pylist(), False)
        where = best_fit(sizes, sources, clusters, capacity)
        base = table["shard"][0].as_py() * SHARD_BINS if table.num_rows else 0
        filled = [0] * (max(where, default=-1) + 1)
        count, slot = list(filled), []
        for k, n in zip(where, sizes):
            filled[k] += n
            slot.append(count[k])
            count[k] += 1
        return pa.table(
            {
                "bin_id": pa.array([base + k for k in where], pa.int64()), "slot": pa.array(slot, pa.int32()), "doc_id": table["doc_id"], "piece": table["piece"], "start_word": table["start_word"],
                "n_words": table["n_words"], "source": table["source"].cast(pa.string()), "cluster": table["cluster"], "bin_words": pa.array([filled[k] for k in where], pa.int64()),
            }
        )

    return dealt.groupBy("shard").applyInArrow(run, OUT.format(kind))
