"""SimHash fingerprints and their near-duplicate components.

Fingerprints are embedded as the bit counts of their segments. Each differing bit moves one count
by at most one, so the Manhattan distance of two embeddings is a lower bound of the Hamming
distance. Fingerprints are placed on the grid of those counts: two points at most t apart share a
grid cell when one of them registers in the cells within ceil(t/2) of it and the other in those
within floor(t/2). Fingerprints that meet in a cell are verified bit by bit.

Cells crowded with fingerprints (a large group of near copies) aren't joined: there the
embedding is refined to one-bit segments, where two fingerprints within two bits of each other
share a cell of radius one and any two that share one are that close, so that every fingerprint
links to the smallest of its cell and no pairs are listed.

Defined results: a null or wordless text has fingerprint zero and links like any other; fewer
words than a shingle make one shingle of the whole sequence; equal texts always link; equal rows
give equal rows; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near_text
from .common import connected_components, materialize

#: Segments of four bits: 16 counts from 0 to 4, kept in three bits each.
SEGMENTS, SEGMENT_BITS = 16, 4
#: More fingerprints than this in a cell are linked by refinement instead of by the join.
CROWDED = 256
SEED = 42
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """SimHash of a whole text over its word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle_words + 1
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    first, last = starts[:n].tolist(), ends[shingle_words - 1 :].tolist()
    for at in range(0, n, CHUNK):
        hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(first[at : at + CHUNK], last[at : at + CHUNK])), np.uint64)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), shingle_words) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def segment_count(fp: Column, i: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, SEGMENT_BITS * i).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)))


def cells(fp: Column) -> Column:
    """The grid cells within Manhattan distance one of a fingerprint's counts, each as one long."""
    counts = [segment_count(fp, i).cast("long") for i in range(SEGMENTS)]
    home = sum((F.shiftleft(c, 3 * i) for i, c in enumerate(counts)), F.lit(0).cast("long"))
    up = [F.when(c < SEGMENT_BITS, home + F.lit(1 << 3 * i)) for i, c in enumerate(counts)]
    down = [F.when(c > 0, home - F.lit(1 << 3 * i)) for i, c in enumerate(counts)]
    return F.array_compact(F.array(home, *up, *down))


def near_links(prints: DataFrame, max_bits: int = 2, crowded: int = CROWDED) -> DataFrame:
    """(a, b) links of distinct fingerprints (column fp) whose components are those of all pairs within max_bits.

    Outside crowded cells these are all the pairs; in crowded ones, stars with the same components.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the grid registers both sides at radius one, which holds up to two bits")
    placed = prints.select("fp", F.explode(cells(F.col("fp"))).alias("cell"))
    busy = materialize(placed.groupBy("cell").count().filter(F.col("count") > crowded).select("cell"), "crowded-cells")
    if busy.isEmpty():
        return cell_pairs(placed, max_bits)
    dense = placed.join(busy, "cell", "left_semi").select("fp").distinct()
    return cell_pairs(placed.join(busy, "cell", "left_anti"), max_bits).unionByName(stars(dense, max_bits))


def cell_pairs(placed: DataFrame, max_bits: int) -> DataFrame:
    """All pairs of fingerprints that meet in a cell and differ in max_bits or fewer."""
    # Spark takes the exploded cells for as small as the fingerprints' file and would broadcast them
    a, b = placed.select(F.col("fp").alias("a"), "cell").hint("merge"), placed.select(F.col("fp").alias("b"), "cell")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return a.join(b, "cell").filter((F.col("a") < F.col("b")) & near).select("a", "b")


def stars(prints: DataFrame, max_bits: int) -> DataFrame:
    """Links with the components of all pairs within max_bits, by one-bit segments.

    Within two bits fingerprints share a point one bit from both, and link to its smallest;
    within one bit one of them is the other's point; within none there are no two.
    """
    if max_bits == 0:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    points = [F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)]
    if max_bits == 1:
        other = prints.select(F.explode(F.array(*points)).alias("a"), F.col("fp").alias("b"))
        return other.hint("merge").join(prints.select(F.col("fp").alias("a")), "a", "left_semi")
    spread = prints.select("fp", F.explode(F.array(F.col("fp"), *points)).alias("point"))
    low = spread.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).filter("a <> top").select("point", "a")
    return spread.hint("merge").join(low, "point").filter("a <> fp").select("a", F.col("fp").alias("b"))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_duplicates(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of max_bits or fewer differing bits."""
    prints = materialize(fingerprints(docs, shingle_words), "simhash")
    groups = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-groups")
    parts = connected_components(near_links(groups.select("fp"), max_bits), "a", "b")
    members = parts.join(groups.withColumnRenamed("fp", "node"), "node")
    roots = members.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = members.join(roots, "component").select(F.col("node").alias("fp"), "component_id")
    labels = groups.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def near_duplicates_at(docs: DataFrame, similarity: float = near_text.SIMILARITY, shingle_words: int = near_text.SHINGLE_WORDS) -> DataFrame:
    """(doc_id, component_id): the smallest doc_id reachable over pairs of texts whose shingle sets have the similarity or more.

    Fingerprints of the shingle sets within two bits propose pairs, and whole sets verify them. Pairs of the similarity whose
    fingerprints lie further apart (see near_text) are found by min-hashes, among sets that aren't in one component yet.
    """
    return near_text.near_duplicates(docs, shingle_words, similarity, propose=near_links).select("doc_id", "component_id")
