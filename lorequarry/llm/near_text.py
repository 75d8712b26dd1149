"""Near copies of texts: components of all pairs whose sets of word shingles have a Jaccard similarity of a bound or more.

Candidates may be proposed by SimHash fingerprints of the sets (see simhash.near_duplicates_at); those that whole sets
confirm are merged first. Fingerprints of 64 bits can't find all pairs: at a similarity of 0.8 about 10 of the bits differ
and 18 may, as they do in one of 4000 unrelated pairs. The rest comes from min-hashes in bands: two texts
at similarity s share one of BANDS buckets of ROWS minima with probability 1 - (1 - s^ROWS)^BANDS,
which misses 1.4e-7 of the pairs at 0.8 and fewer above.

Pairs of a bucket are verified on whole sets without listing them. In each of ROUNDS rounds a bucket's members meet its
leader (another one in each round), if they aren't in one component yet, and those similar to it are merged. What is
then still in several components is compared pair by pair, in parts of bounded size, so that a part with
another is a task's unit of work and no group is ever gathered. Buckets with the same members are one.

Defined results: texts without words are near copies of each other and of nothing else; fewer words than a
shingle make one shingle of the whole sequence; equal texts always link; equal rows give equal
rows; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import spans, word_edges
from .common import connected_components, discard, materialize, release_memory

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 4
SEED = 42
CHUNK = 256
BITS_CHUNK = 1 << 14
#: Words of more bytes than this are hashed by themselves.
LONG_WORD = 64
TIMES = np.uint64(0x9E3779B97F4A7C15)
#: The first n of eight bytes.
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
ROUNDS = 2
#: Members that meet their leader under one key of the join.
MEMBERS = 1000
#: Sets in a part of a bucket, about.
PART = 128
#: Up to so many texts are looked up by a broadcast of their ids (16 bytes each); more by a shuffle.
BROADCAST_IDS = 1_000_000


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text, between ASCII white space, A to Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words (as words_of has them) of large strings, and each text's number of words.

    Words are read eight bytes at a time, all of them at once; only long ones are hashed one by one.
    """
    data, _, begins, closes, counts = word_edges(text, ~SPACE)
    data = np.concatenate((LOWER[data], np.zeros(8, np.uint8)))
    at_any = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    sizes = closes - begins
    out = sizes.astype(np.uint64) * TIMES
    for done in range(0, LONG_WORD, 8):
        left = np.flatnonzero(sizes > done) if done else slice(None)
        rest = np.minimum(sizes[left] - done, 8)
        if not len(rest):
            break
        some = (out[left] ^ (at_any[begins[left] + done] & KEEP[rest])) * TIMES
        out[left] = some ^ (some >> np.uint64(29))
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(data[begins[i] : closes[i]])
    out *= TIMES
    return out ^ (out >> np.uint64(32)), counts


def in_sequence(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k neighbours of h: order counts."""
    n = max(len(h) - k + 1, 0)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out ^= h[i : n + i]
        out *= TIMES
        out ^= out >> np.uint64(29)
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """The values in rising order, each once."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def all_shingles(text: pa.Array, shingle_words: int = SHINGLE_WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """Of each text its number of words, and the distinct hashes of its word shingles in rising order; fewer words are one shingle."""
    for some in spans(text):
        h, counts = word_hashes(some)
        runs = in_sequence(h, shingle_words)
        low = 0
        for n in counts.tolist():
            if n >= shingle_words:
                yield n, distinct(runs[low : low + n - shingle_words + 1])
            else:
                yield n, in_sequence(h[low : low + n], n) if n else np.zeros(0, np.uint64)
            low += n


def shingles(words: list[bytes], shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The shingles of a text of these words, as all_shingles has them."""
    return next(all_shingles(pa.array([b" ".join(words)]).cast(pa.large_binary()).view(pa.large_string()), shingle_words))[1]


def set_id(found: np.ndarray) -> int:
    """64 bits that stand for a set, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set of hashes, 64 bits as a signed long; zero of an empty set."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), BITS_CHUNK):
        some = found[at : at + BITS_CHUNK]
        counts += np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(found), bitorder="little").view("<i8")[0])


def multipliers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    draw = lambda *shape: r.integers(0, 1 << 64, shape, np.uint64)
    high = lambda x: (x >> np.uint64(32)).astype(np.uint32)
    return high(draw(BANDS * ROWS, 1)), high(draw(BANDS * ROWS, 1)) | np.uint32(1), draw(BANDS, ROWS) | np.uint64(1)


def bands(found: np.ndarray, mix: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """One key for each band of minima, over the upper halves of the hashes; none of an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    flip, times, fold = mix
    found = (found >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(found), CHUNK):
        some = found[None, at : at + CHUNK] ^ flip
        some *= times
        np.minimum(low, some.min(1), out=low)
    return (low.reshape(BANDS, ROWS).astype(np.uint64) * fold).sum(1, dtype=np.uint64).view(np.int64)


def lists(values: list[np.ndarray]) -> pa.ListArray:
    """Arrays of 64-bit integers as a list column of longs."""
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *(v.view(np.int64) for v in values)])))


def sketches(docs: DataFrame, shingle_words: int, with_fingerprints: bool = True) -> DataFrame:
    """(doc_id, n_words, node, size, fp, bands): a long for the set of shingles, its size, fingerprint (null where none is wanted) and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = multipliers()
        for batch in batches:
            found = list(all_shingles(batch.column(1), shingle_words))
            n_words, sets = [n for n, _ in found], [s for _, s in found]
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(map(set_id, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(map(fingerprint, sets) if with_fingerprints else [None] * len(sets), pa.int64()), lists([bands(s, mix) for s in sets])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "node", "size", "fp", "bands"])
        release_memory()

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, node long, size int, fp long, bands array<long>")


def shingle_sets(texts: DataFrame, shingle_words: int) -> DataFrame:
    """(node, tokens) of (node, text), for the rows whose text has the node's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(node, s) for node, (_, s) in zip(batch.column(0).to_pylist(), all_shingles(batch.column(1), shingle_words)) if set_id(s) == node]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in got], pa.int64()), lists([s for _, s in got])], ["node", "tokens"])
        release_memory()

    return texts.select("node", "text").mapInArrow(run, "node long, tokens array<long>")


def shared_buckets(groups: DataFrame) -> DataFrame:
    """(bucket, node, size) of the buckets with several members, one for each set of members."""
    spread = groups.select("node", "size", F.posexplode("bands").alias("band", "key"))
    marks = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"mark{i}") for i in (1, 2)]
    known = spread.groupBy("band", "key").agg(F.count("*").alias("n"), *marks).filter("n > 1")
    one = known.groupBy("n", "mark1", "mark2").agg(F.min(F.struct("band", "key")).alias("m")).select("m.band", "m.key")
    # Spark takes exploded rows for as small as the file that they come from and would broadcast them
    return spread.hint("merge").join(one, ["band", "key"]).select(F.xxhash64("band", "key").alias("bucket"), "node", "size")


def proposals(groups: DataFrame, propose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b) of sets whose fingerprints are equal or linked by propose: (a, b) of fingerprints (fp).

    One set stands for its fingerprint: the others of it, and those that stand for linked ones, meet that set.
    """
    worded = groups.filter("size > 0").select("node", "fp")
    heads = materialize(worded.groupBy("fp").agg(F.min("node").alias("head")), "fingerprint-heads")
    same = worded.join(heads, "fp").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    links = propose(heads.select("fp"))
    ends = heads.select(F.col("fp").alias("a"), F.col("head").alias("head_a")), heads.select(F.col("fp").alias("b"), F.col("head").alias("head_b"))
    linked = links.join(ends[0], "a").join(ends[1], "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    return same.unionByName(linked).distinct()


def meets_leader(asked: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of asked that are similar. A leader a with many members stands under several keys."""
    leaders = asked.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("keys"))
    members = asked.join(leaders, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "keys").cast("int"))
    members = members.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tokens_b")), "b").select("a", "salt", "b", "tokens_b")
    heads = leaders.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("tokens_a")), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("keys") - 1)).alias("salt"), "tokens_a")
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    near = both * (1 + similarity) >= similarity * (F.size("tokens_a") + F.size("tokens_b")) - 1e-9
    return members.join(heads, ["a", "salt"]).filter(near).select("a", "b")


def links_across(rows: pa.StructArray, low: int, high: int, similarity: float) -> list[tuple[int, int]]:
    """Links that join the components (label) of the similar sets of two parts, or of one: no more than there are components."""
    part, node, label = (rows.field(c).to_numpy() for c in ("part", "node", "label"))
    tokens = rows.field("tokens")
    sizes = tokens.value_lengths().to_numpy()
    _, flat = np.unique(tokens.flatten().to_numpy(), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    _, at = np.unique(label, return_inverse=True)
    root = np.arange(at.max() + 1)
    marked = np.zeros(flat.max() + 1, bool)
    out = []
    for i in np.flatnonzero(part == low).tolist():
        other = (root[at] != root[at[i]]) & (part == high) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]) - 1e-9)
        if not other.any():
            continue
        marked[flat[starts[i] : starts[i] + sizes[i]]] = True
        both = np.add.reduceat(marked[flat], starts, dtype=np.int64)
        marked[flat[starts[i] : starts[i] + sizes[i]]] = False
        for k in np.flatnonzero(other & (both * (1 + similarity) >= similarity * (sizes + sizes[i]) - 1e-9)).tolist():
            if root[at[k]] != root[at[i]]:
                out.append((int(node[i]), int(node[k])))
                root[root == root[at[k]]] = root[at[i]]
    return out


def all_pairs(labelled: DataFrame, sets: DataFrame, similarity: float, part: int) -> DataFrame:
    """Links (a, b) between the components (label) of each bucket of (bucket, node, label).

    Members of the bucket's largest component aren't compared with each other, but all others with everyone. So a
    bucket's rest is cut into parts 0 to rests - 1, the largest component into the parts from there
    on, and only pairs with a part of the rest are units of work.
    """
    by_label = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    sizes = by_label.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"))
    cut = lambda n: F.ceil(n / part).cast("int")
    sizes = sizes.select("bucket", F.col("top.label").alias("main"), cut(F.col("top.n")).alias("mains"), cut(F.col("n") - F.col("top.n")).alias("rests"))
    parted = labelled.join(sizes, "bucket").withColumn("is_main", F.col("label") == F.col("main"))
    own = F.pmod(F.xxhash64("node", "bucket"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("rests"))).cast("int")
    parted = parted.withColumn("part", F.when(F.col("is_main"), F.col("rests")).otherwise(0) + own)
    others = F.col("rests") + F.when(F.col("is_main"), 0).otherwise(F.col("mains")) - 1
    met = parted.withColumn("other", F.explode(F.sequence(F.lit(0), others))).join(sets, "node")
    work = met.groupBy("bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")).agg(F.collect_list(F.struct("part", "node", "label", "tokens")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, rows in zip(*batch.columns):
                found = np.array(links_across(rows.values, low.as_py(), high.as_py(), similarity), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return work.select("low", "high", "rows").mapInArrow(run, "a long, b long")


def components(buckets: DataFrame, sets: DataFrame, similarity: float, part: int = PART, proposed: DataFrame | None = None) -> DataFrame:
    """(node, component) over all similar pairs of buckets (bucket, node, size) and of proposed (a, b), for nodes with such a pair."""
    links = parts = None
    if proposed is not None:
        links = materialize(meets_leader(proposed, sets, similarity), "near-proposed")
        parts = connected_components(links, "a", "b")
    for turn in range(ROUNDS + 1):
        labelled = buckets.withColumn("label", F.col("node")) if parts is None else buckets.join(parts, "node", "left").select("bucket", "node", "size", F.coalesce("component", "node").alias("label"))
        # by turns the first and the last in an order of the members, so the first two leaders differ
        order, pick = F.xxhash64("node", F.lit(turn // 2)), (F.min_by, F.max_by)[turn % 2]
        lead = pick(F.struct(F.col("node").alias("a"), F.col("size").alias("lead_size"), F.col("label").alias("lead_label")), order).alias("lead")
        open_ones = labelled.groupBy("bucket").agg(lead, F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).filter("low <> high")
        if turn < ROUNDS:
            asked = labelled.join(open_ones.select("bucket", "lead.*"), "bucket").filter("label <> lead_label")
            asked = asked.filter(F.least("size", "lead_size") >= similarity * F.greatest("size", "lead_size") - 1e-9)
            found = meets_leader(asked.select("a", F.col("node").alias("b")).distinct(), sets, similarity)
        else:
            # three members have all met when two of them have led
            rest = labelled.join(open_ones.filter(F.col("n") > 1 + min(ROUNDS, 2)).select("bucket"), "bucket", "left_semi")
            found = all_pairs(rest.drop("size"), sets, similarity, part)
        found = materialize(found, "near-links")
        if turn and found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        parts = connected_components(links, "a", "b")
    return parts


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, part: int = PART, propose: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, component_id, n_words): the smallest doc_id reachable over pairs of texts of the similarity or more, and the text's words.

    propose, if given, links fingerprints (fp) as pairs (a, b), whose sets are compared before those that share a bucket.
    """
    seen = materialize(sketches(docs, shingle_words, propose is not None), "sketches")
    groups = materialize(seen.groupBy("node").agg(F.min(F.struct("doc_id", "size", "fp", "bands")).alias("m")).select("node", F.col("m.doc_id").alias("first"), "m.size", "m.fp", "m.bands"), "sketch-groups")
    buckets = materialize(shared_buckets(groups), "sketch-buckets")
    firsts = groups.select("node", "first")
    met = buckets.select("node")
    proposed = None if propose is None else materialize(proposals(groups, propose), "proposals")
    if proposed is not None:
        met = met.unionByName(proposed.select(F.explode(F.array("a", "b")).alias("node")))
    wanted = firsts.join(met.distinct(), "node", "left_semi").select(F.col("first").alias("doc_id"), "node")
    # rows that share a doc_id may have other texts
    wanted = materialize(wanted, "sketch-wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    sets = materialize(shingle_sets(docs.select("doc_id", "text").join(wanted, "doc_id"), shingle_words).dropDuplicates(["node"]), "shingle-sets")
    labels = materialize(components(buckets, sets, similarity, part, proposed), "near-components")
    discard(sets, buckets, *([] if proposed is None else [proposed]))
    members = labels.join(firsts, "node")
    roots = members.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = members.join(roots, "component").select("node", "component_id")
    found = firsts.join(linked, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id"))
    return seen.select("doc_id", "node", "n_words").join(found, "node").select("doc_id", "component_id", "n_words")
