"""Mixing of sources to target weights with exact quotas. DataFrame functions only.

Sizes are words. Sources in code point order (null last) weigh by a repeating cycle; their
targets share all words by weight, stop at `cap` times a source's size, and what is above is
shared again by weight until none is.

Every source is put in a permuted order (by a hash) and cut into blocks of about equal words. A
source gives whole passes of all its blocks and, of a last pass, permuted blocks up to its
target; the block that meets the target gives its first documents and the last of those its
first words, so that each source's words equal its rounded target. A splitting tree deals the
drawn blocks to output shards: the root holds each source's exact quota of blocks, and a node
hands its two children disjoint random halves, so that each half's counts by source follow the
multivariate hypergeometric law. A shard then draws the next blocks of each source's permuted
sequence, as many as its quota, and shuffles its documents locally by a hash.

The number of shards follows the input's words (65536 for 16 trillion), and the tables of
sources and of blocks (shards x blocks per shard for each pass, some two million then) fit a task; running sums over a hot source go through hash buckets, so that no task
orders a whole source. Hashes are fixed, so reruns agree.

Defined results: null text counts no words; a document without words is never drawn; repeated
doc_ids are told apart by their rank in order of source, size and text hash; an empty table gives
an empty result; only doc_id, source and text are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

WEIGHTS = (1, 2, 3)
CAP = 3
#: Output shards: at least so many, and a power of two that gives a shard this many words or fewer.
SHARDS, SHARD_WORDS = 64, 1 << 28
BLOCKS_PER_SHARD = 16
#: Words of a shard that a task orders and writes, about.
SLICE_WORDS = 1 << 25
#: Documents that a task orders at once, about.
BUCKET_DOCS = 5_000


@dataclass(frozen=True)
class Mix:
    """documents: doc_id, copy, source, size, source_size, target. draws: doc_id, copy, epoch, block, shard, words, place."""

    documents: DataFrame
    draws: DataFrame
    #: tasks that write a shard between them, each an interval of its places
    slices: int = 1


def shards_for(words: int) -> int:
    """How many shards hold so many words: a power of two."""
    return max(SHARDS, 1 << max(0, -(-words // SHARD_WORDS) - 1).bit_length())


def key(*parts: Column | str) -> Column:
    """A fixed hash of values, as a string that sorts at random."""
    return F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary"))


def numbered(docs: DataFrame) -> DataFrame:
    """docs with size and copy, which tells rows of equal doc_id apart."""
    sized = docs.withColumns({"size": word_count(F.col("text")), "_text": F.md5(F.coalesce("text", F.lit("")).cast("binary"))})
    order = Window.partitionBy("doc_id").orderBy("source", "size", "_text")
    return sized.withColumn("copy", F.row_number().over(order)).drop("_text")


def targets(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, n_docs, target) by weighted filling up to the caps."""
    sources = documents.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(F.asc_nulls_last("source")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    rising = every.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    before = F.coalesce(F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(every) - before).cast("double") / left.cast("double"))
    s = s.withColumn("level", F.max(F.when(F.col("most") > F.col("level") * F.col("weight"), F.col("level"))).over(every))
    fair = F.col("weight") * F.col("level")
    target = F.when(F.col("level").isNull() | (fair >= F.col("most")), F.col("most").cast("double")).otherwise(fair)
    return s.select("source", "source_size", "n_docs", target.alias("target"))


def placed(documents: DataFrame, sources: DataFrame, block_words: Column, seed: str) -> DataFrame:
    """documents with their block and their first word's offset in it, in the permuted order of their source."""
    spread = documents.join(sources, documents["source"].eqNullSafe(sources["source"])).select(documents["*"], "source_size", "target", (F.lit(1) + F.floor(F.col("n_docs") / BUCKET_DOCS)).alias("buckets"))
    spread = spread.withColumn("order", key(seed, F.col("doc_id"), F.col("copy")))
    spread = spread.withColumn("bucket", F.floor(F.conv(F.substring("order", 1, 6), 16, 10).cast("long") * F.col("buckets") / (1 << 24)))
    sums = spread.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("words").over(along), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, 0)
    spread = spread.withColumn("run", F.sum("size").over(inside) - F.col("size"))
    spread = spread.join(sums, spread["source"].eqNullSafe(sums["_s"]) & (spread["bucket"] == sums["_b"]))
    at = F.col("_before") + F.col("run")
    return spread.select("doc_id", "copy", "source", "size", "source_size", "target", at.alias("at"), F.floor(at / block_words).alias("block"))


def drawn_blocks(docs: DataFrame, seed: str) -> DataFrame:
    """(source, block, first, epoch, take, turn): each drawn block with the words taken of it and its turn in the source's permuted sequence."""
    blocks = docs.groupBy("source", "block").agg(F.min("at").alias("first"), F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    goal = F.floor(F.col("target") + 0.5)
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)
    by = Window.partitionBy("source").orderBy(key(seed + " last", F.col("source"), F.col("block")), "block")
    blocks = blocks.withColumns({"passes": passes, "rest": goal - passes * F.col("source_size"), "before": F.sum("words").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")})
    blocks = blocks.withColumn("tail", F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.col("rest") - F.col("before"))))
    drawn = blocks.select("source", "block", "first", "words", "tail", "passes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("epoch"))
    drawn = drawn.withColumn("take", F.when(F.col("epoch") < F.col("passes"), F.col("words")).otherwise(F.col("tail"))).filter("take > 0")
    turn = Window.partitionBy("source").orderBy(key(seed + " draw", F.col("source"), F.col("epoch"), F.col("block")), "epoch", "block")
    return drawn.select("source", "block", "first", "epoch", "take", F.row_number().over(turn).alias("turn"))


def marker(seed: str) -> Callable[[Column], Column]:
    """Puts a slot's random mark before it."""
    return lambda s: F.struct(key(seed, s["source"], s["slot"]).alias("mark"), s["source"].alias("source"), s["slot"].alias("slot"))


def split_tree(quotas: DataFrame, shards: int, seed: str) -> DataFrame:
    """(source, shard, low, high): the turns of each source's sequence that go to each shard.

    quotas is (source, blocks). A node is one array of block slots; its children get the two
    halves of a random order of it.
    """
    levels = (shards - 1).bit_length()
    if 1 << levels != shards:
        raise ValueError("the number of shards must be a power of two")
    slots = quotas.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks"))).alias("slot"), "source")
    node = slots.groupBy(F.lit(0).alias("node")).agg(F.collect_list(F.struct("source", "slot")).alias("slots"))
    for level in range(levels):
        mixed = node.select("node", F.array_sort(F.transform("slots", marker(f"{seed} tree {level}"))).alias("slots")).withColumn("half", F.ceil(F.size("slots") / 2).cast("int"))
        children = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.slice("slots", F.lit(1), F.col("half")).alias("slots")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.slice("slots", F.col("half") + 1, F.size("slots")).alias("slots")),
        )
        node = mixed.select(F.explode(children).alias("c")).select("c.node", "c.slots").filter(F.size("slots") > 0)
    counts = node.select(F.col("node").alias("shard"), F.explode("slots").alias("s")).groupBy("s.source", "shard").agg(F.count("*").alias("n"))
    along = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    high = F.sum("n").over(along)
    return counts.select("source", "shard", (high - F.col("n") + 1).alias("low"), high.alias("high"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, shards: int | None = None, blocks_per_shard: int = BLOCKS_PER_SHARD, seed: str = "mix") -> Mix:
    """The mixture of docs (doc_id, source, text): its documents' sizes and targets, and what is drawn of them."""
    rows = materialize(numbered(docs.select("doc_id", "source", "text")).select("doc_id", "copy", "source", "size"), "mix-sizes")
    sources = materialize(targets(rows, weights, cap), "mix-targets")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    shards = shards or shards_for(total)
    block_words = max(1, -(-total // (shards * blocks_per_shard)))
    spread = materialize(placed(rows, sources, F.lit(block_words), seed), "mix-placed")
    drawn = drawn_blocks(spread, seed)
    quotas = drawn.groupBy("source").agg(F.count("*").alias("blocks"))
    share = split_tree(quotas, shards, seed).withColumnRenamed("source", "_s")
    dealt = drawn.join(share, drawn["source"].eqNullSafe(share["_s"]) & F.col("turn").between(F.col("low"), F.col("high")))
    dealt = materialize(dealt.select("source", "block", "first", "epoch", "take", "shard"), "mix-blocks")
    d = dealt.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "first", "epoch", "take", "shard")
    taken = spread.join(d, spread["source"].eqNullSafe(d["_s"]) & (spread["block"] == d["_b"]))
    words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("take") - (F.col("at") - F.col("first"))))
    draws = taken.select("doc_id", "copy", "epoch", "block", "shard", words.alias("words")).filter("words > 0")
    draws = draws.withColumn("place", key(seed + " place", F.col("shard"), F.col("doc_id"), F.col("copy"), F.col("epoch")))
    return Mix(spread.select("doc_id", "copy", "source", "size", "source_size", "target"), draws, max(1, -(-total // (shards * SLICE_WORDS))))


def taken_by_shard(made: Mix) -> DataFrame:
    """(doc_id, copy, taken, shards): the words drawn of each document, and their shards (shard, words) in order, as the tree dealt them."""
    per = made.draws.groupBy("doc_id", "copy", "shard").agg(F.sum("words").alias("words"))
    # a document stands in no more shards than it has passes
    return per.groupBy("doc_id", "copy").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct(F.col("shard").cast("long").alias("shard"), "words"))).alias("shards"))


def mixed_documents(docs: DataFrame, made: Mix) -> DataFrame:
    """The drawn documents with docs' columns, shard by shard in shuffled order; one drawn in part keeps its first words."""
    rest = [c for c in docs.columns if c != "text"]
    rows = numbered(docs.select("doc_id", "source", "text", F.struct(*rest).alias("row"))).select("row", "text", "size", "doc_id", "copy")
    draws = made.draws.select(F.col("doc_id").alias("_doc"), F.col("copy").alias("_copy"), "shard", "words", "place")
    both = rows.join(draws, rows["doc_id"].eqNullSafe(draws["_doc"]) & (rows["copy"] == draws["_copy"]))
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), "")
    text = F.when(F.col("words") < F.col("size"), part).otherwise(F.col("text"))
    # places are random hexadecimal digits, so their first ones cut a shard into even slices
    piece = F.floor(F.conv(F.substring("place", 1, 6), 16, 10).cast("long") * made.slices / (1 << 24))
    both = both.select("row", text.alias("text"), "shard", "place", piece.alias("slice")).repartition("shard", "slice").sortWithinPartitions("shard", "slice", "place")
    return both.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
