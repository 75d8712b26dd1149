"""Near-duplicate line removal across documents by a deletion-neighbourhood join. DataFrame functions only.

Two lines are copies when they are at most one character edit apart. Lines within the bound share
a variant of themselves with that one character deleted at the same position (a substitution), or one line is the other
with a character deleted. Writing a hashed key for every character of every line would move far more than the
text, so the neighbourhood is emitted from coarse to fine: first with one of four stretches of
the line deleted, then, for the keys that lines share, with one of about sqrt(m) parts of that
stretch of m characters deleted, and at last with single characters. At each step lines within the bound
share a key, and keys of one line alone are left out. A line emits keys at its own
length, and at the length one shorter for a partner that lacks a character.

Equal keys of the last step are joined by their smallest place: every line of a substitution key is within one
edit of the first of them; of a deletion key, the shorter line is met by the first of the longer ones and
each of those by the shorter. So a line is paired with one line per key and no pairs of a group are
listed; the edit distance verifies each pair. A line is dropped when a line at an earlier place
(doc_id, then line number) has the same text or is within one edit of it, whether or not that
earlier line is itself dropped.

Lines are compared without the blanks at their ends; lines without other characters stay. Equal lines count at any
length, edits only from `min_chars` on (any two one-letter lines are one edit apart, as are `Part 1` and `Part 2`). Defined results: null
text stays null and an empty text empty; a document may lose all its lines; documents with a null
doc_id stay as they are; rows that share a doc_id hold the same places, so neither is dropped for the
other; an empty table gives an empty result; other columns, whatever their names, are passed on untouched, but for
earlier n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, named, unused

MIN_CHARS = 10
BLOCKS = 4
#: Up to so many documents with candidate lines are looked up by a broadcast of their ids (8 MB); more by a shuffle.
BROADCAST_IDS = 1_000_000
#: Lines that make up a larger share of all lines than one in so many are looked up by broadcast, so there are fewer than so many.
FREQUENT = 1000


def clean(line: Column) -> Column:
    """The compared form of a line."""
    return F.btrim(line, F.lit(" \t\r"))


def variant_keys(line: Column, n: Column, blocks: int) -> Column:
    """Keys of the line with one block deleted: first those at its own length, then those at the length one shorter."""
    keys = []
    for shorter in (0, 1):
        ref = n - shorter
        for j in range(blocks):
            start = F.floor(ref * j / blocks).cast("int")
            rest = (ref - F.floor(ref * (j + 1) / blocks)).cast("int")
            keys.append(F.xxhash64(ref, F.lit(j), F.left(line, start), F.right(line, rest)))
    return F.array(*keys)


def places(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of the lines that hold more than blanks."""
    lines = docs.filter("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return lines.select("doc_id", "line_no", clean(F.col("raw")).alias("line")).filter("line <> ''")


def identity(line: Column) -> list[Column]:
    """128 bits that stand for a line's text."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2")]


def shared(keys: DataFrame) -> DataFrame:
    """The rows of (key, own, ...) whose key two lines share, one of them at its own length."""
    known = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("any_own")).filter("n > 1 and any_own").select("key")
    return keys.join(known, "key", "left_semi")


def stretches(lines: DataFrame, blocks: int) -> DataFrame:
    """(place, key, own, block) from (place, k, key, line): the deleted block of each key of variant_keys, in the line's own text."""
    own = F.col("k") < blocks
    n = F.char_length("line")
    ref = n - F.when(own, 0).otherwise(1)
    j = F.col("k") % blocks
    start = F.floor(ref * j / blocks).cast("int")
    rest = (ref - F.floor(ref * (j + 1) / blocks)).cast("int")
    return lines.select("place", "key", own.alias("own"), F.substring(F.col("line"), start + 1, n - start - rest).alias("block"))


def parts(state: DataFrame) -> DataFrame:
    """(place, key, own, block) with each block cut into about as many parts as a part has characters, one of them deleted."""
    size = F.char_length("block")
    m = (size - F.when(F.col("own"), 0).otherwise(1)).cast("long")
    s = F.greatest(F.lit(1), F.ceil(F.sqrt(m))).cast("int")

    def one(j: Column) -> Column:
        start, rest = F.floor(m * j / s).cast("int"), (m - F.floor(m * (j + 1) / s)).cast("int")
        return F.struct(F.xxhash64("key", j, F.left("block", start), F.right("block", rest)).alias("key"), F.substring(F.col("block"), start + 1, size - start - rest).alias("block"))

    cut = state.select("place", "own", F.explode(F.transform(F.sequence(F.lit(0), s - 1), one)).alias("part"))
    return cut.select("place", "part.key", "own", "part.block")


def exact_keys(state: DataFrame) -> DataFrame:
    """(place, key, own) of single characters: with a character deleted at its position, and the texts that a deletion leaves."""
    size = F.char_length("block")
    without = lambda i: F.concat(F.left("block", i), F.substring(F.col("block"), i + 2, size))
    at = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)))
    whole = F.xxhash64("key", F.lit("text"), "block")
    own = F.array_append(F.transform(at, lambda i: F.xxhash64("key", i, without(i))), whole)
    longer = F.array_distinct(F.transform(at, lambda i: F.xxhash64("key", F.lit("text"), without(i))))
    return state.select("place", F.explode(F.when(F.col("own"), own).otherwise(longer)).alias("key"), "own")


def first_partners(keys: DataFrame) -> DataFrame:
    """(a, b): for every place b the earlier places a that its keys (place, key, own) give, one for each key at most."""
    first = lambda own: F.min(F.when(F.col("own") == F.lit(own), F.col("place")))
    low = keys.groupBy("key").agg(F.count("*").alias("n"), first(True).alias("own_first"), first(False).alias("long_first")).filter("n > 1 and own_first is not null")
    # a key has own lines of one length (a substitution), or one own line and longer ones (a deletion)
    partner = F.when(F.col("own") & F.col("long_first").isNotNull(), F.col("long_first")).otherwise(F.col("own_first"))
    return keys.join(low.drop("n"), "key").select(partner.alias("a"), F.col("place").alias("b")).filter("a < b").distinct()


def texts_at(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(place, line) of the wanted places, once each."""
    ids = wanted.select("place.doc_id").distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    lines = places(docs.join(ids, "doc_id", "left_semi"))
    return lines.select(F.struct("doc_id", "line_no").alias("place"), "line").join(wanted, "place", "left_semi").dropDuplicates(["place"])


def near_pairs(firsts: DataFrame, docs: DataFrame, blocks: int) -> DataFrame:
    """(a, b) of first places, stored: b is within one edit of the earlier a, for every b that has such an a."""
    coarse = firsts.filter("keys is not null").select("place", F.posexplode("keys").alias("k", "key")).withColumn("own", F.col("k") < blocks)
    coarse = materialize(shared(coarse), "line-keys")
    lines = materialize(texts_at(docs, coarse.select("place").distinct()), "line-texts")
    middle = materialize(parts(stretches(coarse.join(lines, "place"), blocks)), "line-parts")
    fine = materialize(exact_keys(shared(middle)), "line-fine-keys")
    pairs = (
        first_partners(fine)
        .join(lines.select(F.col("place").alias("a"), F.col("line").alias("line_a")), "a")
        .join(lines.select(F.col("place").alias("b"), F.col("line").alias("line_b")), "b")
        .filter(F.levenshtein("line_a", "line_b", 1) >= 0)
    )
    pairs = materialize(pairs.select("a", "b"), "line-pairs")
    discard(coarse, lines, middle, fine)
    return pairs


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, drops): the sorted numbers, from 0, of the lines that each document loses."""
    source = docs.select("doc_id", "text")
    line, n = F.col("line"), F.char_length("line")
    seen = places(source).select("doc_id", "line_no", *identity(line), F.when(n >= min_chars, variant_keys(line, n, blocks)).alias("keys"))
    one = seen.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no", "keys")).alias("m"), F.count("*").alias("copies"))
    firsts = materialize(one.select("h1", "h2", F.struct("m.doc_id", "m.line_no").alias("place"), "m.keys", "copies"), "lines")
    late = near_pairs(firsts, source, blocks).select(F.col("b").alias("place")).distinct().withColumn("late", F.lit(True))
    verdict = firsts.join(late, "place", "left").filter("late or copies > 1").select("h1", "h2", "place", F.coalesce("late", F.lit(False)).alias("late"), "copies")
    verdict = materialize(verdict, "line-verdicts")
    total = firsts.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    discard(firsts)

    # the rows of a frequent line are met where they are; the others go to their line's verdict, those already met anywhere
    often = F.col("copies") > total // FREQUENT
    known = verdict.filter(often).select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), F.col("place").alias("often_first"), F.col("late").alias("often_late"))
    again = places(source).select("doc_id", "line_no", *identity(line))
    again = again.join(F.broadcast(known), (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")), "left")
    met = F.col("f1").isNotNull()
    again = again.withColumn("h1", F.when(met, F.xxhash64("doc_id", "line_no")).otherwise(F.col("h1"))).withColumn("h2", F.when(met, F.lit(0).cast("long")).otherwise(F.col("h2")))
    rest = verdict.filter(~often).select("h1", "h2", "place", "late")
    both = again.join(rest, ["h1", "h2"], "left").withColumn("first", F.coalesce("often_first", "place"))
    hit = both.filter("first is not null").filter(F.coalesce("often_late", "late") | (F.struct("doc_id", "line_no") != F.col("first")))
    return hit.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("drops"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, blocks: int = BLOCKS) -> DataFrame:
    """docs with the dropped lines gone from text, and n_lines, n_dropped added at the end."""
    doc, drops = unused(docs, "doc"), unused(docs, "drops")
    found = dropped_lines(docs, min_chars, blocks).select(F.col("doc_id").alias(doc), F.col("drops").alias(drops))
    parted = F.split("text", "\n")
    gone = F.col(drops)
    kept = F.array_join(F.filter(parted, lambda _, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(gone.isNull(), F.col("text")).otherwise(kept).alias("text")
    same = [text if c == "text" else named(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(parted))
    counts = [n_lines.cast("long").alias("n_lines"), F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped")]
    # rows without doc_id lose nothing and don't meet in a task
    ours = docs.filter("doc_id is not null").join(found, F.col("doc_id") == F.col(doc), "left")
    others = docs.filter("doc_id is null").withColumn(drops, F.lit(None).cast("array<int>"))
    return ours.select(*same, *counts).unionByName(others.select(*same, *counts))
