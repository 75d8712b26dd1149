"""Full-text search vectors with positions, and phrase matching on them.

A text's words are numbered from 1. The configuration `simple` takes words as they are; `english` drops stop
words, whose places stay empty, and stems the others. A vector is made beside its text, without a shuffle;
each worker stems a word once and remembers it, up to a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.stemming import STOP_WORDS, stem
from ..storage import materialize

#: Words whose stems a task remembers before it begins anew.
KNOWN_WORDS = 200_000
#: Phrases whose lexemes may be broadcast: rows of some 50 bytes.
BROADCAST_LEXEMES = 100_000
#: Words of the texts that are worked on at once.
WORDS_AT_ONCE = 500_000
#: Places of lexemes to confirm that may be broadcast: rows of some 60 bytes.
BROADCAST_PLACES = 500_000
CONFIGS = ("simple", "english")


def words(text: Column) -> Column:
    """The words of a text in lower case: runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


class Stems(dict):
    """Stems of words by need, "" for stop words; emptied when it is full."""

    def __missing__(self, word: str) -> str:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = "" if word in STOPS else stem(word)
        return found


STOPS = frozenset(STOP_WORDS)


def lexemes(docs: DataFrame, key: list[str], text: str, config: str = "english") -> DataFrame:
    """(key, lexeme, positions): the search vector of every row of docs, one row a lexeme with its ascending places.

    Texts without lexemes, null ones among them, give no row; a row that repeats gives its vector again.
    """
    if config not in CONFIGS:
        raise ValueError(f"no configuration {config!r}, only {CONFIGS}")
    rows = docs.select(*key, words(F.col(text)).alias("_words"))
    stemmed = config == "english"
    schema = StructType([*(rows.schema[k] for k in key), StructField("lexeme", StringType()), StructField("positions", ArrayType(IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems = Stems()
        for batch in batches:
            ends = np.asarray(batch.column(len(key)).offsets)
            first = 0
            while first < batch.num_rows:  # so many rows at a time that their words are bounded, one at least
                stop = max(first + 1, int(np.searchsorted(ends, ends[first] + WORDS_AT_ONCE, "right")) - 1)
                yield vectors(batch.slice(first, stop - first), stems)
                first = stop

    def vectors(batch: pa.RecordBatch, stems: Stems) -> pa.RecordBatch:
        texts = batch.column(len(key))
        sizes = np.diff(np.asarray(texts.offsets))
        coded = texts.flatten().dictionary_encode()  # each distinct word once
        names = coded.dictionary.to_pylist()
        if stemmed:
            made = [stems[n] for n in names]
            names = sorted({m for m in made if m})
            number = {n: i for i, n in enumerate(names)} | {"": -1}
            lexeme = np.fromiter((number[m] for m in made), np.int64, len(made))[np.asarray(coded.indices)] if made else np.empty(0, np.int64)
        else:
            lexeme = np.asarray(coded.indices).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        kept = lexeme >= 0
        at = row[kept] * max(1, len(names)) + lexeme[kept]
        order = np.argsort(at, kind="stable")  # places stay in order
        at = at[order]
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)).astype(np.int32)), pa.array(place[kept][order].astype(np.int32)))
        row, lexeme = np.divmod(at[starts], max(1, len(names)))
        columns = [batch.column(c).take(pa.array(row)) for c in range(len(key))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()).take(pa.array(lexeme)), lists], [*key, "lexeme", "positions"])

    return rows.mapInArrow(run, schema)


def phrases(asked: DataFrame, text: str, key: list[str], config: str = "english") -> DataFrame:
    """(key, lexeme, offset, n): the lexemes of phrases by their distance from the first, and their number."""
    vector = lexemes(asked, key, text, config).select(*key, "lexeme", F.explode("positions").alias("_place"))
    ends = vector.groupBy(*key).agg(F.min("_place").alias("_first"), F.count("*").alias("n"))
    return vector.join(ends, key).select(*key, "lexeme", (F.col("_place") - F.col("_first")).alias("offset"), "n")


def phrase_match(index: DataFrame, asked: DataFrame, key: list[str], doc: str) -> DataFrame:
    """(key, doc, starts): the texts of index (doc, lexeme, positions) that hold a phrase of `phrases`, and how often.

    asked is stored or cheap to make again; doc tells the rows of one text from others'.

    Each phrase starts from its rarest lexeme: every place of that is a candidate, which the other lexemes
    must confirm at their distances. So common lexemes are looked up at candidates only, and their postings never
    meet. Phrases of stop words alone match nothing.
    """
    if asked.count() <= BROADCAST_LEXEMES:
        asked = F.broadcast(asked)
    # the postings of asked lexemes are set aside: they are read three times
    index = materialize(index.join(asked.select("lexeme").distinct(), "lexeme", "left_semi"), "asked-postings")
    frequent = index.groupBy("lexeme").agg(F.count("*").alias("df"))
    counted = asked.join(frequent, "lexeme", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = counted.groupBy(*key).agg(F.min(F.struct("df", "offset", "lexeme")).alias("r")).filter("r.df > 0")
    leads = rarest.select(*key, F.col("r.lexeme").alias("lexeme"), F.col("r.offset").alias("_lead"))
    found = leads.join(index, "lexeme").select(*key, doc, "_lead", F.explode("positions").alias("_place"))
    starts = materialize(found.select(*key, doc, "_lead", (F.col("_place") - F.col("_lead")).alias("_start")).filter("_start > 0"), "phrase-starts")
    # the rarest lexeme is confirmed by its own place
    wanted = starts.join(asked, key).filter("offset <> _lead").select(*key, doc, "_start", "n", "lexeme", (F.col("_start") + F.col("offset")).alias("_place"))
    if wanted.count() <= BROADCAST_PLACES:  # few places to look at: they go to the index, which stays where it is
        wanted = F.broadcast(wanted)
    confirmed = wanted.join(index, [doc, "lexeme"]).filter(F.array_contains("positions", F.col("_place")))
    whole = confirmed.groupBy(*key, doc, "_start", "n").agg(F.count("*").alias("found")).filter("found = n - 1").select(*key, doc, "_start")
    alone = starts.join(asked.filter("n = 1").select(*key), key, "left_semi").select(*key, doc, "_start")
    return whole.unionByName(alone).groupBy(*key, doc).agg(F.count("*").alias("starts"))
