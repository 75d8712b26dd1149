"""Model interfaces with deterministic offline defaults: embedding, scoring, generation, judging, contextualizing.

A model is an object with one method over plain lists; it is built once per task (`make`) and
called with batches. The defaults need no files and no network. Those of generation and judging
are lexical proxies, not language models.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

WORD = re.compile(r"[a-z0-9]+")
ASCII_WORD = re.compile(rb"[a-z0-9]+")
EMBED_BATCH = 32


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Generator(Protocol):
    def answer(self, query: str, contexts: list[str]) -> Answer: ...


class Judge(Protocol):
    #: what it judges; each metric is measured by itself, so that one that fails costs only its own score
    metrics: tuple[str, ...]

    def measure(self, metric: str, query: str, answer: str, expected: str, context: str) -> tuple[float, str]: ...


class Contextualizer(Protocol):
    def context(self, title: str, heading_path: list[str], content: str) -> str: ...


class Answer(NamedTuple):
    """A generated text and the tokens that it cost."""

    text: str
    input_tokens: int
    output_tokens: int


class HashEmbedder:
    """Signed hashing of words and word pairs into a unit vector."""

    def __init__(self, dim: int = 256):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts):
            words = ASCII_WORD.findall(text.lower().encode())
            single = list(map(zlib.crc32, words))
            # a pair's checksum goes on from its first word's over the blank and the second word
            pairs = map(zlib.crc32, words[1:], map(zlib.crc32, repeat(b" "), single))
            h = np.array([*single, *pairs], np.uint32)
            row[:] = np.bincount(h % self.dim, np.where(h >> 31, 1.0, -1.0), self.dim)
            n = np.linalg.norm(row)
            if n:
                row /= n
        return out


class OverlapScorer:
    """Share of a query's distinct words in a text, damped by the text's length."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        asked = set(WORD.findall(query.lower()))
        out = []
        for t in texts:
            words = WORD.findall(t.lower())
            out.append(len(asked & set(words)) / max(1, len(asked)) - 1e-4 * np.log1p(len(words)))
        return out


def counted_by(text: Column, make: Callable[[], Callable[[str], int]]) -> Column:
    """Token count of a text by a tokenizer; make builds the counting function once a task."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = make()
        for batch in batches:
            yield pa.array([count(x.as_py() or "") for x in batch], pa.int32())

    return F.arrow_udf(run, "int")(text)


def vocabulary_counter(path: str) -> Callable[[str], int]:
    """A counting function from a tokenizer's JSON file, which stands at the same path on every executor."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def vectors_array(vectors: np.ndarray) -> pa.ListArray:
    """A matrix's rows as a list column, without an object for each number."""
    n, width = vectors.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width, pa.int32()), pa.array(vectors.reshape(-1)))


def embed(df: DataFrame, text: str, make: Callable[[], Embedder] = HashEmbedder, name: str = "embedding", batch: int = EMBED_BATCH) -> DataFrame:
    """df with the vectors of a text column; each task builds the model once."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for values in batches:
            parts = [pa.array([], pa.list_(pa.float32()))]
            for at in range(0, len(values), batch):
                texts = [x or "" for x in values.slice(at, batch).to_pylist()]
                parts.append(vectors_array(np.asarray(model.encode(texts), np.float32)))
            yield pa.concat_arrays(parts)

    return df.withColumn(name, F.arrow_udf(run, "array<float>")(F.col(text)))


def score_pairs(df: DataFrame, query: str, text: str, make: Callable[[], Scorer] = OverlapScorer, name: str = "rerank_score") -> DataFrame:
    """df with the model's score of each (query, text) row."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = make()
        for queries, texts in batches:
            asked: dict[str, list[int]] = {}
            for i, q in enumerate(queries.to_pylist()):
                asked.setdefault(q or "", []).append(i)
            read = [t or "" for t in texts.to_pylist()]
            scores = [0.0] * len(read)
            for q, at in asked.items():  # all of a query's texts in the batch at once
                for i, score in zip(at, model.score(q, [read[i] for i in at])):
                    scores[i] = float(score)
            yield pa.array(scores, pa.float64())

    return df.withColumn(name, F.arrow_udf(run, "double")(F.col(query), F.col(text)))


def failure(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:300]


def generate(df: DataFrame, query: str, contexts: str, make: Callable[[], Generator]) -> DataFrame:
    """df with generated (answer, input_tokens, output_tokens, error) by a model that each task builds once.

    A row whose call fails keeps its error and no answer; one without contexts isn't asked and has neither.
    """
    kind = pa.struct([("answer", pa.string()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64()), ("error", pa.string())])

    def one(model: Generator, q: str | None, texts: list[str] | None) -> dict | None:
        if texts is None:
            return None
        try:
            made = model.answer(q or "", texts)
            return {"answer": made.text, "input_tokens": made.input_tokens, "output_tokens": made.output_tokens, "error": None}
        except Exception as e:  # whatever a model raises is its row's error
            return {"answer": None, "input_tokens": None, "output_tokens": None, "error": failure(e)}

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = make()
        for queries, texts in batches:
            yield pa.array([one(model, q, t) for q, t in zip(queries.to_pylist(), texts.to_pylist(), strict=True)], kind)

    made = F.arrow_udf(run, "struct<answer:string,input_tokens:bigint,output_tokens:bigint,error:string>")
    return df.withColumn("generated", made(F.col(query), F.col(contexts)))


def judge(df: DataFrame, query: Column, answer: Column, expected: Column, context: Column, make: Callable[[], Judge], threshold: float = 0.7) -> DataFrame:
    """df with scores, a map of metric to (score, success, reason, error); a metric whose call fails has only its error."""
    kind = pa.map_(pa.string(), pa.struct([("score", pa.float64()), ("success", pa.bool_()), ("reason", pa.string()), ("error", pa.string())]))

    def one(model: Judge, metric: str, texts: tuple[str, ...]) -> tuple[str, dict]:
        try:
            score, reason = model.measure(metric, *texts)
            return metric, {"score": float(score), "success": score >= threshold, "reason": reason, "error": None}
        except Exception as e:  # whatever a model raises is its metric's error
            return metric, {"score": None, "success": None, "reason": None, "error": failure(e)}

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        model = make()
        for columns in batches:
            rows = zip(*(c.to_pylist() for c in columns), strict=True)
            yield pa.array([[one(model, m, tuple(t or "" for t in texts)) for m in model.metrics] for texts in rows], kind)

    scored = F.arrow_udf(run, "map<string,struct<score:double,success:boolean,reason:string,error:string>>")
    return df.withColumn("scores", scored(query, answer, expected, context))


def contextualized(df: DataFrame, make: Callable[[], Contextualizer], name: str = "context") -> DataFrame:
    """df (title, heading_path, content) with a context of each chunk, empty where the call fails, and that call's error in context_error."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        model = make()
        for columns in batches:
            out = []
            for title, path, content in zip(*(c.to_pylist() for c in columns), strict=True):
                try:
                    out.append({"context": model.context(title or "", path or [], content or ""), "error": None})
                except Exception as e:  # whatever a model raises is its chunk's error
                    out.append({"context": "", "error": failure(e)})
            yield pa.array(out, pa.struct([("context", pa.string()), ("error", pa.string())]))

    made = df.withColumn("_made", F.arrow_udf(run, "struct<context:string,error:string>")(F.col("title"), F.col("heading_path"), F.col("content")))
    return made.withColumns({name: F.col("_made.context"), f"{name}_error": F.col("_made.error")}).drop("_made")


def answer_column(query: Column, contexts: Column) -> Column:
    """Offline generator: the context sentence with most of the query's terms, or that it isn't known."""
    terms = X.distinctive_terms(query)
    sentences = F.flatten(F.transform(contexts, lambda c: F.split(c, r"(?<=[.!?])\s+")))
    ranked = F.array_sort(F.transform(sentences, lambda s, i: F.struct((-F.size(F.filter(terms, lambda t: F.contains(F.lower(s), t)))).alias("miss"), i.alias("i"), s.alias("s"))))
    best = F.try_element_at(ranked, F.lit(1))
    return F.when(best.isNull() | (best["miss"] >= 0), F.lit(X.IDK + ".")).otherwise(best["s"])


def context_column(title: Column, heading_path: Column) -> Column:
    """Offline contextualizer: names the document and the place of a chunk in it."""
    path = F.array_join(F.coalesce(heading_path, F.array().cast("array<string>")), " > ")
    return F.concat_ws(" ", F.concat(F.lit("From "), F.coalesce(title, F.lit("an untitled document")), F.lit(".")), F.when(path != "", F.concat(F.lit("Section: "), path, F.lit("."))))


def judge_columns(query: Column, answer: Column, expected: Column, context: Column, threshold: float = 0.7) -> Column:
    """Offline judges: map of metric to score, success and reason, as shares of terms found."""
    pairs = {
        "faithfulness": (answer, context), "answer_relevancy": (query, answer), "contextual_precision": (query, context),
        "contextual_recall": (expected, context), "contextual_relevancy": (query, context),
    }
    entries = []
    for metric, (terms, text) in pairs.items():
        score = X.share_present(X.distinctive_terms(terms), text)
        entries += [F.lit(metric), F.struct(score.alias("score"), (score >= threshold).alias("success"), F.lit("share of terms present").alias("reason"))]
    return F.create_map(*entries)
