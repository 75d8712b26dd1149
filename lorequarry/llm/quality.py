"""Quality scores by Bradley-Terry ranking.

Each document has a strength linear in features of its whole text. Strengths are learned from
preference pairs (a document marked 1 over one marked 0) by the logistic loss on the difference
of their features, from a bounded sample of the labelled rows (`per_label` of each label: so many
ids by a hash, and so many different rows of those by a hash of what they hold). Documents are
then accepted above a quantile of the strengths; the quantile
is the one that agrees best with the sample's labels. The score maps the accepting strength to
`accept_at`.

Defined results: null counts as the empty text, which has a score like any other; without rows of
both labels the strength is the same for all and every document is accepted; equal rows give
equal rows; empty tables give an empty result; only doc_id, text and quality are read; columns named score or
predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, release_memory, sampled_texts
from .html_extraction import STOP_WORDS
from .language_id import remainder

ACCEPT_AT = 0.3
#: Cuts at which a share or logarithm changes slope.
HINGES = (0.02, 0.1, 0.3, 0.6)


def measures(text: str | None) -> np.ndarray:
    """Figures of a whole text: sizes, character classes, repetition and function words."""
    text = text or ""
    words = text.split()
    n = max(1, len(words))
    b = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = max(1, int(b.sum()))
    letters = b[65:91].sum() + b[97:123].sum() + b[128:].sum()
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [x for x in text.split("\n") if x.strip()]
    stop = sum(w in STOP_WORDS for w in map(str.lower, words))
    shares = [
        b[65:91].sum() / max(1, letters),
        b[48:58].sum() / size,
        b[[35, 36, 37, 38, 42]].sum() / size,
        b[[33, 63]].sum() / n,
        b[[124, 92, 47, 60, 62, 123, 125, 91, 93, 61, 94, 95, 126]].sum() / n,
        b[[44, 46, 58, 59]].sum() / n,
        1 - letters / size,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(words)) / n,
        stop / n,
        1 - len(set(lines)) / max(1, len(lines)),
        float((lengths > 20).mean()),
        float((lengths <= 2).mean()),
        sum(w.isupper() for w in words) / n,
    ]
    sizes = [np.log1p(len(words)) / 10, np.log1p(size / n) / 5, min(float(lengths.std()), 20.0) / 10, np.log1p(n / max(1, len(lines))) / 10, float(not words)]
    x = np.array(shares, float)
    return np.concatenate([x, *(np.maximum(0, x - h) for h in HINGES), *(np.minimum(x, h) / h for h in HINGES[:2]), sizes])


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    width: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, rising with the strength; ACCEPT_AT at the threshold."""
        z = (self.strength(x) - self.threshold) / self.width + np.log(ACCEPT_AT / (1 - ACCEPT_AT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, labels: np.ndarray, pairs: int = 20000, penalty: float = 1e-3, rounds: int = 300, seed: int = 5) -> QualityModel:
    """Strengths from preference pairs drawn between the two labels, and the accepting quantile."""
    width = x.shape[1] if x.ndim == 2 and len(x) else len(measures(""))
    good, bad = x[labels == 1], x[labels == 0]
    if not len(good) or not len(bad):
        return QualityModel(np.zeros(width), np.ones(width), np.zeros(width), -1.0, 1.0)
    mean, spread = x.mean(0), x.std(0) + 1e-9
    spread[spread < 1e-6] = 1
    scaled = lambda v: np.clip((v - mean) / spread, -8, 8)
    draw = np.random.default_rng(seed)
    d = scaled(good)[draw.integers(0, len(good), pairs)] - scaled(bad)[draw.integers(0, len(bad), pairs)]
    w = v = np.zeros(width)
    step = 1 / (0.25 * np.linalg.norm(d, 2) ** 2 / pairs + penalty)
    for k in range(rounds):
        new = v + step * (d.T @ (1 / (1 + np.exp(np.clip(d @ v, -40, 40)))) / pairs - penalty * v)
        w, v = new, new + k / (k + 3) * (new - w)
    s = scaled(x) @ w
    order = np.argsort(s, kind="stable")
    # rejecting the lowest k: the cut with the fewest disagreements, labels weighing the same; the middle of equal ones
    weigh = np.where(labels[order] == 1, 0.5 / (labels == 1).sum(), -0.5 / (labels == 0).sum())
    cost = np.concatenate(([0.0], np.cumsum(weigh)))
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    k = int(best[len(best) // 2])
    ranked = s[order]
    quantile = k / len(s)
    low, high = ranked[max(0, k - 1)], ranked[min(k, len(s) - 1)]
    threshold = float(np.quantile(s, quantile) if low == high else (low + high) / 2)
    return QualityModel(mean, spread, w, threshold, float(s.std()) / 4 + 1e-9)


def learn(docs: DataFrame, labels: DataFrame, per_label: int = 2000) -> QualityModel:
    """A model of the labelled documents: at most per_label rows of each label go to the driver, as measures.

    A document with several labels counts with the highest.
    """
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = sampled_texts(docs.select("doc_id", "text"), bounded_sample(known, "quality", "doc_id", per_label), "quality", per_label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [measures(v.as_py()).tobytes() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(x, pa.binary())], ["quality", "x"])

    got = sorted((r["quality"], bytes(r["x"])) for r in rows.mapInArrow(run, "quality int, x binary").collect())
    return fit(np.array([np.frombuffer(v) for _, v in got]), np.array([q for q, _ in got]))


def score_column(model: QualityModel, text: Column) -> Column:
    """The score of a text as a column; only the text goes to Python and only the score comes back."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(model.score(np.array([measures(x.as_py()) for x in batch])) if len(batch) else np.zeros(0), pa.float64())
        release_memory()

    return F.arrow_udf(run, "double").asNondeterministic()(text)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs with score and predicted (1 if the score reaches ACCEPT_AT) added, for every row."""
    return docs.withColumn("score", score_column(model, F.col("text"))).withColumn("predicted", (F.col("score") >= ACCEPT_AT).cast("int"))


def learn_from_split(docs: DataFrame, labels: DataFrame, held_out: int = 5) -> QualityModel:
    """A model that has seen no label of a document with remainder 0."""
    return learn(docs, labels.filter(remainder(F.col("doc_id"), held_out) != 0))
