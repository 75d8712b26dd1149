"""Hierarchical language identification.

A multiclass linear support vector machine over hashed byte trigrams picks the language family;
inside a family one-versus-one linear machines vote between the closely related languages.
All machines are learned from a bounded sample of the labelled rows (`per_language` of each language:
so many ids by a hash, and so many different rows of those by a hash of what they hold); every
text is predicted from the whole of it.

Defined results: a null text or one without a letter is `und` with score 0; without any labelled
row every text is; a single learned language is predicted with score 1; equal rows give equal
rows; an empty table gives an empty result; only doc_id, text and lang are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, sampled_texts

UNKNOWN = "und"
DIMS = 4096
# Families of languages by ISO 639-1 code. A code that isn't here is a family of its own.
FAMILIES = {
    "Germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "Romance": "ca es fr gl it la oc pt ro",
    "Slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "Uralic": "et fi hu",
    "Turkic": "az kk ky tr tt uz",
    "Indic": "as bn gu hi mr ne or pa sa si ur",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
ASCII_LETTER = re.compile("[A-Za-z]")
#: ASCII characters that aren't letters become spaces; other bytes stay.
LETTERS_ONLY = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and (ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def features(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed byte trigram counts of the lower-cased letters."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(LETTERS_ONLY) + b" ", np.uint8)
    space = b == 32
    b = b[~(space & np.concatenate(([False], space[:-1])))].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(DIMS, np.float32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    x = np.sqrt(np.bincount(h >> np.uint32(20), minlength=DIMS)).astype(np.float32)
    return x / np.linalg.norm(x)


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 150) -> np.ndarray:
    """Weights (bias last) of a squared-hinge machine for labels of -1 and 1, classes weighing the same; accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weigh = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    step = 1 / (4 + penalty)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (penalty * v - 2 * (x.T @ (weigh * slack * y)))
        w, v = new, new + k / (k + 3) * (new - w)
    return w


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    families: tuple[tuple[str, ...], ...]
    family_machines: np.ndarray
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        x = np.append(features(text), np.float32(1))
        if len(self.families) > 1:
            margins = 4.0 * (self.family_machines @ x)
            p = np.exp(margins - margins.max())
            p /= p.sum()
            k = int(p.argmax())
            sure = float(p[k])
        else:
            k, sure = 0, 1.0
        family = self.families[k]
        if len(family) == 1:
            return family[0], sure
        votes = dict.fromkeys(family, 0)
        belief = dict.fromkeys(family, 0.0)
        for i, a in enumerate(family):
            for b in family[i + 1 :]:
                m = float(self.pairs[a, b] @ x)
                q = 1 / (1 + np.exp(-4.0 * m))
                votes[a if m > 0 else b] += 1
                belief[a] += q
                belief[b] += 1 - q
        best = max(family, key=lambda c: (votes[c], belief[c]))
        return best, min(1.0, max(0.0, sure * belief[best] / (len(family) - 1)))


def fit(x: np.ndarray, langs: list[str], family_of: dict[str, str] = FAMILY_OF) -> LanguageModel:
    languages = tuple(sorted(set(langs)))
    groups: dict[str, list[str]] = {}
    for c in languages:
        groups.setdefault(family_of.get(c.lower().split("-")[0], c), []).append(c)
    families = tuple(tuple(v) for _, v in sorted(groups.items()))
    y = np.array(langs)
    machines = [linear_svm(x, np.where(np.isin(y, f), 1, -1).astype(np.float32)) for f in families] if len(families) > 1 else []
    pairs = {}
    for f in families:
        for i, a in enumerate(f):
            for b in f[i + 1 :]:
                own = (y == a) | (y == b)
                pairs[a, b] = linear_svm(x[own], np.where(y[own] == a, 1, -1).astype(np.float32))
    return LanguageModel(languages, families, np.array(machines), pairs)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def learn(labelled: DataFrame, per_language: int = 600) -> LanguageModel:
    """A model of labelled (doc_id, text, lang): at most per_language rows of each language go to the driver, as trigram vectors."""
    rows = labelled.filter("lang is not null and doc_id is not null").select("doc_id", "lang", "text")
    rows = sampled_texts(rows, bounded_sample(rows, "lang", "doc_id", per_language), "lang", per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(lang.as_py(), features(t)) for lang, x in zip(*batch.columns) if has_letter(t := x.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.string()), pa.array([v.tobytes() for _, v in kept], pa.binary())], ["lang", "x"])

    got = sorted((r["lang"], bytes(r["x"])) for r in rows.mapInArrow(run, "lang string, x binary").collect())
    x = np.array([np.frombuffer(v, np.float32) for _, v in got]).reshape(-1, DIMS)
    return fit(x, [k for k, _ in got])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for every row, from its text alone."""
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [model.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k for k, _ in said], pa.string()), pa.array([s for _, s in said], pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
