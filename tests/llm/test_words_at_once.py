"""Words of many texts are hashed as arrays: the words and shingles of words_of, told apart without a call for each of them."""

import random

import numpy as np
import pyarrow as pa
import xxhash

from lorequarry.functions import words as W
from lorequarry.llm import near_text


def test_no_call_for_each_word(monkeypatch):
    calls, digest = [], xxhash.xxh64_intdigest
    monkeypatch.setattr(near_text.xxhash, "xxh64_intdigest", lambda *x: calls.append(1) or digest(*x))
    assert len(near_text.shingles(near_text.words_of(" ".join(f"w{i}" for i in range(1000))))) == 996
    assert len(calls) < 10


def test_words_of_texts_of_any_kind(monkeypatch):
    monkeypatch.setattr(W, "SPAN", 200)
    rng = random.Random(5)
    some = ["a", "A", "ab", "abcdefgh", "abcdefghi", "a\0", "\0", "é", "É", " ", "\x1c", "x" * 64, "x" * 65, "X" * 66, "x" * 500, "x" * 499 + "y", "abcdefghabcdefgh", "wort"]
    gaps = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "  \n"]
    texts = ["".join(rng.choice(some) + rng.choice(gaps) for _ in range(rng.randrange(12)))[rng.randrange(2) :] for _ in range(400)] + [None, "", "  ", "a", *some]
    found, hashes = list(near_text.all_shingles(pa.array(["cut off", *texts]).slice(1))), []
    for part in W.spans(pa.array(texts)):
        hashes += near_text.word_hashes(part)[0].tolist()
    words = [near_text.words_of(t) for t in texts]
    assert [n for n, _ in found] == list(map(len, words))
    flat = [w for x in words for w in x]
    assert len(flat) == len(hashes) and len(set(zip(flat, hashes))) == len(set(flat)) == len(set(hashes))
    for x, (_, got) in zip(words, found):
        runs = {tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} if x else set()
        assert len(got) == len(runs) and (np.diff(got.astype(object)) > 0).all() and (got == near_text.shingles(x)).all()
