"""Byte-level BPE against the tiktoken library, and the round trip."""

import codecs
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lorequarry.llm import byte_bpe
from lorequarry.llm.queries import op11_byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = byte_bpe.read_ranks(None, PATH)
CODEC = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN).compile()
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(text):
    return np.frombuffer(CODEC.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"]), max_size=80))
def test_any_text(text):
    assert ids(text) == THEIRS.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text


def test_strings_of_tokens_and_long_runs():
    rng = random.Random(5)
    names = [t.decode("utf-8", "ignore") for t in RANKS]
    texts = ["".join(rng.choices(names, k=rng.randint(1, 12))) for _ in range(3000)]
    texts += [c * n for c in ("a", "-", "=", " ", "\n", "ab", "the", "_", "é", "日", "🙂") for n in (1, 2, 3, 63, 64, 65, 129, 500, 3000)]
    texts += ["".join(rng.choices("abt ", k=rng.randint(1, 80))) for _ in range(3000)]
    for text in texts:
        assert ids(text) == THEIRS.encode_ordinary(text)


def test_tokens_that_no_merge_makes():
    """A vocabulary with a token that merges don't reach: only a piece equal to it is that token."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abcd": 257, b"aa": 258, b"aaa": 259}
    theirs = tiktoken.Encoding("tiny", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    ours = byte_bpe.Codec(ranks, r"\S+|\s+").compile()
    rng = random.Random(2)
    for text in ["abcd", "abcdx", "xabcd", *("".join(rng.choices("abcd", k=rng.randint(1, 12))) for _ in range(2000))]:
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == theirs.encode_ordinary(text)


def test_full_tables_change_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "TABLE", 50)
    monkeypatch.setattr(byte_bpe, "PIECES", 5)
    small = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN).compile()
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choices("etaoin shrdlu.\n", k=60))
        assert np.frombuffer(small.encode(text), "<u4").tolist() == THEIRS.encode_ordinary(text)
        assert len(small.transducer.arcs) <= 50 and len(small.pieces) <= 5


def test_tokens_come_after_bounded_lookahead():
    ids(" ".join("".join(random.Random(i).choices("etaoinshr", k=12)) for i in range(500)) + "a" * 5000 + "=" * 5000)
    assert max(len(waiting) for configs in CODEC.transducer.states for _, _, waiting in configs) < 64


def test_long_texts_are_streamed_alike(monkeypatch):
    text = "some words, 12 numbers\n\n" * 50
    whole = CODEC.encode(text)
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 10)
    assert CODEC.encode(text) == whole


def test_ill_formed_bytes():
    rng = random.Random(4)
    machine = byte_bpe.Utf8Machine()
    signs = [0x41, 0xC2, 0xE0, 0xED, 0xF0, 0xF4, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xF5]
    for _ in range(20000):
        data = bytes(rng.choices(signs, k=rng.randint(0, 10)))
        text, start, at = "", b"", 0
        while at < len(data):
            step = rng.randint(1, 3)
            more, start = machine.feed(start, data[at : at + step])
            text, at = text + more, at + step
        assert text + ("�" if start else "") == codecs.decode(data, "utf-8", "replace")


def test_a_byte_without_token_is_an_error():
    with pytest.raises(ValueError, match="every byte"):
        byte_bpe.Codec({b"a": 0}, r"\S+").compile()


def test_rows(spark, docs_of, odd_rows):
    docs = docs_of([*odd_rows, (11, "<|endoftext|> is 1 text ", "en", "a")]).withColumnRenamed("keys", "ids")
    shared = byte_bpe.codec(spark, PATH, public_tokenizers.PATTERN)
    coded = byte_bpe.decode(byte_bpe.encode(docs, shared), shared, ids="_ids")
    assert coded.columns == [*docs.columns, "_ids", "decoded"]
    rows = coded.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.decoded == (r.text or "") and r._ids == THEIRS.encode_ordinary(r.text or "")
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip(docs, shared).collect()}
    want = {(r.doc_id, len(r._ids), hashlib.sha256(np.array(r._ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows}
    assert digests == want
    assert byte_bpe.round_trip(docs.limit(0), shared).count() == 0


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = op11_byte_bpe(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        tokens = THEIRS.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(tokens), hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_pairs_stay_apart_exactly_if_merging_keeps_them():
    rng = random.Random(8)
    machine = CODEC.transducer
    short = [i for i, t in machine.tokens.items() if len(t) < 5]
    for _ in range(20000):
        a, b = rng.choice(short), rng.choice(short)
        parts, _ = byte_bpe.merges(machine.tokens[a] + machine.tokens[b], RANKS)
        assert machine.stay_apart(a, b) == (parts == [machine.tokens[a], machine.tokens[b]])


def test_the_faster_splitting_is_the_same():
    narrow = byte_bpe.narrowed(public_tokenizers.PATTERN)
    rng = random.Random(11)
    signs = [chr(c) for c in range(256)] + list("'''  \n\tstremdl ")
    for _ in range(20000):
        text = "".join(rng.choices(signs, k=rng.randint(1, 14)))
        assert narrow.findall(text) == CODEC.splitter.findall(text)
    assert byte_bpe.narrowed(r"\p{Lu}+|.") is None and byte_bpe.narrowed(r"\d+|\D") is None
    assert ids("naïve façade ¾ \xa0 ª") == THEIRS.encode_ordinary("naïve façade ¾ \xa0 ª") and ids("œuvre naïve 日") == THEIRS.encode_ordinary("œuvre naïve 日")
