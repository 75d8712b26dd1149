"""Secrets without a digit and secrets of many signs are found whole."""

import random
import time
import tracemalloc

import pytest

from lorequarry.llm import pii

UUID = "550e8400-e29b-41d4-a716-446655440000"
JWT = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6-kpvaG4_RG9lIn0-x.SflKxwRJSMeKKF2QT4fwpMe-Jf36POk_yJV-adQssw5c"
BASE64 = "wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLE/KEY9q2/Zz+aB3/xx=="


@pytest.mark.parametrize(
    ("before", "value", "after", "kind"),
    [
        ("set password=", "correcthorse", " and go on", "password"),
        ("set password: ", "correcthorse", "", "password"),
        ("login with pwd = ", "correct-horse-battery-staple-and-more-words", " today", "password"),
        ('the db1.password = "', "correcthorse", '" is set', "password"),
        ('token = "', "QwErTyUiOpAsDfGhJkLz", '" in the file', "token"),
        ('auth_token = "', "QwErTyUiOpAsDfGhJkLz", '"', "token"),
        ('{"secret": "', "QwErTyUiOpAsDfGhJkLz", '"}', "token"),
        ("a secret=", UUID, " of theirs", "token"),
        ('api_key = "', UUID, '"', "token"),
        ("Authorization: Bearer ", JWT, " was sent", "token"),
        ("token=", JWT, "", "token"),
        ("secret = ", BASE64, " here", "token"),
    ],
)
def test_whole_value(before, value, after, kind):
    _, spans = pii.find_spans(f"some words {before}{value}{after}", pii.trained())
    start = len("some words ") + len(before)
    assert spans == [(kind, start, start + len(value))]


def test_plain_words_after_cues_stay():
    for text in ("the token bucket of a router", "a secret garden behind the house", "your password expires tomorrow", f"request {UUID} was served", "they pass the api gateway and access rooms"):
        assert pii.find_spans(text, pii.trained())[1] == []


def test_windows_in_linear_time():
    for text in ("token " * 40_000, "token=" * 40_000, "password" + " " * 200_000, "a-1" * 60_000, "secret_" * 30_000):
        began = time.time()
        for _ in pii.windows(text, []):
            pass
        assert time.time() - began < 5


def test_held_out_values_of_any_kind():
    r, model, hit, n = random.Random(8), pii.trained(), 0, 400
    for _ in range(n):
        value = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(r.randint(8, 30)))
        text = f"words {r.choice(('password', 'token', 'secret', 'pwd'))}{r.choice(('=', ' = ', ': '))}{value} more"
        hit += any(text[s:e] == value for _, s, e in pii.find_spans(text, model)[1])
    assert hit / n > 0.97


def test_long_pieces_are_read_whole():
    model, tail = pii.trained(), ";password=q1w2e3r4t5y6"
    for n in (*range(3970, 4030, 3), 8000, 100_000, 1_000_000):
        for fill in ("b", "ab-c."):
            text = "1" + (fill * n)[:n] + tail
            assert pii.find_spans(text, model)[1][-1] == ("password", len(text) - 12, len(text))


def test_a_long_piece_takes_time_and_memory_in_proportion():
    model, took = pii.trained(), []
    for n in (20_000, 80_000):
        tracemalloc.start()
        began = time.time()
        pii.find_spans("a-1" * n, model)
        took.append((time.time() - began, tracemalloc.get_traced_memory()[1]))
        tracemalloc.stop()
    assert took[1][0] < 10 * took[0][0] and took[1][1] < 6 * took[0][1] and took[1][1] < 1500 * 80_000


def test_short_values_after_a_cue():
    """Values of four and five characters count where a cue and an equal sign stand before them and nothing goes on after them."""
    field = pii.trained()

    def values(text):
        return [text[s:e] for _, s, e in pii.find_spans(text, field)[1]]

    assert values("the secret=abcde was") == ["abcde"] and values("password=ab1c2 ok") == ["ab1c2"] and values("password=ab1c2") == ["ab1c2"]
    assert values("password=p@ss!w0rd#9 done") == ["p@ss!w0rd"]
    assert values("the token is good") == values("secret: see below") == values("password: yes please") == values("set secret=abc") == []
