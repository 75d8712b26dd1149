"""Personal data and secrets in whole texts.

Four base kinds are defined by patterns and checks; their spans are always reported. A
semi-Markov conditional random field adds the kinds that no pattern pins down (access keys,
passwords, tokens): it scores whole candidate segments, and a dynamic program over segments of
at most `max_tokens` tokens, and over whole runs of a value's characters whatever their tokens,
chooses boundaries and types jointly. The field works on the windows around digits and after cue
words (password, token, ...) that base spans leave free; everything outside them is no entity, as a
candidate segment must hold a digit or follow a cue. A window is a whole piece without white space, however
long: a token of it leaves some 300 bytes behind while it is decoded. The weights are learned here, by the gradient of
the conditional likelihood on generated sentences (fixed seed), and travel with the task.

Defined results: a null or empty text has no spans; texts are scanned whole and in linear time;
equal rows give equal rows; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("key", "password", "token")
ORDER = {k: i for i, k in enumerate(BASE_KINDS + ADDED_KINDS)}

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_BREAK = re.compile(r"[^A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        x = 2 * int(d)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping e-mail addresses: each '@' with a domain, and the local run before it."""
    at = 0  # nothing before it can be matched any more
    seen = 0
    for m in iter_from(DOMAIN, text):
        sign = m.start()
        low = max(at, seen)
        start = sign
        # back over the local part, a stretch of bounded length at a time
        while start > low:
            step = max(low, start - 64)
            tail = LOCAL_TAIL.search(text, step, start) if step else LOCAL_TAIL.search(text, 0, start)
            if tail is None:
                break
            start = tail.start()
            if start > step:
                break
        if start < sign:
            yield "email", start, m.end()
            at = m.end()
        seen = sign + 1


def iter_from(pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """Matches beginning at every '@', also those inside the domain of an earlier failed one."""
    pos = text.find("@")
    while pos >= 0:
        m = pattern.match(text, pos)
        if m:
            yield m
        pos = text.find("@", pos + 1)


def base_spans(text: str) -> list[Span]:
    """The spans of the base kinds, by start and then kind; failing matches are dropped without another try."""
    out: list[Span] = []
    if "@" in text:
        out += emails(text)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x) < 30 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m.group().split("."))):
                out.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 60 and 12 <= len(digits := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append(("phone", m.start(), m.end()))
    out.sort(key=lambda s: (s[1], ORDER[s[0]]))
    return out


# --- the semi-Markov field -------------------------------------------------------------------

TOKEN = re.compile(r"[^\W_]+|\S")
HEX = re.compile(r"[0-9a-f]+\Z")
CAPS = re.compile(r"[A-Z0-9]+\Z")
LABELS = ("none", *ADDED_KINDS)
#: Words before a value that tell its kind.
CUES = {
    "password": "pass", "passwd": "pass", "pwd": "pass", "passphrase": "pass", "passwort": "pass", "contraseña": "pass",
    "token": "token", "secret": "token", "bearer": "token", "api": "token", "apikey": "token", "auth": "token",
    "akia": "key", "access": "key",
}
KEY_HEADS = ("AKIA", "ASIA", "ghp", "gho", "sk", "xox", "eyJ")
#: Characters of one value, as in UUIDs, base64 and web tokens, with the padding after it.
RUN = re.compile(r"[^\s\"'`<>=:,;(){}\[\]]+(?:={1,2}(?![\w=]))?")
#: A cue is looked for among so many tokens before a segment.
CUE_REACH = 6

#: What may stand after a short value.
VALUE_ENDS = " \t\r\n\"'`<>,;)"


class Window:
    """Tokens of a stretch of text with what segment features need."""

    __slots__ = ("text", "tokens", "glued", "cue", "context")

    def __init__(self, text: str, start: int, end: int):
        self.text = text
        self.tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, start, end)]
        #: token i follows the one before without white space
        self.glued = [i > 0 and self.tokens[i - 1][1] == s for i, (s, _) in enumerate(self.tokens)]
        self.cue = [CUES.get(text[s:e].lower(), "") for s, e in self.tokens]
        #: the cue before each token, and whether an equal sign or colon stands between
        same: dict[tuple[str, bool], tuple[str, bool]] = {}
        self.context = [same.setdefault(c, c) for c in map(self.before, range(len(self.tokens)))]

    def before(self, i: int) -> tuple[str, bool]:
        equal = False
        for back in range(i - 1, max(-1, i - CUE_REACH - 1), -1):
            if self.cue[back]:
                return self.cue[back], equal
            s, e = self.tokens[back]
            equal |= self.text[s:e] in "=:"
            if e - s > 4:
                break
        return "", equal

    def may_start(self, i: int, s: int, e: int) -> bool:
        """Whether a segment of text from token i on is long enough and holds a digit or follows a cue; a whole value after a cue and an equal sign may be shorter."""
        cue, equal = self.context[i]
        if e - s < 6:
            return e - s >= 4 and equal and bool(cue) and (e == len(self.text) or self.text[e] in VALUE_ENDS)
        return bool(cue or DIGIT.search(self.text, s, e))

    def candidates(self, max_tokens: int) -> Iterator[list[int]]:
        """For each end, from the first token's on, the starts of candidate segments: unbroken, with a digit or after a cue, six characters at least (four for a whole value after a cue); bounded or a whole run."""
        n, text = len(self.tokens), self.text
        runs: dict[int, list[int]] = {}
        if n:
            starts, ends = {s: i for i, (s, _) in enumerate(self.tokens)}, {e: i + 1 for i, (_, e) in enumerate(self.tokens)}
            for m in RUN.finditer(text, self.tokens[0][0], self.tokens[-1][1]):
                s, e = m.start(), m.end()
                while s < e and not text[s].isalnum():
                    s += 1
                while s < e and not (text[e - 1].isalnum() or text[e - 1] == "="):
                    e -= 1
                i, j = starts.get(s), ends.get(e)
                # bounded ones come below
                if i is not None and j is not None and (j - i > max_tokens or text[e - 1] == "=") and self.may_start(i, s, e):
                    runs.setdefault(j, []).append(i)
        for j in range(1, n + 1):
            found, e = [], self.tokens[j - 1][1]
            if text[e - 1].isalnum():
                for i in range(j - 1, max(0, j - max_tokens) - 1, -1):
                    s = self.tokens[i][0]
                    if text[s].isalnum() and self.may_start(i, s, e):
                        found.append(i)
                    if not self.glued[i]:
                        break
            yield runs.get(j, []) + found[::-1]

    def features(self, i: int, j: int) -> list[str]:
        """Features of tokens i to j as one whole segment."""
        text, (s, e) = self.text, (self.tokens[i][0], self.tokens[j - 1][1])
        value = text[s:e]
        n = e - s
        digits = sum(c.isdigit() for c in value)
        size = next((str(k) for k in (7, 9, 15, 19, 20, 31, 39, 64) if n <= k), "more")
        shape = "hex" if HEX.match(value) else "caps" if CAPS.match(value) else "alnum" if value.isalnum() else "mixed"
        shape = "digits" if digits == n else shape
        left = text[s - 1] if s else " "
        right = text[e] if e < len(text) else " "
        side = lambda c: "space" if c.isspace() else "quote" if c in "\"'`<>" else "equal" if c in "=:" else "stop" if c in ".,;!?)" else "other"
        cue, equal = self.context[i]
        head = next((h for h in KEY_HEADS if value.startswith(h)), "")
        return [
            "bias", f"size:{size}", f"shape:{shape}", f"size:{size},shape:{shape}", f"digits:{min(4, 5 * digits // n)}", f"left:{side(left)}", f"right:{side(right)}",
            f"cue:{cue},{equal}", f"cue:{cue},{equal},shape:{shape}", f"head:{head},size:{size}", f"tokens:{min(4, j - i)}",
        ]

    def outside(self, i: int) -> list[str]:
        """Features of token i as no entity."""
        s, e = self.tokens[i]
        value = self.text[s:e]
        kind = "word" if value.isalpha() else "digits" if value.isdigit() else "alnum" if value.isalnum() else "sign"
        return ["bias", f"kind:{kind}", f"kind:{kind},{min(4, (e - s) // 6)}"]


class SemiCrf:
    """Weights of segments and of neighbouring labels, with decoding and training."""

    def __init__(self, max_tokens: int = 8):
        self.max_tokens = max_tokens
        self.weights: dict[tuple[str, str], float] = {}

    def segments(self, w: Window) -> Iterator[list[tuple[int, str, list[tuple[str, str]]]]]:
        """For each end the segments that may stand there: start, label, features; first for the end of nothing."""
        yield []
        for j, starts in enumerate(w.candidates(self.max_tokens), 1):
            here = [(j - 1, "none", [("none", f) for f in w.outside(j - 1)])]
            for i in starts:
                features = w.features(i, j)
                here += [(i, y, [(y, f) for f in features]) for y in ADDED_KINDS]
            yield here

    def score(self, features: list[tuple[str, str]]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def decode(self, w: Window) -> list[Span]:
        """The best segmentation, by dynamic programming over segment ends and labels. A token leaves a few numbers behind."""
        k = len(LABELS)
        to = {y: [self.weights.get((x, "to " + y), 0.0) for x in LABELS] for y in LABELS}
        scores, begins, befores = array("d", [0.0] + [-math.inf] * (k - 1)), array("q", [0] * k), array("b", [0] * k)
        for j, here in enumerate(self.segments(w)):
            if not j:
                continue
            at = [(-math.inf, 0, 0)] * k
            for i, y, features in here:
                y_at = LABELS.index(y)
                before, _, x = max((scores[i * k + x] + to[y][x], LABELS[x], x) for x in range(k))
                total = before + self.score(features)
                if total > at[y_at][0]:
                    at[y_at] = total, i, x
            for total, i, x in at:
                scores.append(total)
                begins.append(i)
                befores.append(x)
        out, j = [], len(w.tokens)
        y = max(range(k), key=lambda y: scores[j * k + y])
        while j:
            i, x = begins[j * k + y], befores[j * k + y]
            if y:
                out.append((LABELS[y], w.tokens[i][0], w.tokens[j - 1][1]))
            j, y = i, x
        return out[::-1]

    def fit(self, sentences: list[tuple[str, list[Span]]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-3) -> SemiCrf:
        """Stochastic gradient ascent on the conditional log-likelihood of the segmentations."""
        cases = []
        for text, gold in sentences:
            w = Window(text, 0, len(text))
            segments = list(self.segments(w))
            wanted = {(s, e): k for k, s, e in gold}
            path, j, last = [], 0, "none"
            ends = {w.tokens[i][0]: i for i in range(len(w.tokens))}
            while j < len(w.tokens):
                hit = next(((k, e) for (s, e), k in wanted.items() if ends.get(s) == j), None)
                k, stop = (hit[0], next(t for t in range(j + 1, len(w.tokens) + 1) if w.tokens[t - 1][1] == hit[1])) if hit else ("none", j + 1)
                found = next((f for i, y, f in segments[stop] if i == j and y == k), None)
                if found is None:
                    break
                path += [*found, (last, "to " + k)]
                j, last = stop, k
            if j == len(w.tokens):
                cases.append((segments, path))
        turn = random.Random(7)
        for epoch in range(epochs):
            turn.shuffle(cases)
            step = rate / (1 + 0.3 * epoch)
            for segments, path in cases:
                change: dict[tuple[str, str], float] = {}
                for f in path:
                    change[f] = change.get(f, 0.0) + 1.0
                for f, p in self.expected(segments):
                    change[f] = change.get(f, 0.0) - p
                for f, g in change.items():
                    if g:
                        old = self.weights.get(f, 0.0)
                        self.weights[f] = old + step * (g - decay * old)
        return self

    def expected(self, segments) -> Iterator[tuple[tuple[str, str], float]]:
        """Features with their expected counts, by the forward and backward sums."""
        n = len(segments) - 1
        own = [[self.score(f) for _, _, f in here] for here in segments]
        to = {(x, y): self.weights.get((x, "to " + y), 0.0) for x in LABELS for y in LABELS}
        ahead: list[dict[str, float]] = [{"none": 0.0}] + [{} for _ in range(n)]
        for j in range(1, n + 1):
            sums: dict[str, list[float]] = {}
            for (i, y, _), s in zip(segments[j], own[j]):
                sums.setdefault(y, []).extend(a + to[x, y] + s for x, a in ahead[i].items())
            ahead[j] = {y: log_sum(v) for y, v in sums.items()}
        back: list[dict[str, list[float]]] = [{} for _ in range(n + 1)]
        done = [dict.fromkeys(LABELS, 0.0) if j == n else {} for j in range(n + 1)]
        for j in range(n, 0, -1):
            if j < n:
                done[j] = {y: log_sum(v) for y, v in back[j].items()}
            for (i, y, _), s in zip(segments[j], own[j]):
                for x in ahead[i]:
                    back[i].setdefault(x, []).append(to[x, y] + s + done[j].get(y, -math.inf))
        total = log_sum(list(ahead[n].values()))
        for j in range(1, n + 1):
            for (i, y, features), s in zip(segments[j], own[j]):
                p = 0.0
                for x, a in ahead[i].items():
                    q = math.exp(a + to[x, y] + s + done[j].get(y, -math.inf) - total)
                    p += q
                    yield (x, "to " + y), q
                for f in features:
                    yield f, p


def log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else top


def sentences(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Generated sentences with their entities: secrets as they are written, and numbers, codes and settings that are none."""
    r = random.Random(seed)
    pick = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    low, up, num, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"

    def with_digit(make):
        while not DIGIT.search(x := make()):
            pass
        return x

    def uuid():
        return "-".join(pick(hexa, k, k) for k in (8, 4, 4, 4, 12))

    def base64(a, b, signs="+/"):
        ends = low + up + num
        return pick(ends, 1, 1) + pick(ends * 3 + signs * 3, a, b) + pick(ends, 1, 1)

    def jwt():
        return "eyJ" + ".".join(base64(a, b, "-_") for a, b in ((20, 40), (30, 120), (30, 45)))

    entity = {
        "key": [
            ("", lambda: with_digit(lambda: r.choice(("AKIA", "ASIA")) + pick(up + num, 16, 16)), ""),
            ("", lambda: r.choice(("ghp_", "gho_")) + with_digit(lambda: pick(low + up + num, 36, 36)), ""),
            ("", lambda: r.choice(("sk-", "sk_")) + with_digit(lambda: pick(low + up + num, 24, 40)), ""),
        ],
        "password": [(f"{c}{eq}{q}", make, q) for c in ("password", "passwd", "pwd", "Password") for eq in ("=", ": ", " = ") for q in ("", '"') for make in (
            lambda: with_digit(lambda: pick(r.choice((hexa, low + num, low + up + num)), 6, 24)),
            lambda: pick(r.choice((low, low + up)), 6, 24),
            lambda: "-".join(pick(low, 3, 8) for _ in range(r.randint(2, 7))),
        )],
        "token": [(f"{c}{eq}{q}", make, q) for c in ("token", "secret", "api_key", "auth_token", "Token") for eq in (" = ", "=", ": ") for q in ('"', "'", "") for make in (
            lambda: with_digit(lambda: pick(r.choice((hexa, hexa, low + up + num)), 20, 48)),
            lambda: pick(low + up, 20, 48),
            lambda: r.choice((uuid, jwt, lambda: base64(18, 80) + r.choice(("", "=", "=="))))(),
        )] + [("", jwt, ""), ("Bearer ", jwt, "")],
    }
    plain = [
        lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}.", lambda: str(r.randint(1900, 2100)), lambda: f"{r.randint(1, 999)},{pick(num, 3, 3)}.{pick(num, 2, 2)}", lambda: f"{pick(num, 4, 4)}-{pick(num, 2, 2)}-{pick(num, 2, 2)}",
        lambda: f"page={r.randint(1, 99)}", lambda: f"x = {r.randint(1, 99999)}", lambda: f"id={pick(num, 4, 9)}", lambda: f"utm_source={pick(low, 4, 9)}{pick(num, 0, 1)}", lambda: pick(up, 2, 5) + pick(num, 2, 4), lambda: pick(low, 3, 9) + pick(num, 1, 2),
        lambda: f"{pick(num, 3, 3)}-{pick(num, 4, 4)}", lambda: pick(num, 6, 20), lambda: f"{r.randint(256, 999)}.{r.randint(0, 999)}.{r.randint(0, 999)}.{r.randint(0, 999)}", lambda: f"https://{pick(low, 3, 8)}.example.com/{pick(low, 2, 6)}/{pick(num, 2, 6)}", lambda: f"version={r.randint(1, 9)}.{r.randint(0, 99)}.{r.randint(0, 9)}",
        lambda: f"{r.choice(('commit', 'build', 'sha', 'md5'))} {pick(hexa, 7, 40)}", lambda: f"{pick(low, 3, 7)}={pick(low, 3, 12)}", lambda: f"key {r.randint(1, 9)} of {r.randint(10, 99)}", lambda: f"token {r.randint(1, 9999)}", lambda: f"ISO-{pick(num, 4, 5)}",
        uuid, lambda: f"{r.choice(('request', 'trace', 'id:'))} {uuid()}", lambda: f"{r.choice(list(CUES))} {pick(low, 2, 12)}", lambda: f"{r.choice(list(CUES))} {pick(low, 2, 9)} {pick(low, 2, 9)}", lambda: f"{pick(low, 3, 8)}-{pick(low, 3, 8)}-{pick(num, 1, 4)}.{pick(low, 2, 4)}",
    ]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(pick(low, 2, 9) + r.choice(("", "", "", ",", ".")) for _ in range(r.randint(0, 3))) + " "
            if r.random() < 0.5:
                kind = r.choice(ADDED_KINDS)
                before, make, after = r.choice(entity[kind])
                text += before
                value = make()
                spans.append((kind, len(text), len(text) + len(value)))
                text += value + after
            else:
                text += r.choice(plain)()
            text += r.choice(("", "", ".", ",")) + " "
        out.append((text, spans))
    return out


@lru_cache(maxsize=2)
def trained(n: int = 800, max_tokens: int = 8) -> SemiCrf:
    return SemiCrf(max_tokens).fit(sentences(n, seed=11))


CUE = re.compile(rf"(?<![^\W_])(?:{'|'.join(sorted(CUES, key=len, reverse=True))})(?![^\W_])", re.IGNORECASE)
#: What may stand between a cue and its value: more of a name, quotes, an equal sign or colon.
LINK = re.compile(r"(?:[_-][^\W_]{1,16}){0,3}[\"'`]?[ \t]{0,4}(?:[=:]>?[ \t]{0,4})?[\"'`]?")
TRIGGER = re.compile(r"[0-9]")
TRIGGER_OR_CUE = re.compile(f"[0-9]|{CUE.pattern}", re.IGNORECASE)
SPACE = re.compile(r"\s")
#: A window takes at most so many characters before and after the piece that holds the trigger.
REACH = 24


def windows(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """Stretches around pieces of six or more characters that hold a digit or a cue, with the value after a cue, clear of taken spans."""
    at, k, size = 0, 0, len(text)
    blocked = sorted((s, e) for _, s, e in taken)
    folded = text.lower()
    cued = any(c in folded for c in CUES)
    trigger = TRIGGER_OR_CUE if cued else TRIGGER
    m = trigger.search(text)
    while m:
        p = m.start()
        while k < len(blocked) and blocked[k][1] <= p:
            at = max(at, blocked[k][1])
            k += 1
        if k < len(blocked) and blocked[k][0] <= p:
            at = blocked[k][1]
            m = trigger.search(text, at)
            continue
        limit = blocked[k][0] if k < len(blocked) else size
        low = max(at, *(text.rfind(c, at, p) + 1 for c in " \n\t\r"))
        stop = SPACE.search(text, p, limit)
        end = stop.start() if stop else limit
        cue = CUE.search(text, p, end) if cued else None
        while cue:  # on to the end of the value, which may hold or precede another cue
            value = LINK.match(text, cue.end(), limit).end()
            if value >= end:
                stop = SPACE.search(text, value, limit)
                end = stop.start() if stop else limit
            cue = CUE.search(text, cue.end(), end)
        if end - low >= 6:
            first = max(at, low - REACH)
            if first > at and (gap := SPACE.search(text, first, low)):
                first = gap.start()
            yield first, end
        at = end
        m = trigger.search(text, max(end, p + 1))


def find_spans(text: str | None, model: SemiCrf) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans with those the model adds, each by start and kind."""
    if not text:
        return [], []
    base = base_spans(text)
    added: list[Span] = []
    for start, end in windows(text, base):
        added += model.decode(Window(text, start, end))
    if not added:
        return base, base
    return base, sorted({*base, *added}, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detect_pii(docs: DataFrame, model: SemiCrf | None = None) -> DataFrame:
    """For every row: doc_id, counts of the base kinds, their joined spans (base), and all spans."""
    rows = docs.select("doc_id", "text")
    field = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_spans(x.as_py(), field) for x in batch.column(1)]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in BASE_KINDS]
            text = [joined(base) for base, _ in found]
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in text]
            columns = [batch.column(0), *counts, pa.array(sha, pa.string()), pa.array(text, pa.string()), pa.array([joined(x) for _, x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "base_spans", "spans"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, base_spans string, spans string")
