"""Byte-level byte-pair encoding by a lazily determinised transducer, and streaming decoding.

Method. A sequence of tokens is what greedy merging makes of its bytes exactly if merging makes of
each two neighbours' bytes just these two (merges inside the tokens come in the same order whatever
stands around them, so the first merge across a border would also happen between the two alone). The
merges are therefore compiled into a transducer whose configurations are (last token, place in the
trie of tokens, tokens not yet written): reading a byte goes on in the trie, and where a token ends
that may follow the last one, also to the trie's root. The transducer is determinised while it is
used: a state is the set of configurations alive after some bytes, and the tokens that all of them
begin with are written at once. Configurations die after at most the longest token's bytes, so the
lookahead is bounded, and a piece of any length is read once, byte by byte, without a heap or a list of
pairs. States and arcs are kept in tables of bounded size, which are emptied when they are full.

Decoding feeds tokens to a state machine of well-formed UTF-8 which keeps the at most three bytes of a
character that later tokens complete; what can't become a character turns into U+FFFD, once
for each longest ill-formed start, as the Unicode standard recommends.

Defined results. Null and empty texts have no tokens and decode to the empty text. Rows keep their
other columns, whatever these are called; repeated rows stay, an empty table gives an empty table, a null
doc_id is kept. Special tokens don't exist: their strings are ordinary text. Texts of any length are
encoded whole; a task holds one Arrow batch of texts and the tokens of one text.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from .common import release_memory, unused

#: Entries that a worker's tables of arcs, of pairs, and of decoded tokens may hold before they are emptied (about 100 MB each).
TABLE = 500_000
#: Entries of each of the two generations of pieces that a worker remembers with their tokens.
PIECES = 250_000
#: Pieces up to so many characters are remembered with their tokens.
SHORT_PIECE = 40
#: Texts from so many characters on are split piece by piece instead of into a list of pieces.
LONG_TEXT = 1 << 20

#: The rank of what doesn't merge.
NEVER = 1 << 60

Config = tuple[int, int, tuple[int, ...]]


def merges(piece: bytes, ranks: dict[bytes, int]) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
    """The parts that greedy merging leaves (the pair of least rank first, the leftmost of equals), and its history.

    The history has the rank of each merge, and at last NEVER, with the first and the last part that stand before it.
    """
    parts = [piece[i : i + 1] for i in range(len(piece))]
    history = []
    while True:
        rank, at = min(((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1)), default=(NEVER, 0))
        history.append((rank, parts[0], parts[-1]))
        if rank == NEVER:
            return parts, history
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Transducer:
    """From the bytes of a piece to its tokens; states and arcs come into being when they are first needed."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary needs a token for every byte")
        self.trie: dict[int, int] = {}
        self.ends: list[int] = [-1]  # the token that ends at a node
        self.inner: list[bool] = [False]  # whether longer tokens go on from a node
        for token, number in ranks.items():
            node = 0
            for b in token:
                key = node << 8 | b
                following = self.trie.get(key)
                if following is None:
                    following = self.trie[key] = len(self.ends)
                    self.inner[node] = True
                    self.ends.append(-1)
                    self.inner.append(False)
                node = following
            self.ends[node] = number
        self.follows: dict[tuple[int, int], bool] = {}
        self.histories: dict[int, list[tuple[int, bytes, bytes]] | None] = {}
        self.restart()

    def restart(self) -> None:
        """Empties the tables of states and arcs; state 0 is the start of a piece."""
        self.states: list[tuple[Config, ...]] = [((-1, 0, ()),)]
        self.numbers: dict[tuple[Config, ...], int] = {self.states[0]: 0}
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}

    def history(self, token: int) -> list[tuple[int, bytes, bytes]] | None:
        """The merges that lead to a token, None if merging its bytes doesn't make it."""
        if token not in self.histories:
            parts, history = merges(self.tokens[token], self.ranks)
            self.histories[token] = history if len(parts) == 1 else None
        return self.histories[token]

    def may_follow(self, last: int, token: int) -> bool:
        """Whether merging leaves the two tokens as they are when they stand side by side (-1: at a piece's start).

        The merges of either side come in their own order, the one of less rank first. The tokens stay
        apart if at no moment the parts at the border have a rank below the next merge to their left and
        not above the next one to their right.
        """
        known = self.follows.get((last, token))
        if known is None:
            if len(self.follows) >= TABLE:
                self.follows.clear()
            known = self.follows[last, token] = self.stay_apart(last, token)
        return known

    def stay_apart(self, last: int, token: int) -> bool:
        right = self.history(token)
        if right is None or last < 0:
            return right is not None
        left = self.history(last)
        if left is None:
            return False
        i = j = 0
        while True:
            before, _, x = left[i]
            after, y, _ = right[j]
            across = self.ranks.get(x + y, NEVER)
            if across < before and across <= after:
                return False
            if before <= after:
                if before == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def arc(self, configs: tuple[Config, ...], byte: int) -> tuple[tuple[Config, ...], tuple[int, ...]]:
        """The configurations after one more byte, and the tokens that are certain by then."""
        alive: list[Config] = []
        for last, node, waiting in configs:
            node = self.trie.get(node << 8 | byte)
            if node is None:
                continue
            if self.inner[node]:
                alive.append((last, node, waiting))
            token = self.ends[node]
            if token >= 0 and self.may_follow(last, token):
                alive.append((token, 0, (*waiting, token)))
        first = alive[0][2]
        certain = min(len(c[2]) for c in alive)
        for _, _, waiting in alive:
            while waiting[:certain] != first[:certain]:
                certain -= 1
        return tuple((last, node, waiting[certain:]) for last, node, waiting in alive), first[:certain]

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:  # a token's own string is that token, whether or not merges lead to it
            return [whole]
        out: list[int] = []
        state, arcs = 0, self.arcs
        for byte in piece:
            step = arcs.get(state << 8 | byte)
            if step is None:
                configs, certain = self.arc(self.states[state], byte)
                if len(arcs) >= TABLE:
                    self.restart()
                    arcs = self.arcs
                    following = self.number(configs)
                else:
                    following = self.number(configs)
                    arcs[state << 8 | byte] = following, certain
                step = following, certain
            state = step[0]
            if step[1]:
                out += step[1]
        # of the tokenisations alive, one ends here: those inside a token would need more bytes
        out += next((waiting for _, node, waiting in self.states[state] if node == 0), ())
        return out

    def number(self, configs: tuple[Config, ...]) -> int:
        found = self.numbers.setdefault(configs, len(self.states))
        if found == len(self.states):
            self.states.append(configs)
        return found


#: Well-formed UTF-8: (first, last) lead byte, then the bounds of each continuation byte. Fixed values of the Unicode standard, table 3-7.
WELL_FORMED = (
    ((0xC2, 0xDF), (0x80, 0xBF)),
    ((0xE0, 0xE0), (0xA0, 0xBF), (0x80, 0xBF)),
    ((0xE1, 0xEC), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xED, 0xED), (0x80, 0x9F), (0x80, 0xBF)),
    ((0xEE, 0xEF), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xF0, 0xF0), (0x90, 0xBF), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xF1, 0xF3), (0x80, 0xBF), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xF4, 0xF4), (0x80, 0x8F), (0x80, 0xBF), (0x80, 0xBF)),
)


class Utf8Machine:
    """Characters from bytes that come in any portions; a state is the start of a character that is still incomplete."""

    def __init__(self) -> None:
        #: The bounds of the bytes that may follow an incomplete start; a start with no bounds left is a whole character.
        self.wanted = {bytes([b]): bounds[1:] for bounds in WELL_FORMED for b in range(bounds[0][0], bounds[0][1] + 1)}

    def feed(self, start: bytes, data: bytes) -> tuple[str, bytes]:
        """The characters that are certain after data, and the incomplete start of the next one."""
        if not start and data.isascii():
            return data.decode("ascii"), b""
        out: list[str] = []
        for byte in data:
            if start:
                bounds = self.wanted[start[:1]]
                low, high = bounds[len(start) - 1]
                if low <= byte <= high:
                    start += bytes([byte])
                    if len(start) > len(bounds):
                        out.append(start.decode("utf-8"))
                        start = b""
                    continue
                out.append("�")
                start = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif bytes([byte]) in self.wanted:
                start = bytes([byte])
            else:
                out.append("�")
        return "".join(out), start


def narrowed(pattern: str) -> re.Pattern | None:
    """The same splitting for texts of code points under 256, in sets that the faster standard library knows; None if that can't be said so."""
    sets = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        inside = [c for c in range(256) if regex.match(name, chr(c))]
        sets[name] = "".join(rf"\x{c:02x}" for c in inside)
    out, within = [], False
    for part in re.findall(r"\\p\{[LN]\}|\\.|.", pattern, re.S):
        if part in sets:
            out.append(sets[part] if within else f"[{sets[part]}]")
        elif part == r"\S" and not within:
            out.append(rf"[^{sets[chr(92) + 's']}]")
        elif part.startswith("\\") and part[1].isalnum():
            return None
        else:
            within = part == "[" or within and part != "]"
            out.append(part)
    made = re.compile("".join(out))
    signs = [chr(c) for c in range(256)]
    pairs = "".join(a + b for a in signs for b in signs) + "it's we've  I'll \n\n x\t 12ab 3.5--'d"
    return made if made.findall(pairs) == regex.findall(pattern, pairs) else None


class Pieces(dict):
    """Remembered pieces with their packed tokens; what isn't there is made."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        return self.make(piece)


class Codec:
    """Texts to packed tokens (unsigned 32-bit, little-endian) and back. Only its inputs travel; each worker compiles once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.ready = False

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "pattern": self.pattern, "ready": False}

    def compile(self) -> Codec:
        if not self.ready:
            self.splitter = regex.compile(self.pattern)
            self.transducer = Transducer(self.ranks)
            self.utf8 = Utf8Machine()
            self.narrow = narrowed(self.pattern)
            self.pieces, self.older = Pieces(self.pack), {}
            # the text of tokens that hold whole characters only
            self.whole = {i: text for i, t in self.transducer.tokens.items() for text, rest in [self.utf8.feed(b"", t)] if not rest}
            self.decoded: dict[tuple[bytes, int], tuple[str, bytes]] = {}
            self.ready = True
        return self

    def pack(self, piece: str) -> bytes:
        packed = self.older.get(piece) or self.pieces.get(piece)
        if packed is None:
            ids = self.transducer.encode(piece.encode("utf-8"))
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= SHORT_PIECE:
            if len(self.pieces) >= PIECES:  # what isn't met again while the young generation fills is forgotten
                self.pieces, self.older = Pieces(self.pack), self.pieces
            self.pieces[piece] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        """Tokens of a whole text, packed."""
        if not text:
            return b""
        splitter = self.splitter
        if self.narrow:
            try:
                text.encode("latin-1")
                splitter = self.narrow
            except UnicodeEncodeError:
                pass
        pieces: Iterable[str] = splitter.findall(text) if len(text) < LONG_TEXT else (m.group() for m in splitter.finditer(text))
        return b"".join(map(self.pieces.__getitem__, pieces))

    def stream(self, tokens: Iterable[int]) -> Iterator[str]:
        """The text of tokens, portion by portion as they come."""
        start, whole, known, names = b"", self.whole.get, self.decoded, self.transducer.tokens
        for token in tokens:
            if not start and (text := whole(token)) is not None:
                yield text
                continue
            step = known.get((start, token))
            if step is None:
                if len(known) >= TABLE:
                    known.clear()
                step = known[start, token] = self.utf8.feed(start, names[token])
            text, start = step
            yield text
        if start:
            yield "�"

    def decode(self, packed: bytes) -> str:
        return "".join(self.stream(np.frombuffer(packed, "<u4").tolist()))


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A rank file: lines of a token in base64 and its rank. A path with a scheme is read by Spark, others on the driver, where the vocabulary is installed."""
    if "://" in path:
        lines = [r.value for r in spark.read.text(path).collect()]  # one line a token of the vocabulary
    else:
        with open(path, encoding="ascii") as file:
            lines = file.read().split("\n")
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def codec(spark: SparkSession, path: str, pattern: str):
    """The codec of a vocabulary as a broadcast of the vocabulary's size, whatever the data's."""
    return spark.sparkContext.broadcast(Codec(read_ranks(spark, path), pattern))


def appended(rows: DataFrame, column: str, name: str, kind: DataType, made) -> DataFrame:
    """rows with one more column (name, or a like name that rows doesn't have), made(values of column) as an Arrow array."""
    name, at = unused(rows, name), rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, made(batch.column(at))], [*batch.schema.names, name])
        release_memory()

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, kind, False)]))


def encode(docs: DataFrame, shared, text: str = "text", name: str = "ids") -> DataFrame:
    """docs with the tokens of each text as an array of numbers."""

    def made(values: pa.Array) -> pa.Array:
        codec = shared.value.compile()
        packed = [codec.encode(v.as_py()) for v in values]
        ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))

    return appended(docs, text, name, ArrayType(IntegerType(), False), made)


def decode(rows: DataFrame, shared, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """rows with the text of each array of tokens; null counts as no tokens."""

    def made(values: pa.Array) -> pa.Array:
        codec = shared.value.compile()
        return pa.array(["".join(codec.stream(v.as_py() or ())) for v in values], pa.string())

    return appended(rows, ids, name, StringType(), made)


def round_trip(docs: DataFrame, shared) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs (doc_id, text).

    Encodes each whole text, decodes the tokens, and digests both in the same worker, so that
    neither tokens nor decoded texts travel.
    """
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.compile()
        for batch in batches:
            counts, tokens, texts = [], [], []
            for value in batch.column(1):
                packed = codec.encode(value.as_py())
                counts.append(len(packed) // 4)
                tokens.append(hashlib.sha256(packed).hexdigest())
                texts.append(hashlib.sha256(codec.decode(packed).encode("utf-8")).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(tokens, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        release_memory()

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
