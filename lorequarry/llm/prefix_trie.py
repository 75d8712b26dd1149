"""The prefix trie of conversations by an external mergesort that knows common prefixes.

Method. A turn is a 16-byte digest of its role and text, a conversation the string of its turns' digests.
Tasks cut what they read into runs, sort them, and write them with the number of turns that each
conversation shares with the one before it in its run (LCP). The runs are dealt by ranges of (turns, conv_id)
and merged in each range by a loser tree that compares these numbers first and turns only from the shared
ones on. The merged stream goes through a stack, the path of open nodes: a conversation closes the
nodes below its LCP and opens those of its remaining turns. A closed node is finished, and its counts pass
to its parent.

Only nodes on the path of a range's first or last conversation can go on in other ranges. Those are written as
partial paths, and folded in the order of ranges by the same stack, FAN ranges a task, until one task
is left with at most FAN ranges' paths. As copies of a conversation are ordered by conv_id, a group of copies of any size
is spread over ranges like any other rows. The ends of a node with many copies are written as lists of
at most `ids` numbers, and digested in order by a streaming task, which holds one list at a time.

Defined results. Rows without conv_id take no part; turns with equal numbers are ordered by the digest
of role and text; repeated rows are turns of their own; null roles and texts are empty; other columns are left out; an empty
table has no nodes, not even a root. Two different turns count as equal only if their MD5 digests are equal. The
base of a conversation is conv_id - pmod(conv_id, 20). A conversation's digests are one record of 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, release_memory, word_count

#: Bytes of a turn's digest.
KEY = 16
#: Ranges whose border paths one task folds.
FAN = 64
#: Parents whose children may be joined by broadcast: 200,000 rows of 24 bytes.
BROADCAST_PARENTS = 200_000
#: Parts that the children of a parent are dealt to otherwise.
SALTS = 64
#: SHA-256 of no members.
NOBODY = hashlib.sha256(b"").hexdigest()

RUN_SCHEMA = "run long, place int, lcp int, conv_id long, keys binary, words array<int>"
STEP_SCHEMA = (
    "kind string, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "prefix binary, parent_prefix binary, place long, side int, key binary, words int, ends string"
)
STEP_NAMES = [part.split()[0] for part in STEP_SCHEMA.split(", ")]
STEP_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
STEP_ARROW = pa.schema([(part.split()[0], STEP_TYPES[part.split()[1]]) for part in STEP_SCHEMA.split(", ")])


@dataclass(frozen=True)
class Limits:
    """What a task holds at most; the results don't depend on it."""

    run: int = 16_384  # conversations of a run
    run_bytes: int = 16 << 20  # digests of a run
    range: int = 100_000  # conversations of a range, about
    range_bytes: int = 16 << 20  # digests of a range, about
    kids: int = 1_000  # finished children that wait for an open parent
    ids: int = 4_096  # numbers in a list of ends
    spread: int = 4_096  # conversations that are worth a range of their own


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, keys, words) of every conversation, opened by the first turns of its base conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("late"), "turn", F.md5(F.concat(F.char_length(role), F.lit(":"), role, text)).alias("key"), word_count(text).cast("int").alias("words")).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("own"))
    heads = whole.filter(F.pmod("conv_id", F.lit(20)) == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, 3).alias("head"))
    opened = F.crc32(F.col("conv_id").cast("string").cast("binary")).cast("long") % 4
    own = whole.withColumn("h", opened.cast("int")).withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(20)))
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), F.col("h"))).otherwise(F.slice("own", 1, 0))
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    full = own.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))
    return full.select("conv_id", F.unhex(F.array_join("turns.key", "")).alias("keys"), F.col("turns.words").alias("words"))


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Number of leading turns that two conversations share, of which `known` are known."""
    at, end = known * KEY, min(len(a), len(b))
    while at < end and a[at : at + KEY] == b[at : at + KEY]:
        at += KEY
    return at // KEY


def sorted_runs(limits: Limits):
    """A task of the first pass: runs in order, each row with what it shares with the row before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple[bytes, int, list[int]]] = []
        size = 0

        def write() -> pa.RecordBatch:
            held.sort(key=lambda row: (row[0], row[1]))
            lcps = [0, *(shared(a[0], b[0]) for a, b in zip(held, held[1:], strict=False))]
            ids, count = part << 32 | number, len(held)
            columns = [[ids] * count, range(count), lcps, [c for _, c, _ in held], [k for k, _, _ in held], [w for _, _, w in held]]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["run", "place", "lcp", "conv_id", "keys", "words"])

        for batch in batches:
            for conv, keys, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((keys, conv, words))
                size += len(keys)
                if len(held) >= limits.run or size >= limits.run_bytes:
                    yield write()
                    held, size, number = [], 0, number + 1
        if held:
            yield write()
        release_memory()

    return run


class LoserTree:
    """Merges runs of (lcp, keys, conv_id, words); the lcp of what comes out is with what came out before it."""

    def __init__(self, runs: list[list[tuple[int, bytes, int, list[int]]]]):
        self.streams = [iter(r) for r in runs]
        self.heads = [next(s, None) for s in self.streams]
        self.lcp = [0] * len(runs)  # of each head with the last row that came out
        self.compared = 0  # turns that were looked at
        self.losers = [-1] * len(runs)
        for leaf in range(len(runs)):
            self.climb(leaf)

    def beats(self, a: int, b: int) -> bool:
        """Whether head a comes before head b; the one that doesn't notes what it shares with the other."""
        one, two = self.heads[a], self.heads[b]
        if one is None or two is None:
            return two is None
        if self.lcp[a] != self.lcp[b]:
            return self.lcp[a] > self.lcp[b]
        common = shared(one[1], two[1], self.lcp[a])
        self.compared += common - self.lcp[a] + 1
        at = common * KEY
        first = (one[1][at : at + KEY], one[2]) < (two[1][at : at + KEY], two[2])
        self.lcp[b if first else a] = common
        return first

    def climb(self, winner: int) -> None:
        """Plays a new head up to the root; places without a loser wait for the other side while the tree is set up."""
        node = (winner + len(self.losers)) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = winner
                return
            if self.beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple[int, bytes, int, list[int]]]:
        while self.losers and (head := self.heads[(top := self.losers[0])]) is not None:
            yield self.lcp[top], head[1], head[2], head[3]
            following = self.heads[top] = next(self.streams[top], None)
            self.lcp[top] = following[0] if following else 0
            self.climb(top)


class Node:
    """An open node: what is known of the part of its subtree that is finished."""

    __slots__ = ("key", "words", "convs", "low", "children", "leaves", "saved", "ends", "prefix", "kids", "listed")

    def __init__(self, key: bytes, words: int):
        self.key, self.words = key, words
        self.convs = self.children = self.leaves = self.saved = 0
        self.low: int | None = None
        self.ends: list[int] = []
        self.listed = False  # whether ends have been written as lists
        self.prefix: bytes | None = None  # the node's name in rows that are joined later
        self.kids: list[list] = []

    def add(self, convs: int, low: int | None, children: int, leaves: int, saved: int) -> None:
        self.convs += convs
        self.children += children
        self.leaves += leaves
        self.saved += saved
        if low is not None and (self.low is None or low < self.low):
            self.low = low


class OpenPath:
    """The stack of open nodes over a sorted stream of paths, and the rows that come of it.

    With `bordered`, nodes on the first path and those that are open at the end are written as
    partial paths of the range `place`; without, everything is finished.
    """

    def __init__(self, place: int, bordered: bool, limits: Limits):
        self.place, self.bordered, self.limits = place, bordered, limits
        self.path: list[Node] = []
        self.edge: float = math.inf if bordered else -1  # down to this depth the open path is the first path
        self.rows: list[list] = []

    def name(self, depth: int) -> bytes:
        node = self.path[depth]
        if node.prefix is None:
            node.prefix = hashlib.blake2b(b"".join(n.key for n in self.path[: depth + 1]), digest_size=16).digest()
            for kid in node.kids:
                self.rows.append(self.below(kid, node))
            node.kids = []
        return node.prefix

    def below(self, kid: list, parent: Node) -> list:
        """The row of a finished node whose parent's smallest member is looked up later, or known by now."""
        if parent.prefix is None:
            kid[3] = parent.low
        else:
            kid[10] = parent.prefix
        return kid

    def end(self, conv: int) -> None:
        """A conversation that ends at the deepest open node."""
        node = self.path[-1]
        node.add(1, conv, 0, 0, 0)
        node.ends.append(conv)
        if len(node.ends) >= self.limits.ids:
            self.list_ends(len(self.path) - 1)

    def list_ends(self, depth: int) -> None:
        node = self.path[depth]
        if node.ends:
            self.rows.append(["ends", node.ends[0], depth, *[None] * 6, self.name(depth), *[None] * 5, ",".join(map(str, node.ends))])
            node.ends, node.listed = [], True

    def open(self, key: bytes, words: int) -> Node:
        self.path.append(Node(key, words))
        return self.path[-1]

    def close(self, depth: int) -> None:
        """Closes open nodes below a depth."""
        while len(self.path) - 1 > depth:
            at = len(self.path) - 1
            if at <= self.edge:
                self.border(at, 0)
                self.path.pop()
                self.edge = at - 1
            else:
                self.finish(at)

    def border(self, depth: int, side: int) -> None:
        self.list_ends(depth)
        n, name = self.path[depth], self.name(depth)
        self.rows.append(["border", n.low, depth, None, n.convs, n.children, n.leaves, n.saved, None, name, None, self.place, side, n.key, n.words, None])

    def finish(self, depth: int) -> None:
        node = self.path[depth]
        if node.listed:
            self.list_ends(depth)
        digest = None if node.listed else hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.convs - 1) * node.words
        for kid in node.kids:
            self.rows.append(self.below(kid, node))
        row = ["node", node.low, depth, None, node.convs, node.children, leaves, saved, digest, node.prefix, *[None] * 6]
        self.path.pop()
        if not self.path:
            self.rows.append(row)
            return
        parent = self.path[-1]
        parent.add(node.convs, node.low, 1, leaves, saved)
        if parent.prefix is None:
            parent.kids.append(row)
            if len(parent.kids) >= self.limits.kids:
                self.name(depth - 1)
        else:
            self.rows.append(self.below(row, parent))

    def complete(self, depth: int) -> None:
        """A path that ends at a depth has come whole: what is open below it closes, and the first path can begin to close."""
        self.close(depth)
        if self.path and self.edge == math.inf:
            self.edge = len(self.path) - 1

    def done(self) -> None:
        if not self.path:
            return
        if not self.bordered:
            self.close(-1)
            return
        for depth in range(len(self.path) - 1, -1, -1):
            self.border(depth, 0 if depth <= self.edge else 1)
        self.path = []

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        """The rows so far, if there are enough."""
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), STEP_ARROW.types, strict=True)], STEP_NAMES)
            self.rows = []


def merged_nodes(limits: Limits):
    """A task of the merge: the runs of one range in, finished nodes, lists of ends and border paths out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list[tuple[int, int, bytes, int, list[int]]]] = {}
        for batch in batches:
            for number, place, lcp, conv, keys, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs.setdefault(number, []).append((place, lcp, keys, conv, words))
        slices = []
        for rows in runs.values():
            rows.sort(key=lambda row: row[0])
            # a row's lcp is with the row before it in the run, which a range may not hold
            slices.append([(row[1] if row[0] == before[0] + 1 else shared(before[2], row[2]), *row[2:]) for before, row in zip([(-2, 0, b"", 0, []), *rows], rows, strict=False)])
        stack = OpenPath(TaskContext.get().partitionId(), True, limits)
        for lcp, keys, conv, words in LoserTree(slices):
            if stack.path:
                stack.close(lcp)
            else:
                stack.open(b"", 0)
            for depth in range(len(stack.path) - 1, len(keys) // KEY):
                stack.open(keys[depth * KEY : depth * KEY + KEY], words[depth])
            stack.complete(len(keys) // KEY)
            stack.end(conv)
            yield from stack.batches(20_000)
        stack.done()
        yield from stack.batches()
        release_memory()

    return run


def folded(bordered: bool, limits: Limits):
    """A task of a fold: border paths in the order of (group, place, side, depth) in, the same rows as of a merge out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = OpenPath(-1, bordered, limits)
        group, path, last, matching = None, None, 0, False
        for batch in batches:
            for row in batch.to_pylist():
                depth = row["depth"]
                if (row["group"], row["place"], row["side"]) != (group, *(path or ())):
                    stack.complete(last)
                    if row["group"] != group:
                        stack.done()
                        yield from stack.batches()
                        stack, group = OpenPath(row["group"], bordered, limits), row["group"]
                    path = row["place"], row["side"]
                    matching = row["side"] == 0  # what is open at a range's end goes on from its own first path
                if matching and depth < len(stack.path) and stack.path[depth].key == row["key"]:
                    node = stack.path[depth]
                else:
                    matching = False
                    stack.close(depth - 1)
                    node = stack.open(row["key"], row["words"])
                    node.prefix, node.listed = row["prefix"], True
                node.add(row["n_convs"], row["conv_id"], row["n_children"], row["n_leaves"], row["saved_tokens"])
                last = depth
                yield from stack.batches(20_000)
        stack.complete(last)
        stack.done()
        yield from stack.batches()

    return run


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lists of ends of each node, which come in order."""
    name, digest = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for prefix, ends in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            if prefix != name:
                if digest:
                    done.append((name, digest.hexdigest()))
                name, digest = prefix, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ends.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], ["prefix", "listed"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["prefix", "listed"])


def sequences_trie(convs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The nodes of the trie of convs (conv_id, keys: 16 bytes a turn, words: its turns' word counts)."""
    spark = convs.sparkSession
    runs = materialize(convs.select("conv_id", "keys", "words").mapInArrow(sorted_runs(limits), RUN_SCHEMA), "trie-runs")
    size = runs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("keys")), F.lit(0)).alias("bytes")).first()
    spread = min(-(-size.n // limits.spread), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = max(1, -(-size.n // limits.range), -(-size.bytes // limits.range_bytes), spread)
    dealt = runs.repartitionByRange(ranges, "keys", "conv_id")
    steps = [materialize(dealt.select("run", "place", "lcp", "conv_id", "keys", "words").mapInArrow(merged_nodes(limits), STEP_SCHEMA), "trie-nodes")]
    discard(runs)

    paths = steps[0].filter("kind = 'border'")
    places = paths.agg(F.coalesce(F.max("place") + 1, F.lit(0))).first()[0]
    while places:
        last = places <= FAN
        places = 0 if last else -(-places // FAN)
        by = (F.lit(0) if last else F.floor(F.col("place") / FAN)).cast("long").alias("group")
        rows = paths.select(by, "place", "side", "depth", "key", "words", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "prefix")
        rows = rows.repartition("group").sortWithinPartitions("group", "place", "side", "depth")
        steps.append(materialize(rows.mapInArrow(folded(not last, limits), STEP_SCHEMA), "trie-paths"))
        paths = steps[-1].filter("kind = 'border'")

    made = steps[0]
    for step in steps[1:]:
        made = made.unionByName(step)
    nodes = made.filter("kind = 'node'")
    lists = made.filter("kind = 'ends'").select("prefix", "conv_id", "ends").repartition("prefix").sortWithinPartitions("prefix", "conv_id")
    named = nodes.filter("prefix is not null").join(lists.mapInArrow(digested, "prefix binary, listed string"), "prefix", "left")
    named = named.withColumn("ends_sha256", F.coalesce("ends_sha256", "listed", F.lit(NOBODY))).drop("listed")
    whole = nodes.filter("prefix is null").unionByName(named)

    below = whole.filter("parent_prefix is not null").drop("parent_conv_id")
    parents = nodes.filter("prefix is not null").select(F.col("prefix").alias("parent_prefix"), F.col("conv_id").alias("parent_conv_id"))
    if parents.count() <= BROADCAST_PARENTS:
        found = below.join(F.broadcast(parents), "parent_prefix", "left")
    else:
        salted = parents.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = below.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")).join(salted, ["parent_prefix", "salt"], "left")
    out = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return whole.filter("parent_prefix is null").select(*out).unionByName(found.select(*out))


def prefix_trie(conversations: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations (conv_id, turn, role, text).

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256 (of the members that end at the node).
    """
    return sequences_trie(rebuilt(conversations), limits)
