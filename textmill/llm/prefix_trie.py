"""The trie of conversation prefixes, by an LCP-aware external mergesort.

A turn is a token of 36 bytes: the SHA-256 of its role and text, and the text's
length in code points. A conversation is the string of its tokens, so texts are
read once, where they lie, and only tokens are shuffled. Equal strings are brought
together first, with their conversations counted in the tasks that hold them.

The distinct strings are then sorted and folded into nodes:

1. Each task sorts what it holds into runs. A run's rows carry the length of the
   prefix (in turns) shared with the row before, and only the tokens after it.
2. Rows go to ranges of the order. The bounds of the ranges are strings of the
   table, drawn from a sample of known size; the results do not depend on them.
3. A task merges the runs of a range with a loser tree whose contestants keep the
   prefix shared with the last winner: the one that shares more wins unread, and
   only equal ones are compared, from there on. Shared turns are never compared
   again.
4. The merged stream, with its prefix lengths, drives a stack of the open path. A
   shorter prefix closes nodes, which are emitted with the sums of their subtrees.

A node can lie in several ranges only if it is a prefix of a range's bound. Such
nodes come out in parts that only add up (members, the least id, children, leaves
and saved tokens, where a node that goes on in the next range is left to it), and
are added by their hash. There are at most two paths of them for a range. Children
of such nodes get their parent's id by a join, others in the task.

The hash over a node's own members needs one pass in the order of ids. Ids are
joined into pieces in parallel, ranges of one string's ids by several tasks, and
only the pieces of a string meet, as a stream in the order of their first ids.

Bounds: a conversation's tokens are one row (36 bytes a turn); a range holds about
``RANGE_BYTES`` of tokens, more only beyond ``MOST_RANGES``; the driver holds a
sample of ``SAMPLE`` strings for each range.

Defined cases: null role and text are empty; a null turn stands first; turns with
equal numbers are ordered by role, then by the first 64 characters of the text,
then by the token, and repeated rows are turns of their own; rows with a null
conversation have no number and are left out; an empty table has no node, not even
a root; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.session import shared_folder

DIGEST = 32
WIDTH = DIGEST + 4
RANGE_BYTES = 1 << 20
MOST_RANGES = 1 << 16
SAMPLE = 8
RUN_BYTES = 4 << 20
#: Ids joined in one piece.
PIECE = 2048


def turn_tokens(rows: DataFrame) -> DataFrame:
    """(conv_id, seq): the tokens of each conversation's turns in their order."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    token = F.concat(digest, F.unhex(F.lpad(F.hex(F.length(text)), 8, "0")))
    turns = rows.select("conv_id", F.struct(F.col("turn").alias("t"), role.alias("r"), F.substring(text, 1, 64).alias("x"), token.alias("k")).alias("s"))
    ordered = F.transform(F.sort_array(F.collect_list("s")), lambda s: F.hex(s["k"]))
    return turns.groupBy("conv_id").agg(F.unhex(F.concat_ws("", ordered)).alias("seq"))


def _node_columns() -> list[tuple[str, str]]:
    return [("key", "binary"), ("parent_key", "binary"), ("depth", "long"), ("conv_id", "long"), ("parent_conv_id", "long"), ("n_convs", "long"), ("n_children", "long"), ("n_leaves", "long"), ("saved_tokens", "long"), ("ends_sha256", "string"), ("whole", "boolean")]


_NODES = ", ".join(f"{n} {k}" for n, k in _node_columns())
_ARROW = pa.schema([(n, {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[k]) for n, k in _node_columns()])
_RUNS = "range int, run long, place int, shared int, rest binary, n long, first long, ends string"


def shared_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two strings share at their beginning, given that they share ``known``."""
    most = min(len(a), len(b)) // WIDTH
    while known < most and a[known * WIDTH : (known + 1) * WIDTH] == b[known * WIDTH : (known + 1) * WIDTH]:
        known += 1
    return known


class LoserTree:
    """Merges sorted runs of (shared, seq, payload), yielding them in order with the turns shared with the last one.

    A node of the tree holds the run that lost there, and ``lcp`` of a waiting run is what its head shares with the
    winner that went past it. Of two heads that share different lengths with the last winner the longer comes first.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]):
        self.runs = runs
        self.head: list[tuple[bytes, object] | None] = []
        self.lcp: list[int] = []
        for run in runs:
            item = next(run, None)
            self.head.append(None if item is None else item[1:])
            self.lcp.append(0)
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.loser = [-1] * self.size
        self.compared = 0
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size if node - self.size < len(self.runs) else -1
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, self.loser[node] = self._play(a, b)
        return win

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's lcp becomes what it shares with the winner."""
        if b < 0 or self.head[b] is None:
            return a, b
        if a < 0 or self.head[a] is None:
            return b, a
        if self.lcp[a] != self.lcp[b]:
            return (a, b) if self.lcp[a] > self.lcp[b] else (b, a)
        x, y = self.head[a][0], self.head[b][0]
        k = shared_turns(x, y, self.lcp[a])
        self.compared += k - self.lcp[a] + 1
        at = slice(k * WIDTH, (k + 1) * WIDTH)
        win, lose = (b, a) if y[at] < x[at] or (y[at] == x[at] and b < a) else (a, b)
        self.lcp[lose] = k
        return win, lose

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        while self.winner >= 0 and self.head[self.winner] is not None:
            w = self.winner
            seq, payload = self.head[w]
            yield self.lcp[w], seq, payload
            item = next(self.runs[w], None)
            if item is None:
                self.head[w] = None
            else:
                self.lcp[w], self.head[w] = item[0], item[1:]
            node = (w + self.size) // 2
            while node:
                w, self.loser[node] = self._play(w, self.loser[node])
                node //= 2
            self.winner = w


class _Open:
    """A node of the open path; sums cover what was closed below it."""

    __slots__ = ("children", "convs", "digest", "ends", "first", "gross", "hash", "leaves", "length", "rows")

    def __init__(self, digest, length: int):
        self.hash, self.length = digest, length
        self.first: int | None = None
        self.convs = self.children = self.leaves = self.gross = 0
        self.ends: str | None = None
        self.rows: list[int] = []


def fold(stream: Iterator[tuple[int, bytes, tuple[int, int, str]]], begins: bytes | None, follows: bytes | None) -> dict[str, list]:
    """Columns of the nodes of one range of the order, from its distinct strings with the turns each shares with the one before.

    ``begins`` and ``follows`` are the strings that bound the range. Nodes on the path of either are parts
    (``whole`` is false) that add up over the ranges; a node that goes on in the next range counts there as a child
    and a leaf, and its tokens of one member are taken off there.
    """
    out: dict[str, list] = {n: [] for n, _ in _node_columns()}
    empty = hashlib.sha256(b"").hexdigest()
    path = [_Open(hashlib.sha256(), 0)]
    in_begin = in_follow = 0  # depth to which the open path is a prefix of a bound

    def close() -> None:
        depth = len(path) - 1
        node = path.pop()
        goes_on = follows is not None and depth <= in_follow
        whole = depth > 0 and not goes_on and not (begins is not None and depth <= in_begin)
        if not node.children and not goes_on and node.leaves == 0:
            node.leaves = 1
        saved = node.gross + node.convs * node.length - (0 if goes_on else node.length)
        row = len(out["depth"])
        values = (node.hash.digest(), path[-1].hash.digest() if path else None, depth, node.first, None, node.convs, node.children, node.leaves, saved, node.ends or empty, whole)
        for name, v in zip(out, values, strict=True):
            out[name].append(v)
        if whole:
            for r in node.rows:
                out["parent_conv_id"][r] = node.first
        if path:
            top = path[-1]
            top.first = node.first if top.first is None else min(top.first, node.first)
            top.convs += node.convs
            top.children += not goes_on
            top.leaves += node.leaves
            top.gross += saved
            top.rows.append(row)

    started = False
    for shared, seq, (n, first, ends) in stream:
        started = True
        while len(path) - 1 > shared:
            close()
        if begins is not None:
            in_begin = shared_turns(seq, begins, min(in_begin, shared))
        if follows is not None:
            in_follow = shared_turns(seq, follows, min(in_follow, shared))
        for d in range(shared, len(seq) // WIDTH):
            digest = path[-1].hash.copy()
            digest.update(seq[d * WIDTH : (d + 1) * WIDTH])
            path.append(_Open(digest, int.from_bytes(seq[d * WIDTH + DIGEST : (d + 1) * WIDTH], "big")))
        top = path[-1]
        top.convs += n
        top.first = first if top.first is None else min(top.first, first)
        top.ends = ends
    while started and path:
        close()
    return out


def _distinct(rebuilt: DataFrame) -> DataFrame:
    """(key, seq, n, first, ends): distinct strings with their conversations' count, least id and hash of ids.

    Ids of one string are joined in pieces by the tasks of a range order over (string, id), so a frequent string's ids
    are spread; the pieces then meet as a stream.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seq, ids = None, None, []

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2][0] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([",".join(map(str, r[2])) for r in rows])], ["key", "seq", "first", "n", "ids"])

        for b in batches:
            rows = []
            for k, s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != key or len(ids) >= PIECE:
                    if ids:
                        rows.append((key, seq, ids))
                    key, seq, ids = k, s, []
                ids.append(c)
            if rows:
                yield batch(rows)
        if ids:
            yield batch([(key, seq, ids)])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []  # key, seq, first, n, hash

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[4].hexdigest() for r in rows])], ["seq", "n", "first", "ends"])

        for b in batches:
            done = []
            for k, s, f, n, ids in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                if now and now[0] == k:
                    now[3] += n
                    now[4].update(b"," + ids.encode())
                else:
                    if now:
                        done.append(now)
                    now = [k, s, f, n, hashlib.sha256(ids.encode())]
            if done:
                yield batch(done)
        if now:
            yield batch([now])

    ordered = rebuilt.select(F.unhex(F.sha2("seq", 256)).alias("key"), "seq", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    joined = ordered.mapInArrow(pieces, "key binary, seq binary, first long, n long, ids string")
    return joined.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "seq binary, n long, first long, ends string")


def sorted_runs(bounds: list[bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorts what a task holds into runs of about ``RUN_BYTES``, coded by the turns shared with the row before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            held.sort(key=lambda r: r[0])
            rows, last, last_range, place = [], b"", -1, 0
            for seq, n, first, ends in held:
                own = bisect_right(bounds, seq)
                if own != last_range:
                    last, last_range, place = b"", own, 0
                k = shared_turns(last, seq)
                rows.append((own, number, place, k, seq[k * WIDTH :], n, first, ends))
                last, place = seq, place + 1
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["range", "run", "place", "shared", "rest", "n", "first", "ends"])

        for b in batches:
            for row in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                held.append(row)
                size += len(row[0]) + 100
                if size >= RUN_BYTES:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    return run


def merged_nodes(bounds: list[bytes]) -> Callable[[pa.Table], pa.Table]:
    """Merges the runs of one range and folds them into nodes."""

    def read(rows: list[tuple]) -> Iterator[tuple[int, bytes, tuple[int, int, str]]]:
        seq = b""
        for k, rest, *payload in rows:
            seq = seq[: k * WIDTH] + rest
            yield k, seq, tuple(payload)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("run", "ascending"), ("place", "ascending")])
        at = table.column("range")[0].as_py()
        numbers = table.column("run").to_pylist()
        rows = list(zip(*[table.column(c).to_pylist() for c in ("shared", "rest", "n", "first", "ends")], strict=True))
        cuts = [0, *[i for i in range(1, len(rows)) if numbers[i] != numbers[i - 1]], len(rows)]
        merged = LoserTree([read(rows[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        return pa.table(fold(iter(merged), bounds[at - 1] if at else None, bounds[at] if at < len(bounds) else None), schema=_ARROW)

    return run


def range_bounds(rebuilt: DataFrame, range_bytes: int = RANGE_BYTES) -> list[bytes]:
    """Strings of the table that cut its order into ranges, from ``SAMPLE`` of them for each range."""
    total = rebuilt.agg(F.coalesce(F.sum(F.length("seq") + 100), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    ranges = min(MOST_RANGES, -(-int(total["b"]) // range_bytes))
    if ranges < 2:
        return []
    share = max(1, int(total["n"]) // (ranges * SAMPLE))
    found = rebuilt.where(F.pmod(F.xxhash64("conv_id"), F.lit(share)) == 0).where(F.length("seq") > 0).select("seq").distinct().collect()
    keys = sorted(bytes(r["seq"]) for r in found)
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def trie_nodes(rebuilt: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The nodes of the trie of (conv_id, seq) rows with one row for each conv_id, of ``turn_tokens``.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. The rows are written
    once to the shared folder, and so are the folded ranges, since two steps read them.
    """
    spark = rebuilt.sparkSession
    folder = f"{shared_folder(spark)}/trie_{uuid.uuid4().hex}"
    rebuilt.select(F.col("conv_id").cast("long").alias("conv_id"), "seq").write.parquet(f"{folder}/rebuilt")
    rebuilt = spark.read.parquet(f"{folder}/rebuilt")
    bounds = range_bounds(rebuilt, range_bytes)
    runs = _distinct(rebuilt).mapInArrow(sorted_runs(bounds), _RUNS)
    runs.groupBy("range").applyInArrow(merged_nodes(bounds), _NODES).write.parquet(f"{folder}/nodes")
    nodes = spark.read.parquet(f"{folder}/nodes")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    # a string stands in one range only, so at most one part of a node has ends
    ends = F.coalesce(F.max(F.when(F.col("ends_sha256") != none, F.col("ends_sha256"))), none).alias("ends_sha256")
    parts = nodes.where("NOT whole").groupBy("key", "parent_key", "depth").agg(F.min("conv_id").alias("conv_id"), *sums, ends)
    names = ["key", "parent_key", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent_conv_id"]
    every = nodes.where("whole").select(*names).unionByName(parts.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*names))
    # nodes that know their parent look for a key that no shared node has: their own
    looks = F.when(F.col("parent_conv_id").isNull() & F.col("parent_key").isNotNull(), F.col("parent_key")).otherwise(F.concat(F.lit(b"-"), F.col("key")))
    above = parts.select(F.col("key").alias("up"), F.col("conv_id").alias("up_conv"))
    out = every.withColumn("looks", looks).join(above, F.col("looks") == F.col("up"), "left")
    return out.select("conv_id", "depth", F.coalesce("parent_conv_id", "up_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(rows: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The trie of the conversations of (conv_id, turn, role, text) rows."""
    return trie_nodes(turn_tokens(rows.where(F.col("conv_id").isNotNull())), range_bytes)


def with_shared_heads(rows: DataFrame, head: Callable[[Column], Column], base: Callable[[Column], Column], most: int) -> DataFrame:
    """(conv_id, seq): each conversation with its first turns replaced by as many of another's.

    ``base`` names the other conversation and ``head`` how many of its turns (``most`` at most) come first; they take
    the place of the conversation's own first turns. Both sides are dealt by the base, so one shuffle serves the
    gathering of turns and the join. Only the heads of conversations that can be a base are sent.
    """
    rows = rows.where(F.col("conv_id").isNotNull()).withColumn("conv_id", F.col("conv_id").cast("long"))
    own = turn_tokens(rows.repartition(base(F.col("conv_id")))).withColumn("base", base(F.col("conv_id")))
    heads = turn_tokens(rows.where(base(F.col("conv_id")) == F.col("conv_id"))).select(F.col("conv_id").alias("base"), F.substring("seq", 1, most * WIDTH).alias("head"))
    n = head(F.col("conv_id")).cast("int") * WIDTH
    front = F.coalesce(F.substring(F.col("head"), F.lit(1), n), F.lit(b""))
    return own.join(heads, "base", "left").select("conv_id", F.concat(front, F.substring(F.col("seq"), n + 1, F.length("seq"))).alias("seq"))


#: DuckDB SQL of the query. DuckDB has no crc32, so its bits are folded by lambdas; nodes meet their ancestors by the lists of turn hashes.
SQL = """
WITH turns AS (
  SELECT conv_id, list(row(coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), headed AS (
  SELECT conv_id, t, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 6 AS h
  FROM turns
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.t[1:a.h], []), a.t[a.h + 1:]) AS t
  FROM headed a LEFT JOIN turns b ON b.conv_id = a.base
), hashed AS (
  SELECT conv_id, list_transform(t, lambda x: sha256(strlen(x[1])::VARCHAR || ':' || x[1] || x[2])) AS k, list_transform(t, lambda x: length(x[2])) AS n FROM rebuilt
), prefixes AS (
  SELECT conv_id, unnest(range(len(k) + 1)) AS d, k, n FROM hashed
), nodes AS (
  SELECT array_to_string(k[1:d], '') AS node, d AS depth, CASE WHEN d > 0 THEN array_to_string(k[1:d - 1], '') END AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(any_value(n[d]), 0) AS chars, any_value(k[1:d]) AS k, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(k) = d), '') AS ends
  FROM prefixes GROUP BY ALL
), children AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent
), above AS (
  SELECT array_to_string(k[1:a], '') AS node, chars * (n_convs - 1) AS saved, leaf
  FROM (SELECT nodes.*, unnest(range(depth + 1)) AS a, (c.node IS NULL)::INT AS leaf FROM nodes LEFT JOIN children c USING (node))
), sums AS (SELECT node, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM above GROUP BY node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.parent LEFT JOIN children c ON c.node = n.node JOIN sums s ON s.node = n.node
"""
