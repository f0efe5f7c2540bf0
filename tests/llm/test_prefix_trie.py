from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from textmill.llm import prefix_trie as T
from textmill.llm.queries import QUERIES

SCHEMA = "conv_id long, turn int, role string, text string"


def ordered(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}


def brute(convs: dict[int, list[tuple[str, str]]]):
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        todo, out = [node], []
        while todo:
            x = todo.pop()
            out.append(x)
            todo += children[x]
        return out

    rows = []
    for node, ids in members.items():
        tree = below(node)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in tree if x)
        parent = members[node[:-1]][0] if node else None
        digest = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        rows.append((ids[0], len(node), parent, len(ids), len(children[node]), sum(not children[x] for x in tree), saved, digest))
    return sorted(rows, key=repr)


def rows_of(frame):
    assert frame.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    texts = ["", "a", "bb", "é", "ccc\n", "a"]
    out = []
    for c in range(-3, 300):
        if c % 100 == 0 and c != 100:
            continue  # most bases are absent
        turns = [(rng.choice(["user", "assistant"]), rng.choice(texts)) for _ in range(rng.randint(0 if c % 7 else 1, 5))]
        if c % 3 == 0:
            turns = [("user", "a third of all"), ("assistant", "begins like this"), *turns[: c % 4]]  # hot heads, many equal
        out += [(c, i, *t) for i, t in enumerate(turns)]
    out += [(400, i, "user", f"turn {i % 3}") for i in range(150)] + [(401, i, "user", f"turn {i % 3}") for i in range(120)]
    out += [(500, None, "user", "null turn first"), (500, 0, None, None), (500, 0, "a", "tie b"), (500, 0, "a", "tie a"), (500, 0, "a", "tie a")]
    out += [(None, 0, "user", "no number"), (600, 1, "user", "x" * 3000)]
    return out


@pytest.mark.parametrize("range_bytes", [1 << 20, 2000, 300])
def test_equals_brute_force_in_one_and_in_many_ranges(spark, rows, range_bytes):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert rows_of(T.conversation_trie(frame, range_bytes)) == brute(ordered(rows))


def test_query_rebuilds_conversations(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    convs = ordered(rows)
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = convs.get(base, [])[:h] + own[h:]
    assert any(not t for t in rebuilt.values())  # turnless ones are members of the root
    assert rows_of(QUERIES["op11_prefix_trie"](spark, str(tmp_path))) == brute(rebuilt)


def test_loser_tree_orders_and_shares():
    rng = random.Random(1)
    token = lambda: bytes([rng.randrange(3)]) * T.WIDTH
    seqs = [b"".join(token() for _ in range(rng.randint(0, 6))) for _ in range(400)]
    for k in (1, 2, 3, 7, 16):
        runs = [sorted(seqs[i::k]) for i in range(k)]
        coded = [iter([(T.shared_turns(r[i - 1] if i else b"", s), s, i) for i, s in enumerate(r)]) for r in runs]
        tree = T.LoserTree(coded)
        merged = list(tree)
        assert [s for _, s, _ in merged] == sorted(seqs)
        assert [n for n, _, _ in merged] == [T.shared_turns(a, b) for a, b in zip([b"", *sorted(seqs)], sorted(seqs), strict=False)]
    assert list(T.LoserTree([])) == [] and list(T.LoserTree([iter([])])) == []


def test_shared_turns_are_not_compared_again():
    """Two runs of strings with one long common head: after the first meeting it is skipped."""
    head = b"h" * T.WIDTH * 500
    seqs = [head + i.to_bytes(T.WIDTH, "big") for i in range(100)]
    coded = [iter([(T.shared_turns(r[i - 1] if i else b"", s), s, None) for i, s in enumerate(r)]) for r in (seqs[::2], seqs[1::2])]
    tree = T.LoserTree(coded)
    assert [s for _, s, _ in tree] == seqs
    assert tree.compared < 500 + 2 * 100 + 5


def test_many_equal_conversations_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 7)
    rows = [(c, 0, "user", "same") for c in range(1000, 1500)] + [(c, 0, "user", f"other {c}") for c in range(40)]
    out = rows_of(T.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(6), 1000))
    assert out == brute(ordered(rows))


def test_empty_table_and_extra_columns(spark, rows, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert rows_of(T.conversation_trie(none)) == []
    none.write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(QUERIES["op11_prefix_trie"](spark, str(tmp_path))) == []
    few = rows[:40]
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in few], SCHEMA + ", base int, seq string, `s.k` string")
    assert rows_of(T.conversation_trie(frame)) == brute(ordered(few))
