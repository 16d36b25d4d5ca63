"""The trie of conversations against one of dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from loomgraph.llm.conversation_trie import Trie, prefix_trie

_SCHEMA = "conv_id long, turn long, role string, text string, depth int, fp string"


def brute(rows, how):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    turns = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in turns.items()}
    members = defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % how.heads
        path = turns.get(c - c % how.family, [])[:h] + turns[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append((c, d == len(path)))
    own = {p: (len(m) - 1) * (len(p[-1][1]) if p else 0) for p, m in members.items()}
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += own[p]
    least = {p: min(c for c, _ in m) for p, m in members.items()}
    ends = {p: hashlib.sha256(",".join(str(c) for c, end in sorted(m) if end).encode()).hexdigest() for p, m in members.items()}
    return sorted((least[p], len(p), least[p[:-1]] if p else None, len(m), children[p], leaves[p], saved[p], ends[p]) for p, m in members.items())


def conversations(seed=1):
    rng = random.Random(seed)
    rows = []
    for c in range(260):
        if c % 35 in (5, 11):  # a family without its first conversation, and gaps
            continue
        for turn in range(rng.choice([1, 1, 2, 3, 8, 9, 12])):
            rows.append((c, turn, rng.choice(["user", "bot"]) if turn else "user", rng.choice(["hi", "hé", "", "well, then"])))
    rows += [(400 + k, t, "user", f"turn {t}") for k in range(60) for t in range(10)]  # one conversation many times
    rows += [(1000, t, "user", "x" * (t % 7)) for t in range(130)]  # longer than a partition holds of it
    rows += [(1003, t, "user", "x" * (t % 7)) for t in range(129)]
    rows += [(2000, None, "a", "null first"), (2000, 0, None, None), (2000, 1, None, ""), (2000, 1, "", None), (2000, 1, "b", "tie"), (2000, 1, "a", "tie"), (2001, None, None, "null first"), (None, 0, "a", "nobody")]
    return [(*r, 7, "x") for r in rows]


def collected(table, how=Trie()):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie(table, how).collect())


@pytest.mark.parametrize("how", [Trie(), Trie(family=3, heads=4)])
def test_equals_brute_force(spark, how):
    rows = conversations()
    random.Random(4).shuffle(rows)
    assert collected(spark.createDataFrame(rows, _SCHEMA).repartition(6), how) == brute(rows, how)


def test_nodes_of_colliding_fingerprints_are_split(spark):
    rows = [r for r in conversations(8) if r[0] is not None and (r[0] < 60 or 400 <= r[0] < 410)]
    for bits in (1, 4):
        assert collected(spark.createDataFrame(rows, _SCHEMA), Trie(bits=bits)) == brute(rows, Trie())


def test_empty_and_turnless(spark):
    assert collected(spark.createDataFrame([], _SCHEMA)) == []
    lonely = next(c for c in range(6, 10_000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(lonely, 0, "user", "only turn", 1, "")]
    assert collected(spark.createDataFrame(rows, _SCHEMA)) == brute(rows, Trie()) == [(lonely, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lonely).encode()).hexdigest())]
