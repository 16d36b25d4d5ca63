"""Long repeats against all strings of all texts, one by one."""

import random
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm.rolling import Sums, power
from loomgraph.llm.scratch import Scratch
from loomgraph.llm.suffix_index import LongRepeats, SuffixFamily, find_runs, remove_long_repeats
from tests.llm.test_documents import awkward

_SCHEMA = "doc_id long, text string, removed int, k string"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        out.append((len(d), spans, bytes(x for x, g in zip(d, gone.tolist(), strict=False) if not g)))
    return out


def texts(seed=3):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdeé 日") for _ in range(n))
    shared = [noise(n) for n in (19, 20, 21, 30, 55, 120)]
    out = [noise(rng.randrange(60)) + rng.choice(shared) + noise(rng.randrange(40)) + rng.choice(shared)[rng.randrange(9) :] for _ in range(150)]
    out += [noise(4) + shared[5][20:80] + noise(4) for _ in range(40)]  # one anchor, many contexts
    long = noise(400)
    out += [long[:k] + "#" + long[k:] for k in range(0, 400, 23)] + [long, long]
    return out + ["ab" * 400, "-" * 300, "-" * 19, "-" * 20, "ba" * 11, None, "", " ", "x", "é" * 60]


@pytest.mark.parametrize("how", [LongRepeats(20, 10, 4, 1024), LongRepeats(20, 7, 3, 2), LongRepeats(21, 20, 1, 5)])
def test_equals_brute_force(spark, how):
    rows = [(k if k % 9 else None if k % 2 else 5, t, 0, "x") for k, t in enumerate(texts())]
    got = remove_long_repeats(spark.createDataFrame(rows, _SCHEMA).repartition(5), how).collect()
    want = [(r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], how.length), strict=True)]
    assert sorted(map(repr, ((r.doc_id, r.n_bytes, [tuple(s) for s in r.removed], bytes(r.kept)) for r in got))) == sorted(map(repr, want))


def test_awkward_rows_at_full_length(spark):
    rows = [(r[0], r[1], 0, "x") for r in awkward() if r[0] not in (601, 602)]
    got = remove_long_repeats(spark.createDataFrame(rows, _SCHEMA)).collect()
    want = [(r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], 400), strict=True)]
    assert sorted(map(repr, ((r.doc_id, r.n_bytes, [tuple(s) for s in r.removed], bytes(r.kept)) for r in got))) == sorted(map(repr, want))


def test_a_text_of_several_pieces(spark):
    rng = random.Random(5)
    noise = "".join(rng.choices("abcdefghij", k=1_200_000))
    inside = noise[1_048_500 : 1_048_700]  # over the border of two pieces
    rows = [(1, noise, 0, ""), (2, "xyz" + inside, 0, ""), (3, noise[-100:] + "tail", 0, "")]
    got = {r.doc_id: [tuple(s) for s in r.removed] for r in remove_long_repeats(spark.createDataFrame(rows, _SCHEMA), LongRepeats(50, 25)).collect()}
    assert got == {1: [(1_048_500, 1_048_700), (1_199_900, 1_200_000)], 2: [(3, 203)], 3: [(0, 100)]}


def test_empty_table(spark):
    assert remove_long_repeats(spark.createDataFrame([], _SCHEMA)).collect() == []


def test_levels_merge_geometrically(spark):
    family, how = SuffixFamily(Scratch(spark, "test")), LongRepeats(20, 10)
    sizes = []
    for k in range(5):
        data = np.frombuffer(f"the same forty bytes in every batch, and {k * 7919}".encode(), np.uint8)
        found = find_runs(data, np.array([0, len(data)]), how)
        rows = [(k, k, *map(int, (np.int64(a.view(np.int64)), np.int64(b.view(np.int64)), lo, q, hi))) for a, b, lo, q, hi in zip(*found.values(), strict=True)]
        family.add(spark.createDataFrame(rows, "_id long, _hash long, k long, c long, lo int, q int, hi int"))
        sizes.append([n for n, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1]]
    assert {r.n for r in family.repeated().collect() if r.n > 1} == {5}


def test_fingerprints_move_with_their_text():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    both = Sums(np.concatenate([a[:7], a, a[3:9], a]))
    assert both.of(np.array([7]), np.array([57])) == both.of(np.array([63]), np.array([113])) == Sums(a).of(np.array([0]), np.array([50]))
    x = power(np.array([0, 1, -1, 13, -13, 1 << 40]))
    with np.errstate(over="ignore"):
        assert x[1] * x[2] == 1 and x[3] * x[4] == 1 and x[0] == 1
