import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm.vector_search import AnisotropicQuantizer, search

SCHEMA = "vec_id long, vec array<double>, score double, rank int"


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        at = ids.index(q)
        scores = [(-float(np.dot(x[i], x[at])), ids[i]) for i in range(len(ids)) if i != at]
        out[q] = [v for _, v in sorted(scores)[:k]]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32)) * rng.uniform(0.5, 2, (3000, 1))
    rows = spark.createDataFrame([(i, v.tolist(), 0.0, 0) for i, v in enumerate(x)], SCHEMA).repartition(4)
    found = search(rows, F.col("vec_id") % 20 == 0).collect()
    expected = brute(list(range(3000)), x, range(0, 3000, 20), 20)
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == pytest.approx(float(x[r.vec_id] @ x[r.query_id]), abs=1e-12)
    assert set(got) == set(expected) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(expected[q])) / 20 for q in got]) >= 0.95


def test_awkward_vectors(spark):
    good = {i: [float(i % 3), 1.0, 0.5] for i in range(30)}
    bad = [(100, None), (120, [0.0, 0.0, 0.0]), (140, [float("nan"), 1.0, 0.0]), (160, [float("inf"), 1.0, 0.0]), (180, [1.0, None, 0.0]), (200, []), (220, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    rows = [(i, v, 0.0, 0) for i, v in [*good.items(), *bad, (20, good[20])]]
    found = search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect()
    taking = [*good.items(), (20, good[20])]  # every row but the query's own is a candidate, another of its vec_id too
    expected = []
    for at in (i for i, (v, _) in enumerate(taking) if v in (0, 20)):
        scores = sorted((-float(np.dot(x, taking[at][1])), v) for i, (v, x) in enumerate(taking) if i != at)
        expected += [(taking[at][0], rank, v) for rank, (_, v) in enumerate(scores[:20], 1)]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found) == sorted(expected)  # ties go to the smaller vec_id
    assert search(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    few = spark.createDataFrame([(i, [1.0, float(i)], 0.0, 0) for i in range(3)], SCHEMA)
    assert search(few, F.col("vec_id") == 0).count() == 2


def test_quantiser_weighs_parallel_error():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 16))
    plain, aware = AnisotropicQuantizer.fit(x, 0.0), AnisotropicQuantizer.fit(x, 0.4)

    def parallel(net):
        code = net.encode(x)
        y = np.concatenate([net.books[m][code[:, m]] for m in range(len(net.books))], 1)
        return np.mean((((x - y) * x).sum(1) / np.linalg.norm(x, axis=1)) ** 2)

    assert parallel(aware) < parallel(plain)
