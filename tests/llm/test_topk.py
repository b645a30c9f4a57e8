from __future__ import annotations

import math
import random

import numpy as np
import pytest

from sparkloom.llm import topk


def brute(rows, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in ok if i % 20 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(mine, v)), i) for j, mine in ok if j == q for i, v in ok if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def found(spark, rows, k=20):
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vec_id", "embedding")
    return sorted(map(tuple, topk.top_k(spark, vectors, vectors.filter("vec_id % 20 = 0"), "vec_id", k).collect()))


@pytest.mark.parametrize(("block", "lanes", "most"), [(16, 16, 1 << 15), (16, 2, 30), (4096, 1, 5)])
def test_equals_brute_force(spark, monkeypatch, block, lanes, most):
    for name, value in (("BLOCK", block), ("LANES", lanes), ("LEAST", 3), ("QUERY_BLOCK", 4), ("MOST", most)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(12)]) for i in range(150)]
    rows += [(i, rows[i % 5][1]) for i in range(150, 200)]  # ties
    rows += [(200, None), (201, []), (202, [float("nan")] * 12), (203, [float("inf")] * 12), (204, [None] * 12), (220, [0.5])]
    assert found(spark, rows) == brute(rows, 20)


def test_large_components_are_exact(spark):
    for scale in (1e3, 1e6):
        rows = [(i, [scale + i, -3e-4 * scale * i, 0.0]) for i in range(45)]
        assert found(spark, rows, 3) == brute(rows, 3)
    most, least = 2**63 - 1, -(2**63)
    rows = [(0, [1e9]), (1, [1e9]), (2, [-1e12]), (3, [1e300]), (4, [1.0]), (5, [1e9])]
    assert found(spark, rows, 9) == [(0, 1, 1, most), (0, 2, 3, most), (0, 3, 5, most), (0, 4, 4, 64 * 64 * 10**9), (0, 5, 2, least)]


def test_few_and_no_rows(spark):
    rows = [(0, [1.0]), (1, [1.0]), (1, [1.0])]
    assert found(spark, rows) == [(0, 1, 1, 4096), (0, 2, 1, 4096)]
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(0, None)]) == []


def test_repeated_rows_are_candidates_each(spark):
    rng = random.Random(2)
    rows = [(i % 30, [rng.choice([0.1, 0.5]) for _ in range(4)]) for i in range(90)] + [(40, [0.5] * 4)] * 30
    assert found(spark, rows) == brute(rows, 20)


def test_extra_columns_do_not_clash(spark):
    rows = spark.createDataFrame([(i, [float(i)], 1, 2, 3) for i in range(4)], "vec_id bigint, embedding array<float>, ints int, id int, score int")
    vectors = topk.whole_vectors(rows, "vec_id", "embedding")
    assert [r.vec_id for r in topk.top_k(spark, vectors, vectors.filter("vec_id = 0"), "vec_id", 2).orderBy("rank").collect()] == [1, 2]


def test_the_walk_stops_early_on_proof():
    rng = np.random.default_rng(0)
    matrix = np.zeros((2000, 32), np.int64)
    matrix[np.arange(2000), rng.integers(0, 32, 2000)] = rng.integers(20, 60, 2000)
    matrix += rng.integers(-1, 2, matrix.shape)
    queries = matrix[:4]
    rows, members, scores, levels = topk.search(topk.Block(matrix, np.arange(2000)), queries, np.arange(4), 5)
    exact = queries @ matrix.T
    for q in range(4):
        exact[q, q] = -(10**9)
        assert scores[rows == q].tolist() == sorted(exact[q].tolist(), reverse=True)[:5]
    assert levels < 6
