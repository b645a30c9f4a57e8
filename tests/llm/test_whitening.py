"""Exact scatter and whitening against sums in fractions and eigh of the whole matrix."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from sparkloom.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, component string"


def brute(rows):
    """(n, sums, covariance in fractions) of the distinct x of whole vectors."""
    whole = [v for _, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(map(len, whole), default=0)
    x = [tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))]) for v in whole]
    distinct = set(x)
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    cov = [[sum((Fraction(v[i]) - Fraction(sums[i], n)) * (v[j] - Fraction(sums[j], n)) for v in distinct) / n for j in range(width)] for i in range(width)]
    return n, sums, cov, x


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA).repartition(3)


def close(got, rows):
    n, sums, cov, x = brute(rows)
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(sum(cov[i][i] for i in range(len(sums))))
    k = min(16, int((values > 1e-12 * values[0]).sum()))
    kept = [i for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    assert len(got) == len(kept) * k
    by = {(r.vec_id, r.component): r for r in got}
    for key, vector in zip(kept, x, strict=True):
        off = [n * a - s for a, s in zip(vector, sums, strict=True)]
        for c in range(k):
            row = by[key, c + 1]
            assert row.n == n and row.deviation == sum(a * a for a in off)
            want = np.array([a / n for a in off]) @ vectors[:, c] / math.sqrt(values[c])
            assert abs(abs(row.whitened) - abs(want)) < 1e-6
            assert row.explained == pytest.approx(values[c] / trace, rel=1e-9)
            assert row.identity_error < 1e-9


def test_rows_equal_brute_force_with_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=5) * [1, 2, 3, 4, 5]]) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (103, [1.0, None, 0.0, 0.0, 0.0]), (104, [math.nan] * 5), (105, [math.inf, 0.0, 0.0, 0.0, 0.0]), (106, [1.5]), (107, [])]
    got = whitening.whiten(spark, frame(spark, rows), "vec_id", "embedding").collect()
    close(got, rows)
    assert not {102, 103, 104, 105} & {r.vec_id for r in got}


def test_the_query_equals_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.filter("vec_id < 80").collect()]
    close(whitening.whiten(spark, table.filter("vec_id < 80"), "vec_id", "embedding").collect(), rows)
    whole = whitening.op12_exact_whitening(spark, sf_dir)
    assert whole.count() == 16 * table.filter("embedding is not null").count()
    assert whole.agg({"identity_error": "max"}).first()[0] < 1e-9


def test_sums_are_exact_at_any_size():
    rng = np.random.default_rng(5)
    matrix = rng.integers(-(2**62), 2**62, (50, 3))
    total = whitening.Scatter()
    total.add(matrix[:20])
    total.add(matrix[20:])
    whole = matrix.astype(object)
    assert (total.sums == whole.sum(0)).all() and (total.products == whole.T @ whole).all() and total.n == 50
    back: dict = {}
    for i, j, at, digit in total.digits():
        back[i, j] = back.get((i, j), 0) + (digit << 32 * at)
    assert back[0, 1] == (whole.T @ whole)[0, 1] and back[-1, 2] == whole[:, 2].sum()


def test_large_components_have_digits_where_a_long_is_too_small(spark):
    rows = [(0, [1e12, 0.0]), (1, [-3e12, 1.0]), (2, [2e12, 5.0]), (3, [3e38, 0.0])]
    got = whitening.whiten(spark, frame(spark, rows[:3]), "vec_id", "embedding").collect()
    n, sums, _, x = brute(rows[:3])
    want = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in enumerate(x)}
    assert all(r.deviation is None and int(r.deviation_digits) == want[r.vec_id] for r in got)
    assert {r.n for r in whitening.whiten(spark, frame(spark, rows), "vec_id", "embedding").collect()} == {4}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [2.0, 3.0])], [(1, []), (2, [])], [(1, [0.5]), (2, [0.5])]])
def test_no_variance_gives_no_rows(spark, rows):
    assert whitening.whiten(spark, frame(spark, rows), "vec_id", "embedding").collect() == []


def test_encoding_is_the_same_for_equal_vectors_only():
    matrix = np.array([[1, 0, 0], [1, 0, 0], [0, 0, 0], [200, -1, 0], [2**40, 0, 5]])
    rows = whitening.encode(matrix)
    assert rows[0] == rows[1] and len(set(rows)) == 4 and (whitening.decode(rows) == matrix).all()
    assert whitening.encode(np.array([[1]]))[0] == rows[0]
