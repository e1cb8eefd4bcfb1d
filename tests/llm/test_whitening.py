"""Whitening against a dense solution, exact sums against whole numbers of any size."""

import math
from fractions import Fraction

import numpy as np
import pytest
from opsframe.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, n int, x int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in vectors], SCHEMA).repartition(3)


def integers(v):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(2)
    mixed = r.normal(size=(400, 12)) @ (r.normal(size=(12, 12)) * np.logspace(0, 2, 12)[:, None])
    rows = [(i if i % 50 else None, v) for i, v in enumerate(mixed.astype(np.float32).tolist())]
    odd = [(901, None), (902, []), (903, [None] + [1.0] * 11), (904, [math.nan] * 12), (905, [math.inf] + [0.0] * 11), (906, [1.0] * 5)]
    return rows + odd + rows[3:5]


def test_rows_equal_a_dense_solution(shipped, vectors):
    good = [(i, integers(v)) for i, v in vectors if v and len(v) == 12 and all(c is not None and math.isfinite(c) for c in v)]
    n, sums = len(good), [sum(x[j] for _, x in good) for j in range(12)]
    x = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums)] for _, v in good])
    values, axes = np.linalg.eigh(x.T @ x / n)
    values, axes = values[::-1], axes[:, ::-1]
    found = W.whitened(table(shipped, vectors), 8).collect()
    assert len(found) == 8 * n and {r.n for r in found} == {n} and max(r.identity_error for r in found) < 1e-9
    exact = sorted((-1 if i is None else i, sum((n * a - s) ** 2 for a, s in zip(v, sums))) for i, v in good)
    assert sorted((-1 if r.vec_id is None else r.vec_id, int(r.deviation)) for r in found if r.component == 1) == exact
    for k in range(8):
        mine = [r for r in found if r.component == k + 1]
        assert mine[0].explained == pytest.approx(values[k] / values.sum(), rel=1e-8)
        want = x @ axes[:, k] / math.sqrt(values[k])
        one = next(r for r in mine if r.vec_id == 1).whitened
        sign = np.sign(one * want[1])
        assert sorted(r.whitened for r in mine) == pytest.approx(sorted((sign * want).tolist()), abs=1e-6)


def test_small_eigenvalues_keep_their_digits():
    r = np.random.default_rng(1)
    scale = np.logspace(0, -7, 20)
    a = np.linalg.qr(r.normal(size=(20, 20)))[0]
    v = scale[:, None] * (a @ np.diag(np.linspace(1, 2, 20)) @ a.T) * scale
    values, axes = W.one_sided_jacobi(W.pivoted_cholesky(v))
    assert np.allclose(axes * values @ axes.T, v, rtol=1e-12, atol=1e-18) and np.allclose(axes.T @ axes, np.eye(20), atol=1e-13)
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    residual = [[sum(Decimal(float(v[i, j])) * Decimal(float(axes[j, 19])) for j in range(20))] for i in range(20)]
    assert max(abs(float(x[0]) - values[19] * axes[i, 19]) for i, x in enumerate(residual)) < 1e-12 * values[0]


@pytest.mark.parametrize("rank", [0, 1, 3])
def test_vectors_in_a_plane_have_as_many_components(shipped, rank):
    r = np.random.default_rng(3)
    base = np.zeros((60, 6), np.float32)
    base[:, :rank] = r.integers(-40, 40, (60, rank)) / 64
    found = W.whitened(table(shipped, list(enumerate(base.tolist())))).collect()
    assert {q.component for q in found} == set(range(1, rank + 1)) and len(found) == 60 * rank
    assert not found or max(q.identity_error for q in found) < 1e-9


def test_exact_squares_beyond_a_long():
    z = np.array([[2**61 + 1, -(2**60)], [3, 4]], np.int64)
    assert [int(v) for v in W.deviations(z).to_pylist()] == [(2**61 + 1) ** 2 + 2**120, 25]
    with pytest.raises(OverflowError):
        W.Fit(2**40, np.array([0])).centred(np.array([[2**30]]))


def test_empty_tables(shipped, vectors):
    assert W.whitened(table(shipped, [])).count() == 0
    assert W.whitened(table(shipped, [(1, None), (2, [])])).count() == 0
