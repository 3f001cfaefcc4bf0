"""Statistics against closed forms, numpy and definitions."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import statistics as S


@given(st.floats(0.001, 200), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_chi_square_tail_has_its_closed_forms(x, half):
    even = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half))
    assert S.chi_square_tail(x, 2 * half) == pytest.approx(even, rel=1e-9, abs=1e-14)
    odd = math.erfc(math.sqrt(x / 2)) + math.exp(-x / 2) * sum((x / 2) ** (k - 0.5) / math.gamma(k + 0.5) for k in range(1, half))
    assert S.chi_square_tail(x, 2 * half - 1) == pytest.approx(odd, rel=1e-9, abs=1e-12)


def test_chi_square_tail_of_nothing():
    assert S.chi_square_tail(0, 3) == S.chi_square_tail(-1, 3) == S.chi_square_tail(7, 0) == 1.0


def plain_g(table):
    expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    some = table > 0
    return 2 * (table[some] * np.log(table[some] / expected[some])).sum()


def test_g():
    rng = np.random.default_rng(31)
    for shape in ((2, 2), (3, 5), (4, 2)):
        table = rng.integers(0, 30, shape) + np.eye(*shape, dtype=int)
        assert S.g_statistic(table.tolist()) == (pytest.approx(plain_g(table)), (shape[0] - 1) * (shape[1] - 1))
        padded = np.pad(table, ((0, 1), (0, 1)))  # rows and columns without counts do not count
        assert S.g_statistic(padded.tolist())[1] == (shape[0] - 1) * (shape[1] - 1)
    assert S.g_statistic([[11, 0], [2, 0]]) == (0.0, 0)


def test_conditional_g_sums_over_strata():
    rng = np.random.default_rng(32)
    tables = {s: rng.integers(1, 40, (2, 3)) for s in ("p", "q")}
    cells = {(f"x{i}", f"y{j}", s): int(t[i, j]) for s, t in tables.items() for i in range(2) for j in range(3)}
    g, dof, p = S.conditional_g(cells)
    assert (g, dof) == (pytest.approx(sum(map(plain_g, tables.values()))), 4) and p == pytest.approx(math.exp(-g / 2) * (1 + g / 2))
    assert S.conditional_g({("x0", "y0", "p"): 9, ("x1", "y0", "p"): 4}) is None


def test_correlations():
    rng = np.random.default_rng(33)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    sums, squares = x.sum(0).tolist(), (x * x).sum(0).tolist()
    crosses = {(i, j): float((x[:, i] * x[:, j]).sum()) for i in range(4) for j in range(i + 1, 4)}
    assert S.pearson(200, sums[0], sums[1], squares[0], squares[1], crosses[0, 1]) == pytest.approx(np.corrcoef(x.T)[0, 1])
    matrix = S.correlation_matrix(200, sums, squares, crosses)
    assert np.allclose(matrix, np.corrcoef(x.T))
    p = np.linalg.inv(np.corrcoef(x.T))
    assert S.partial_correlation(matrix) == pytest.approx(-p[0, 1] / math.sqrt(p[0, 0] * p[1, 1]))
    assert S.pearson(7, 14.0, 21.0, 28.0, 91.0, 42.0) is None  # a constant
    assert S.pearson(1, 1.0, 1.0, 1.0, 1.0, 1.0) is None
    one = [[1.0, 1.0, 0.3], [1.0, 1.0, 0.3], [0.3, 0.3, 1.0]]
    assert S.partial_correlation(one) is None  # no inverse


@given(st.floats(-0.99, 0.99), st.integers(6, 500), st.integers(0, 2))
@settings(max_examples=100, deadline=None)
def test_fisher(r, n, k):
    z = math.sqrt(n - k - 3) * math.atanh(r)
    assert S.fisher_p(r, n, k) == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-12)
    assert S.fisher_p(r, k + 3, k) is None
    if n >= k + 8:  # one stratum, and two that are alike
        assert S.pooled_fisher_p([r], [n], k) == pytest.approx(S.fisher_p(r, n, k), abs=1e-12)
        assert S.pooled_fisher_p([r, r, 0.9], [n, n, k + 7], k) == pytest.approx(math.erfc(abs(z) * math.sqrt(2) / math.sqrt(2)), abs=1e-12)
    assert S.pooled_fisher_p([r], [k + 7], k) is None


@given(st.lists(st.floats(0, 1), max_size=30), st.sampled_from([0.01, 0.05, 0.2]))
@settings(max_examples=200, deadline=None)
def test_benjamini_hochberg_is_its_definition(ps, alpha):
    ordered, m = sorted(ps), len(ps)
    last = max([k for k in range(1, m + 1) if ordered[k - 1] <= k * alpha / m], default=0)
    found = S.benjamini_hochberg(ps, alpha)
    threshold = S.rejection_threshold([(p, ps.count(p)) for p in set(ps)], alpha)
    assert sum(p <= threshold for p in ps) == last
    assert sum(found) == last and all(p <= ordered[last - 1] for p, x in zip(ps, found, strict=True) if x)
