"""Whitening against floating-point eigenvectors and exact integers; degenerate tables."""

import math
from fractions import Fraction

import numpy as np
import pytest

from quakeframe.llm import queries, whitening
from tests.llm.test_operators import SF


def plain(vectors):
    """n, sums, whitened up to sign, shares and deviations, by numpy and Python integers."""
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors], dtype=object)
    n, total = len(x), x.sum(axis=0)
    y = x * n - total
    centred = y.astype(float) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    keep = e[::-1] > 1e-6 * e[-1]
    axes = u[:, ::-1][:, keep][:, :8]
    return n, centred @ axes / np.sqrt(e[::-1][keep][:8]), (e[::-1] / e.sum())[keep][:8], [int((r * r).sum()) for r in y]


def compare(got, ids, vectors):
    n, white, shares, deviations = plain(vectors)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    for k in range(white.shape[1]):
        own = np.array([by[i][k + 1]["whitened"] for i in ids])
        assert min(abs(own - white[:, k]).max(), abs(own + white[:, k]).max()) < 1e-8
        assert all(by[i][k + 1]["explained"] == pytest.approx(shares[k], rel=1e-9) for i in ids)
    assert len(got) == len(ids) * white.shape[1]
    assert all(r["n"] == n and r["identity_error"] < 1e-9 for r in got)
    assert [by[i][1]["deviation"] for i in ids] == deviations


def test_query_equals_numpy(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    sound = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    compare(queries.op13_embedding_whitening(spark, SF).collect(), [i for i, _ in sound], [v for _, v in sound])


def test_polynomial_and_roots_are_exact(spark):
    draw = np.random.default_rng(3)
    for d in (1, 2, 3, 7, 12):
        a = draw.integers(-9, 9, (d, max(1, d - d // 4)))
        m = [[int(v) for v in row] for row in a @ a.T]
        poly = whitening.characteristic_polynomial(spark, m)
        for t in (-3, 0, 2, 11):  # det(t I - M) by fractions
            rows, want = [[Fraction((t if i == j else 0) - m[i][j]) for j in range(d)] for i in range(d)], Fraction(1)
            for i in range(d):
                pivot = next((r for r in range(i, d) if rows[r][i]), None)
                if pivot is None:
                    want = Fraction(0)
                    break
                if pivot != i:
                    rows[i], rows[pivot], want = rows[pivot], rows[i], -want
                want *= rows[i][i]
                for r in range(i + 1, d):
                    f = rows[r][i] / rows[i][i]
                    rows[r] = [x - f * y for x, y in zip(rows[r], rows[i], strict=True)]
            assert sum(c * t**k for k, c in enumerate(poly)) == want
        roots = [top / (1 << shift) for top, shift, _ in whitening.largest_roots(poly, d)]
        assert np.allclose(roots, [e for e in np.linalg.eigvalsh(np.array(m, dtype=float))[::-1] if e > 1e-6], rtol=1e-9)


def test_equal_eigenvalues_have_orthogonal_components():
    m = [[5, 0, 0, 0], [0, 5, 0, 0], [0, 0, 5, 0], [0, 0, 0, 2]]
    poly = [250, -275, 105, -17, 1]  # (t - 5)**3 (t - 2)
    roots = whitening.largest_roots(poly, 4)
    assert [round(top / (1 << shift), 12) for top, shift, _ in roots] == [5, 5, 5, 2] and len({g for *_, g in roots}) == 2
    v = np.array(whitening.components(m, roots))
    assert np.allclose(v @ v.T, np.eye(4), atol=1e-14)


def test_close_eigenvalues_are_told_apart():
    big = 10**12
    roots = whitening.largest_roots([big * (big + 1), -(2 * big + 1), 1], 2)
    assert [top / (1 << shift) for top, shift, _ in roots] == [big + 1, big] and len({g for *_, g in roots}) == 2


def test_left_out_repeated_and_degenerate_rows(spark):
    draw = np.random.default_rng(9)
    vectors = [[float(c) for c in v] for v in draw.normal(size=(30, 5)) * [1, 2, 3, 0.5, 0]]
    rows = [(i, v, "clash") for i, v in enumerate(vectors)]
    odd = [(90, None, ""), (91, [1.0, None, 0.0, 0.0, 0.0], ""), (92, [float("nan")] * 5, ""), (93, [float("inf")] + [0.0] * 4, ""), (94, [], ""), (95, [1.0, 2.0], "")]
    kind = "vec_id long, embedding array<double>, whitened string"
    compare(whitening.whiten(spark.createDataFrame(rows + odd, kind)).collect(), range(30), vectors)
    again = whitening.whiten(spark.createDataFrame([(None, [0.0, 1.0], ""), (None, [0.0, 1.0], ""), (1, [0.5, 0.0], "")], kind)).collect()
    assert len(again) == 3 and len({r["whitened"] for r in again if r["vec_id"] is None}) == 1
    for flat in ([], odd, [(1, [0.5, 0.5], ""), (2, [0.5, 0.5], "")]):
        assert whitening.whiten(spark.createDataFrame(flat, kind)).count() == 0


def test_large_entries_stay_exact(spark):
    draw = np.random.default_rng(4)
    vectors = [[float(c) for c in v] for v in draw.normal(size=(12, 3)) * [1e12, 1e9, 1.0]]
    x = whitening.integer_vectors(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"))
    n, totals = whitening.sums(x)
    whole = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    assert totals == [sum(v[i] for v in whole) for i in range(3)]
    assert whitening.scatter(x, n, totals) == [[n * sum(v[i] * v[j] for v in whole) - totals[i] * totals[j] for j in range(3)] for i in range(3)]
    model = whitening.fit(x)
    held = [r["deviation"] for r in whitening.project(x, model).collect()]
    assert set(held) == {whitening.MOST}
