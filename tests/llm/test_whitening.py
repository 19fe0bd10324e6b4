"""Whitening against a dense eigensolver, and its solver against numpy's."""

import numpy as np
import pytest

from threadspark.llm import qd_svd, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, whitened string, part string, n string"


def make(spark, vectors):
    return spark.createDataFrame([(k, v, 0, "a", "b", "c") for k, v in enumerate(vectors)], SCHEMA)


def dense(vectors, top):
    """Components of the covariance and whitened rows, straight from the definition."""
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    away = x - sums / n
    values, basis = np.linalg.eigh(away.T @ away / n)
    values, basis = values[::-1], basis[:, ::-1]
    return n, ((n * x - sums) ** 2).sum(axis=1), values[:top], away @ basis[:, :top] / np.sqrt(values[:top]), values / values.sum()


@pytest.mark.parametrize("size,rows,top", [(6, 500, 4), (40, 900, 32)])
def test_whitened_rows_equal_a_dense_solver(spark, size, rows, top):
    pick = np.random.default_rng(size)
    vectors = (pick.standard_normal((rows, size)) * np.linspace(0.1, 5, size) + 3).tolist()
    vectors += vectors[:20]
    frame = make(spark, vectors).repartition(7)
    found = whitening.whitened_components(frame, top).toPandas()
    n, deviation, _, expected, shares = dense(vectors, top)
    assert len(found) == n * top and set(found["n"]) == {n}
    own = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    signs = np.sign((own * expected).sum(axis=0))
    assert np.abs(own * signs - expected).max() < 1e-8
    assert [int(v) for v in found.drop_duplicates("vec_id").sort_values("vec_id")["deviation"]] == deviation.tolist()
    assert np.allclose(found.drop_duplicates("component").sort_values("component")["explained"], shares[:top], rtol=1e-9)
    assert found["identity_error"].max() < 1e-9 and found["identity_error"].nunique() == 1


def test_vectors_that_take_no_part(spark):
    odd = [None, [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], [1e30, 0.0]]
    fine = [[0.5, 1.0], [1.5, -1.0], [2.5, 0.25], [], [1.0]]
    rows = make(spark, odd + fine).unionByName(make(spark, [[0.5, 1.0]]).selectExpr("cast(null as long) vec_id", "embedding", "label", "whitened", "part", "n"))
    found = whitening.whitened_components(rows).toPandas()
    assert len(found) == 6 * 2 and set(found["n"]) == {6} and found["vec_id"].isna().sum() == 2
    n, deviation, _, expected, _ = dense([[0.5, 1.0], [1.5, -1.0], [2.5, 0.25], [0, 0], [1.0, 0], [0.5, 1.0]], 2)
    own = found[found["vec_id"].notna()].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(np.abs(own), np.abs(expected[:5])) and found["identity_error"].max() < 1e-9
    assert sorted(map(int, found["deviation"]))[::2] == sorted(deviation.tolist())


def test_components_without_variance(spark):
    found = whitening.whitened_components(make(spark, [[1.0, 2.0, 3.0]] * 5)).toPandas()
    assert len(found) == 15 and found["whitened"].isna().all() and set(found["identity_error"]) == {0.0} and set(found["explained"]) == {0.0}
    line = whitening.whitened_components(make(spark, [[float(k), 2.0 * k, 1.0] for k in range(9)])).toPandas()
    assert line[line["component"] == 1]["whitened"].notna().all() and line[line["component"] > 1]["whitened"].isna().all()
    assert line["identity_error"].max() < 1e-12
    assert whitening.whitened_components(make(spark, []).limit(0)).count() == 0


def test_large_numbers_stay_exact(spark):
    vectors = [[1e16, 3.0], [-1e16, 5.0], [2e15, 1.0]]
    found = whitening.whitened_components(make(spark, vectors), 1).toPandas().sort_values("vec_id")
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert [int(v) for v in found["deviation"]] == [sum((3 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]


def cases():
    pick = np.random.default_rng(1)
    turn = lambda n: np.linalg.qr(pick.standard_normal((n, n)))[0]
    yield from (pick.standard_normal((n, n)) for n in (1, 2, 3, 7, 50))
    yield np.linalg.qr(pick.standard_normal((100_000, 24)), mode="r")  # all eigenvalues in one cluster
    yield turn(30) @ np.diag([5.0] * 10 + [3.0] * 10 + [1.0] * 10) @ turn(30)
    yield turn(30) @ np.diag(1 + 1e-9 * pick.standard_normal(30)) @ turn(30)
    yield turn(30) @ np.diag(1 + 1e-15 * pick.standard_normal(30)) @ turn(30)
    yield turn(30) @ np.diag(10.0 ** -np.arange(30)) @ turn(30)
    yield pick.standard_normal((40, 5)) @ pick.standard_normal((5, 40))
    yield from (np.eye(9), np.zeros((4, 4)), np.ones((8, 8)), np.zeros((0, 0)))
    wilkinson = np.diag(np.abs(np.arange(-10, 11)) + 1.0) + np.diag(np.ones(20), 1)
    yield wilkinson


@pytest.mark.parametrize("a", list(cases()))
def test_solver_gives_orthonormal_singular_vectors(a):
    values, vectors = qd_svd.right_vectors(a)
    size = max(float((a * a).sum()), 1e-300)
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max(initial=0) < 1e-11
    assert np.abs(a.T @ (a @ vectors) - vectors * values).max(initial=0) < 1e-13 * size
    assert np.abs(values - np.linalg.svd(a, compute_uv=False) ** 2).max(initial=0) < 1e-13 * size if len(a) else True


def test_dqds_keeps_tiny_values_accurate():
    # a graded bidiagonal matrix whose small singular values an ordinary solver loses
    d, f = 10.0 ** -np.arange(0, 40, 4.0), 10.0 ** -np.arange(1, 37, 4.0)
    found = qd_svd.dqds(d * d, f * f)
    assert np.isclose(np.sum(np.log10(found)), 2 * np.sum(np.log10(d)), rtol=1e-12)  # the determinant
