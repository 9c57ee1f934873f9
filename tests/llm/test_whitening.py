"""Whitening against numpy's own eigenvectors and exact integers."""

import math

import numpy as np
import pytest

from listwatch.llm.whitening import Whitening, _gram, components, polar


def matrices():
    rng = np.random.default_rng(7)
    for m in (1, 2, 3, 17, 64):
        yield np.cov(rng.standard_normal((300, m)).T, bias=True).reshape(m, m)
    x = rng.standard_normal((400, 40)) * 10.0 ** -np.linspace(0, 5, 40)
    yield np.cov(x.T, bias=True)
    yield np.cov(rng.standard_normal((9, 30)).T, bias=True)
    yield np.diag([5.0, 5.0, 5.0, 1.0, 1.0, 0.0])
    yield np.zeros((4, 4))
    yield np.eye(6) * 3


def test_components_are_eigenvectors():
    for a in matrices():
        values, vectors = components(a)
        scale = max(1e-300, np.abs(a).max())
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * len(a) * scale
        assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() <= 1e-13
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * len(a) * scale


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((12, 12)))[0]
    values = np.array([-3, -1, -1e-6, 1e-9, 1e-3, 2, 5, -8, 4, 4, -4, 1.0])
    assert np.abs(polar(q @ np.diag(values) @ q.T) - q @ np.diag(np.sign(values)) @ q.T).max() < 1e-5


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for top in (3, 1 << 20, 1 << 30, 1 << 45):
        d = rng.integers(-top, top, (200, 5))
        assert (_gram(d) == d.astype(object).T @ d.astype(object)).all()


def brute(vectors, top):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:top], basis[:, ::-1][:, :top]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return deviation, centred @ basis / np.sqrt(values), values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("dims, top", [(6, 32), (48, 32), (5, 2)])
def test_rows_equal_brute_force(spark, dims, top):
    rng = np.random.default_rng(dims)
    data = rng.standard_normal((400, dims)) @ rng.standard_normal((dims, dims))
    rows = [(i, [float(np.float32(c)) for c in v], 1, "x") for i, v in enumerate(data)]
    rows += [(400 + i, rows[7][1], 1, "x") for i in range(150)]
    odd = [(900, None, 0, ""), (901, [None] + rows[0][1][1:], 0, ""), (902, [math.nan] + rows[0][1][1:], 0, ""),
           (903, [-math.inf] + rows[0][1][1:], 0, ""), (904, [], 0, ""), (905, rows[0][1][1:], 0, ""), (906, [3e38] + rows[0][1][1:], 0, "")]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n int, component string").repartition(5)
    found = Whitening(top=top).transform(table).collect()
    k = min(top, dims)
    deviation, whitened, explained = brute([v for _, v, *_ in rows], top)
    at = {(r["vec_id"], r["component"]): r for r in found}
    assert len(found) == len(at) == len(rows) * k
    mine = np.array([[at[i, c + 1]["whitened"] for c in range(k)] for i in range(len(rows))])
    mine *= np.sign((mine * whitened).sum(axis=0))
    assert np.abs(mine - whitened).max() < 1e-8
    assert [at[i, 1]["deviation"] for i in range(len(rows))] == deviation
    assert np.allclose([at[0, c + 1]["explained"] for c in range(k)], explained, rtol=1e-9)
    assert {r["n"] for r in found} == {len(rows)} and max(r["identity_error"] for r in found) < 1e-9


def test_tables_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    run = lambda rows: Whitening().transform(spark.createDataFrame(rows, schema)).collect()
    assert run([]) == [] and run([(1, None)]) == [] and run([(1, [])]) == [] and run([(1, [1.0, 2.0])]) == []
    assert run([(1, [1.0, 2.0])] * 5) == []
    flat = run([(None, [1.0, 2.0]), (2, [3.0, 2.0]), (2, [3.0, 2.0]), (4, [5.0, 2.0])])
    assert {r["component"] for r in flat} == {1} and len(flat) == 4 and all(r["explained"] == 1.0 for r in flat)


def test_deviation_beyond_64_bits_is_null(spark):
    table = spark.createDataFrame([(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    found = Whitening().transform(table).collect()
    assert {r["vec_id"]: r["deviation"] for r in found if r["component"] == 1} == {1: None, 2: None, 3: 36864}
