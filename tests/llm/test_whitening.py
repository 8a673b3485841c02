"""Whitening: divide and conquer against numpy's eigensolver, the query against brute force."""

import numpy as np
import pytest

from calibspark.llm import whitening as W
from tests.conftest import SF_SMALL


def spectrum(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize("values", [
    [5.0], [3, 3, 3, 3], list(range(1, 41)), [1e6] + [1.0 + 1e-3 * i for i in range(20)], [4, 4, 4, 1, 1, 0, 0, 0],
    [10 ** -i for i in range(12)], [2, 2 + 1e-9, 1, 0], [0, 0, 0]])
def test_components_equal_numpy(values):
    a = spectrum(values)
    e, v = W.spectral_components(a)
    want = np.sort(np.linalg.eigvalsh(a))[::-1]
    scale = max(abs(want).max(), 1e-300)
    assert np.allclose(e, want, atol=1e-12 * scale)
    assert np.abs(v @ v.T - np.eye(len(values))).max() < 1e-11
    assert np.abs(v @ a - e[:, None] * v).max() <= 1e-11 * scale


def test_top_components_only():
    a = spectrum([1.5 ** i for i in range(30)], 3)
    e, v = W.spectral_components(a, 4)
    want, u = np.linalg.eigh(a)
    assert np.allclose(e, want[::-1][:4]) and v.shape == (4, 30)
    assert np.abs(np.abs(np.sum(v * u[:, ::-1][:, :4].T, 1)) - 1).max() < 1e-10


def test_polar_factor_is_the_sign():
    a = spectrum([5, 1, 1e-3, -2, -4], 1)
    w, u = np.linalg.eigh(a)
    assert np.abs(W.polar(a) - (u * np.sign(w)) @ u.T).max() < 1e-11


def brute(rows):
    kept = [(i, [int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v]) for i, v in rows]
    x = [v for _, v in kept]
    n, s = len(x), [sum(c) for c in zip(*x)]
    y = np.array([[c - t / n for c, t in zip(v, s)] for v in x])
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    return {(i, j + 1): (n, sum((n * c - t) ** 2 for c, t in zip(v, s)), abs(float(yy @ u[:, j]) / np.sqrt(e[j])), e[j] / np.trace(cov))
            for (i, v), yy in zip(kept, y) for j in range(len(e))}


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    want = brute(rows)
    got = W.op11_embedding_whitening(spark, SF_SMALL).collect()
    assert len(got) == len(want) == len(rows) * 8
    signs = {}
    for r in got:
        n, dev, white, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, dev) and abs(abs(r.whitened) - white) < 1e-7
        assert abs(r.explained / explained - 1) < 1e-9 and r.identity_error < 1e-9
        signs.setdefault(r.component, []).append(r.whitened)
    assert all(abs(np.mean(z)) < 1e-9 and abs(np.mean(np.square(z)) - 1) < 1e-9 for z in signs.values())


def table(spark, folder, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int, n int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_edge_vectors(spark, tmp_path):
    inf, nan = float("inf"), float("nan")
    rng = np.random.default_rng(0)
    good = [(i, [float(c) for c in rng.standard_normal(3)], 1, 1) for i in range(20)]
    bad = [(100, None, 1, 1), (101, [1.0, None, 2.0], 1, 1), (102, [1.0, inf, 2.0], 1, 1), (103, [nan, 1.0, 2.0], 1, 1), (104, [], 1, 1),
           (105, [1.0, 2.0], 1, 1), (106, [1e30, 0.0, 0.0], 1, 1)]
    got = W.op11_embedding_whitening(spark, table(spark, tmp_path, good + [(3, good[3][1], 1, 1), (None, good[4][1], 1, 1)] + bad)).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(str(i) for i in [*range(20), 3, None] for _ in range(3))
    assert {r.n for r in got} == {22} and {r.component for r in got} == {1, 2, 3}
    assert len({round(r.whitened, 9) for r in got if r.vec_id == 3 and r.component == 1}) == 1


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 1, 1)], [(1, [1.0, 2.0], 1, 1)] * 5, [(1, None, 1, 1)]])
def test_without_variance(spark, tmp_path, rows):
    assert W.op11_embedding_whitening(spark, table(spark, tmp_path, rows)).collect() == []


def test_flat_direction_has_no_component(spark, tmp_path):
    got = W.op11_embedding_whitening(spark, table(spark, tmp_path, [(i, [float(i), 2.0], 1, 1) for i in range(9)])).collect()
    assert len(got) == 9 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12


def test_large_deviation_is_exact():
    x = np.array([[1 << 40, 5], [0, 7]])
    assert W.deviations(x, 2, [1 << 40, 12]) == [None, None]
    assert W.deviations(x >> 20, 2, [1 << 20, 0]) == [(1 << 40), (1 << 40)]


def test_general_interface(spark):
    rng = np.random.default_rng(2)
    m = rng.standard_normal((200, 5)) * [5, 4, 3, 2, 1]
    df = spark.createDataFrame([(r.tolist(),) for r in m], "v array<double>")
    model = W.fit(df, "v")
    z = np.array([r.whitened for r in W.whiten(df, "v", model).collect()])
    assert np.abs(np.cov(z.T, bias=True) - np.eye(5)).max() < 1e-10
