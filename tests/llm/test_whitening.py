"""Whitening against numpy's eigenvectors; contour and inertia on matrices with known ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetflow.llm import embedding_whitening as W


def plain(vectors, k=4):
    """{row: (deviation, |whitened|)}, n, explained by numpy."""
    x = np.floor(256 * np.array(vectors, np.float64)) + 0
    fit = np.unique(x, axis=0)
    n = len(fit)
    v = np.cov(fit.T, bias=True)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    s = [int(a) for a in fit.sum(axis=0)]
    deviations = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return n, deviations, (x - fit.mean(axis=0)) @ u / np.sqrt(e), e / np.trace(v)


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    ids, vectors = zip(*[(r["vec_id"], r["embedding"]) for r in rows.collect()], strict=True)
    n, deviations, whitened, explained = plain(vectors)
    got = W.whiten(rows).collect()
    assert len(got) == 4 * len(ids)
    at = {v: i for i, v in enumerate(ids)}
    own = np.zeros((len(ids), 4))
    for r in got:
        assert (r["n"], r["deviation"]) == (n, deviations[at[r["vec_id"]]])
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
        own[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
    signs = np.sign((own * whitened).sum(axis=0))
    assert np.abs(own - whitened * signs).max() < 1e-8


def test_odd_vectors(spark, none):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(30, 3)).round(3).tolist()
    nan, inf = float("nan"), float("inf")
    rows = [(i, v) for i, v in enumerate(good)] + [(1, good[1]), (None, good[2]), (50, None), (51, []), (52, [nan, 1.0, 2.0]), (53, [inf, 1.0, 2.0]), (54, [None, 1.0, 2.0]), (55, [1.0, 2.0]), (56, [-0.0, 0.0, 1e-9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"n": F.lit("x"), "component": F.lit(9), "x": F.lit(1), "whitened": F.lit(None)})
    got = W.whiten(df).collect()
    ids = [r["vec_id"] for r in got]
    assert len(got) == 33 * 3 and ids.count(1) == 6 and ids.count(None) == 3 and not {50, 51, 52, 53, 54, 55} & set(ids)
    n, deviations, *_ = plain([*good, [0, 0, 0]])
    assert {r["n"] for r in got} == {n} and {int(r["deviation"]) for r in got if r["vec_id"] is not None} == set(deviations)
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert W.whiten(empty).collect() == []
    same = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<float>")
    assert W.whiten(same).collect() == []
    line = spark.createDataFrame([(i, [i / 8, i / 4, 0.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert {r["component"] for r in W.whiten(line).collect()} == {1}
    huge = spark.createDataFrame([(i, [1e30 * (i % 2), float(i)]) for i in range(4)], "vec_id long, embedding array<double>")
    assert len(W.whiten(huge).collect()) > 0


def turned(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    m = q @ np.diag(values) @ q.T
    return (m + m.T) / 2


@pytest.mark.parametrize("values", [
    [5.0, 3, 0, 0, 0], [1.0] * 12, [5.0] * 5 + [1.0] * 3, [2.0], 10.0 ** np.arange(0, -12, -1), [1, 1 - 1e-7, 1 - 2e-7, 0.5, 0.5 - 1e-8, 0.2], [1, 1 - 1e-10, 1 - 2e-10, 0.5, 0.5, 0.2],
    1400 + np.linspace(0, 100, 40)])
def test_contour(values):
    m = turned(np.array(values, float))
    e, v = W.components(m, 4)
    want = np.sort(np.array(values, float))[::-1]
    want = want[want > 0][:4]
    assert np.allclose(e, want, rtol=1e-12) and np.abs(m @ v - v * e).max() < 1e-13 * len(m) * want[0] and np.abs(v.T @ v - np.eye(len(e))).max() < 1e-11


def test_inertia():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 30):
        for _ in range(20):
            a = rng.standard_normal((n, n))
            a, shift = a + a.T, rng.normal()
            assert W.inertia(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
    assert W.inertia(np.zeros((4, 4)), 0.0) == 0 and W.inertia(np.array([[0.0, 1], [1, 0]]), 0.0) == 1


def test_missing_pairs_are_told():
    with pytest.raises(ArithmeticError):
        W.feast(np.diag([3.0, 2.0, 1.0]), 1.5, 4.0, 1)
