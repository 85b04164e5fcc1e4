"""Moments, axes and probes against numpy."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from conceptframe.operators import geometry


def table(spark, x, y=None):
    rows = [(i, r.tolist(), None if y is None else float(y[i])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, v array<double>, y double").repartition(3)


def data(n=80, width=5, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, width)) @ rng.normal(size=(width, width)) + 3


def test_network_is_the_correlation_matrix(spark):
    x = data()
    x[:, 4] = 2.0
    want = np.corrcoef(x[:, :4].T)
    for r in geometry.concept_network(table(spark, x), "v").collect():
        assert r.weight is None if r.b == 4 else abs(r.weight - want[r.a, r.b]) < 1e-9


def test_axes(spark):
    x = data()
    out, axes, shares, total = geometry.pca(table(spark, x), "v", 2)
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(shares, s[:2] ** 2 / (s ** 2).sum())
    for k in range(2):
        assert abs(abs(axes[k] @ vt[k]) - 1) < 1e-9 and axes[k][np.abs(axes[k]).argmax()] > 0
    got = np.array([r.scores for r in out.orderBy("id").collect()])
    assert np.allclose(got, c @ axes.T)


def test_ridge(spark):
    x = data(seed=2)
    y = x @ np.arange(5) + np.random.default_rng(3).normal(size=len(x))
    w, b, _ = geometry.fit_ridge(table(spark, x, y), "v", "y", (2.0,))
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    want = np.linalg.solve(z.T @ z + 2 * np.eye(5), z.T @ (y - y.mean())) / x.std(0, ddof=1)
    assert np.allclose(w, want) and abs(b - (y.mean() - want @ x.mean(0))) < 1e-9
    best = geometry.fit_ridge(table(spark, x, y), "v", "y", (1e6, 0.1), dev=table(spark, x, y))
    assert best[2] == 0.1
    with pytest.raises(PySparkException):
        geometry.predict_scores(table(spark, x[:, :3]), "v", w, b).collect()


def test_network_comparison(spark):
    edges = lambda w: spark.createDataFrame([(0, 1, w[0]), (0, 2, w[1]), (1, 2, w[2])], "a int, b int, weight double")
    same = geometry.compare_networks(edges([0.5, -0.2, 0.0]), edges([0.5, -0.2, 0.0])).first()
    assert (same.edge_weight_spearman, same.top_k_edge_jaccard, same.common_edge_sign_agreement) == (1.0, 1.0, 1.0)
    other = geometry.compare_networks(edges([0.5, -0.2, 0.0]), edges([-0.5, 0.0, 0.1])).first()
    assert abs(other.top_k_edge_jaccard - 1 / 3) < 1e-12 and other.common_edge_sign_agreement == 0.0


def test_bad_vectors(spark):
    for rows in ([(0, [1.0, float("nan")], None)], [(0, [1.0], None), (1, [1.0, 2.0], None)]):
        with pytest.raises(PySparkException):
            geometry.moments(spark.createDataFrame(rows, "id bigint, v array<double>, y double").coalesce(1), "v").collect()


def test_clusters(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(30, 2)) + c for c in ((0, 0), (9, 9), (-9, 9))])
    df = table(spark, x)
    out, centres, inertia = geometry.kmeans(df, "id", "v", 3)
    got = np.array([r.cluster for r in out.orderBy("id").collect()])
    assert (got == ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)).all()
    for c in range(3):
        assert np.allclose(centres[c], x[got == c].mean(0))
    again, _, same = geometry.kmeans(df.repartition(7), "id", "v", 3)
    assert (np.array([r.cluster for r in again.orderBy("id").collect()]) == got).all()
