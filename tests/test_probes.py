"""Logistic probes against a dense solver, constants, grids and refusals."""

import numpy as np
import pytest

from conceptframe.operators import probes
from conceptframe.schema import Refused


def table(spark, x, y):
    names = [f"y{k}" for k in range(y.shape[1])]
    rows = [(a.tolist(), *map(int, b)) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, "v array<double>, " + ", ".join(f"{n} int" for n in names)).repartition(3), names


def dense(x, y, c):
    z = np.hstack([(x - x.mean(0)) / x.std(0), np.ones((len(x), 1))])
    w, hold = np.zeros(z.shape[1]), np.append(np.ones(x.shape[1]), 0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve(c * (z * (p * (1 - p))[:, None]).T @ z + np.diag(hold), c * z.T @ (p - y) + hold * w)
    return w[:-1] / x.std(0), w[-1] - (w[:-1] * x.mean(0) / x.std(0)).sum()


def test_weights_equal_a_dense_solver_and_dev_chooses(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 3)) * [1, 5, 0.1] + [0, 40, 2]
    y = np.column_stack([(x[:, 0] + rng.normal(size=240) > 0), (x[:, 1] > 42), np.ones(240), np.zeros(240)]).astype(int)
    df, names = table(spark, x, y)
    for c in (0.1, 10.0):
        probe = probes.fit_logistic(df, "v", names, [c])
        for k in (0, 1):
            w, b = dense(x, y[:, k], c)
            assert np.allclose(probe.weights[k], w, atol=1e-6) and abs(probe.biases[k] - b) < 1e-5
    assert probe.constants == {"y2": 1.0, "y3": 0.0}
    out = probe.predict(df.limit(5), "v").collect()
    assert all(r.p_y2 == 1 and r.p_y3 == 0 and 0 < r.p_y0 < 1 for r in out)
    chosen = probes.fit_logistic(df, "v", names[:2], dev=df)
    assert [p for p, _ in chosen.trials] == [0.01, 0.1, 1, 10] and chosen.dev_score == max(s for _, s in chosen.trials)


def test_scaler_takes_training_rows_only_and_separable_labels_settle(spark):
    x = np.arange(20.0).reshape(-1, 1)
    df, names = table(spark, x, (x > 9).astype(int))
    far, _ = table(spark, np.array([[-10.0], [100.0]]), np.array([[0], [1]]))
    probe = probes.fit_logistic(df, "v", names, [0.1, 1.0], dev=far)
    assert abs(probe.biases[0] + 9.5 * probe.weights[0, 0]) < 1e-8 and probe.dev_score == 1 and probe.penalty == 0.1


def test_refusals(spark):
    df, names = table(spark, np.arange(4.0).reshape(-1, 1), np.array([[0], [1], [2], [0]]))
    good, _ = table(spark, np.arange(4.0).reshape(-1, 1), np.array([[0], [1], [1], [0]]))
    for rows, grid in ((df, [1.0]), (good.limit(0), [1.0]), (good, []), (good, [0.0]), (good, [float("inf")])):
        with pytest.raises(Refused):
            probes.fit_logistic(rows, "v", names, grid)
    with pytest.raises(Refused, match="undefined"):
        probes.fit_logistic(good, "v", names, [1.0], dev=good.filter("y0 = 0"))
