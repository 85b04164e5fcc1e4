"""Edge bootstrap and controls against direct recomputation."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from conceptframe.operators import uncertainty
from conceptframe.operators.resample import group_weights, numbered_groups


def table(spark, x, y, groups):
    return spark.createDataFrame([(f"s{i}", int(g), a.tolist(), b.tolist()) for i, (g, a, b) in enumerate(zip(groups, x, y))], "id string, g int, v array<double>, h array<double>").repartition(3)


def test_edges_of_every_draw_equal_recomputed_ones(spark):
    rng = np.random.default_rng(1)
    x, y, groups = rng.normal(size=(60, 4)) + 50, rng.normal(size=(60, 4)), np.arange(60) % 7
    df = table(spark, x, y, groups)
    edges, summary = uncertainty.edge_bootstrap(df, "g", "v", "h", replicates=40, top=2)
    number = {r.g: r._number for r in numbered_groups(df.select("g").distinct(), "g").collect()}
    weights = np.zeros((40, 7))
    for r in group_weights(spark, 7, 40).collect():
        weights[r.replicate, r._number] = r.weight
    corr = lambda z: np.corrcoef(z, rowvar=False)[np.triu_indices(4, 1)]
    draws = [np.repeat(np.arange(60), [int(weights[r, number[g]]) for g in groups]) for r in range(40)]
    want = np.array([corr(x[d]) for d in draws])
    got = edges.orderBy("a", "b").collect()
    assert [r.weight for r in got] == pytest.approx(corr(x))
    assert [(r.ci_lower, r.ci_upper) for r in got] == [pytest.approx(tuple(q)) for q in np.quantile(want, [0.025, 0.975], axis=0).T]
    top = np.array([np.isin(np.arange(6), np.argsort(-abs(w))[:2]) for w in want]).mean(0)
    assert [r.top_frequency for r in got] == pytest.approx(top)
    rank = lambda v: v.argsort().argsort()
    rho = [np.corrcoef(rank(corr(x[d])), rank(corr(y[d])))[0, 1] for d in draws]
    one = summary.first()
    assert (one.ci_lower, one.ci_upper) == pytest.approx(tuple(np.quantile(rho, [0.025, 0.975]))) and (one.valid, one.invalid) == (40, 0)


def test_constant_columns_are_counted_and_too_many_stop_the_job(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 3)), rng.normal(size=(40, 3))
    groups = np.arange(40) % 8
    x[groups > 1, 0] = 1.0  # only two groups vary in the first column
    _, summary = uncertainty.edge_bootstrap(table(spark, x, y, groups), "g", "v", "h", replicates=60, min_valid=0.5)
    assert summary.first().invalid > 0
    with pytest.raises(PySparkException, match="identifiable"):
        uncertainty.edge_bootstrap(table(spark, x, y, groups), "g", "v", "h", replicates=60, min_valid=0.999)[1].collect()
    with pytest.raises(ValueError, match="two groups"):
        uncertainty.edge_bootstrap(table(spark, x, y, groups * 0), "g", "v", "h", replicates=5)


def test_columns_are_permuted_on_their_own(spark, monkeypatch):
    monkeypatch.setattr(uncertainty, "BUCKET_BYTES", 8 * 5 * 9)  # nine rows a bucket
    x = np.random.default_rng(3).normal(size=(100, 5))
    df = table(spark, x, x, np.zeros(100))
    out = uncertainty.column_null(df, "id", "v").collect()
    moved = np.array([r.v for r in out])
    assert sorted(r.id for r in out) == sorted(f"s{i}" for i in range(100))
    assert np.allclose(np.sort(moved, 0), np.sort(x, 0))
    assert (np.abs(np.corrcoef(moved, rowvar=False) - np.corrcoef(x, rowvar=False)).max() > 0.01)
    again = {r.id: r.v for r in uncertainty.column_null(df.repartition(5), "id", "v").collect()}
    assert again == {r.id: r.v for r in out}
    check = uncertainty.common_row_check(df, "id", "v").first()
    assert check.ok and check.edges == 10


def test_every_column_map_is_a_permutation():
    for n in (1, 2, 6, 97, 1000, 30030):
        factors, shifts = uncertainty.column_maps(12, n)
        for f, s in zip(factors.tolist(), shifts.tolist()):
            assert len({(f * p + s) % n for p in range(n)}) == n
