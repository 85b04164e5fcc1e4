"""Shift between periods: closed forms, recomputed distances, designs and refusals."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conceptframe.operators import shift

KIND = "target string, period string, unit string, genre string, v array<double>"


def table(spark, rows):
    return spark.createDataFrame([(t, p, u, g, [float(x) for x in v]) for t, p, u, g, v in rows], KIND).repartition(3)


def energy(a, b):
    far = lambda x, y: np.sqrt(((x[:, None] - y[None]) ** 2).sum(2)).mean()
    return 2 * far(a, b) - far(a, a) - far(b, b)


def test_equal_means_are_not_equal_distributions(spark):
    df = table(spark, [("w", "old", "1", "", [-1]), ("w", "old", "2", "", [1])] + [("w", "new", str(k), "", [0]) for k in range(3, 6)])
    assert shift.energy_distance(df, "target", F.col("period") == "new", "v").first().energy_distance == pytest.approx(1)
    one = shift.semantic_shift(df, "target", "period", "unit", "v", replicates=20, permutations=19).first()
    assert (one.centroid_distance, one.status, one.permutations_run) == (0, "ok", 19) and one.energy_distance == pytest.approx(1) and 1 / 20 <= one.p <= 1


def test_blocks_give_the_whole_sum(spark, monkeypatch):
    monkeypatch.setattr(shift, "BLOCK", 7)
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(33, 4)), rng.normal(size=(19, 4))
    df = table(spark, [("w", "0", "u", "", x) for x in a] + [("w", "1", "u", "", x) for x in b])
    assert shift.energy_distance(df, "target", F.col("period") == "1", "v").first().energy_distance == pytest.approx(energy(a, b))
    assert shift.energy_distance(df, "target", F.lit(False), "v").first().energy_distance is None


def test_replicates_equal_recomputed_distances(spark):
    rng = np.random.default_rng(1)
    rows = [("w", str(u % 2), f"s{u}", "g", rng.normal(size=3) + u % 2) for u in range(8) for _ in range(u + 1)]
    x = np.array([r[4] for r in rows])
    units = np.array([r[2] for r in rows])
    names = [f"s{u}" for u in (0, 2, 4, 6, 1, 3, 5, 7)]
    plan = shift.Plan("w", names, ["g"] * 8, np.array([(units == n).sum() for n in names]), 4, False)
    values = []
    for r in range(25):
        w = shift.bootstrap(plan, r, 42) * 1.0
        sides = [np.concatenate([np.repeat(np.flatnonzero(units == n), round(abs(v) / abs(w[w * s > 0]).min())) for n, v in zip(names, w) if v * s > 0]) for s in (1, -1)]
        values.append(energy(x[sides[0]], x[sides[1]]))
    one = shift.semantic_shift(table(spark, rows), "target", "period", "unit", "v", replicates=25, permutations=0).first()
    assert (one.energy_ci_lower, one.energy_ci_upper) == pytest.approx(tuple(np.quantile(values, [0.025, 0.975])))
    assert one.p is None and one.q is None


def test_paired_sources_move_together(spark):
    rows = [("w", p, f"s{u}", "", [10 * u + (p == "new")]) for p in ("new", "old") for u in (0, 1) for _ in range(2)]
    one = shift.semantic_shift(table(spark, rows), "target", "period", "unit", "v", replicates=50, permutations=19).first()
    assert one.design == "paired_clusters" and one.n_shared_units == 2
    assert one.centroid_ci_lower == one.centroid_ci_upper == 1 and one.permutations_run == 19
    again = shift.semantic_shift(table(spark, rows).repartition(5), "target", "period", "unit", "v", replicates=50, permutations=19).first()
    assert again == one
    with pytest.raises(PySparkException, match="both periods"):
        shift.source_shift(table(spark, rows), "target", "period", "unit", "v", "genre", replicates=5, permutations=5).collect()


def test_undefined_targets_stay(spark):
    rows = [("one", "0", "a", "", [0]), ("one", "0", "b", "", [1]), ("three", "0", "a", "", [0]), ("three", "1", "b", "", [0]), ("three", "2", "c", "", [0]),
            ("few", "0", "a", "", [-1]), ("few", "0", "a", "", [1]), ("few", "1", "b", "", [0]), ("few", "1", "b", "", [0])]
    out = {r.target: r for r in shift.semantic_shift(table(spark, rows), "target", "period", "unit", "v", replicates=9, permutations=9).collect()}
    assert out["one"].status == out["three"].status == "requires_two_periods" and out["one"].energy_distance is None
    few = out["few"]
    assert few.energy_distance == pytest.approx(1) and few.bootstrap_replicates == few.permutations_run == 0
    assert few.uncertainty_status == "undefined_insufficient_sampling_units" and few.energy_ci_lower is None and few.p is None


def test_genres_of_one_period_cannot_be_dealt_anew(spark):
    rows = [("w", str(u % 2), f"s{u}", f"g{u % 2}", [u]) for u in range(6)]
    one = shift.source_shift(table(spark, rows), "target", "period", "unit", "v", "genre", replicates=9, permutations=9).first()
    assert one.bootstrap_replicates == 9 and one.permutations_run == 0 and one.p is None and one.within_period_energy > 0


@pytest.mark.parametrize("rows", [
    [("w", "0", "a", "", [0]), ("w", "0", "s", "", [1]), ("w", "1", "s", "", [2]), ("w", "1", "b", "", [3])],
    [("w", "0", "a", "x", [0]), ("w", "0", "a", "y", [1]), ("w", "1", "b", "x", [2])],
    [("w", None, "a", "", [0]), ("w", "1", "b", "", [1])],
    [("w", "0", "a", "", [0, 1]), ("w", "1", "b", "", [1])],
    [("w", "0", "a", "", [float("nan")]), ("w", "1", "b", "", [1])],
])
def test_refusals(spark, rows):
    with pytest.raises(PySparkException):
        shift.shift(table(spark, rows), "target", "period", "unit", "v", "genre", replicates=3, permutations=3).collect()
