"""Target bootstraps, endpoint counts, feature tables and two-stage ranking: closed forms and refusals."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from conceptframe.operators import features, targets
from conceptframe.operators.resample import group_weights, numbered_groups


def test_draws_of_targets_equal_recomputed_correlations(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=15), 1)
    y = x + rng.normal(size=15)
    df = spark.createDataFrame([(f"t{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "t string, x double, y double")
    number = {r.t: r._number for r in numbered_groups(df.select("t"), "t").collect()}
    weights = np.zeros((30, 15), int)
    for r in group_weights(spark, 15, 30).collect():
        weights[r.replicate, r._number] = r.weight
    order = [number[f"t{i}"] for i in range(15)]
    ranks = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    for statistic, change in (("pearson", lambda v: v), ("spearman", ranks)):
        want = [np.corrcoef(change(np.repeat(x, w[order])), change(np.repeat(y, w[order])))[0, 1] for w in weights]
        got = {r.replicate: r.v for r in targets.correlation_draws(df, "t", "x", "y", statistic, replicates=30).collect()}
        assert [got[r] for r in range(30)] == pytest.approx(want) and got[-1] == pytest.approx(np.corrcoef(change(x), change(y))[0, 1])
    same = targets.target_difference(df, "t", "x", "x", "y", replicates=10).first()
    assert (same.estimate, same.lower, same.upper) == (0, 0, 0)
    assert targets.target_bootstrap(df.selectExpr("t", "1.0 AS x", "y"), "t", "x", "y", replicates=10).first().status == "undefined"
    with pytest.raises(PySparkException, match="two rows"):
        targets.correlation_draws(df.union(df.limit(1)), "t", "x", "y", replicates=5).collect()
    with pytest.raises(ValueError, match="two"):
        targets.correlation_draws(df.limit(1), "t", "x", "y")


def test_ends_are_drawn_together(spark):
    units = spark.createDataFrame([("a", 0), ("b", 0), ("a", 0), ("c", 1), ("d", 1)], "u string, p int")
    edges = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "c"), ("c", "a")], "x string, y string")
    got = {(r.x, r.y): r.together for r in targets.endpoint_counts(units, edges, "u", "p", "x", "y", replicates=100).collect()}
    has = {}
    for n, names in enumerate((("a", "b"), ("c", "d"))):
        number = {r._u: r._number for r in numbered_groups(spark.createDataFrame([(u,) for u in names], "_u string"), "_u").collect()}
        drawn = {(r.replicate, r._number) for r in group_weights(spark, 2, 100, 42 + n).collect()}
        has |= {u: {r for r in range(100) if (r, number[u]) in drawn} for u in names}
    assert got == {(x, y): len(has[x] & has[y]) for x, y in got} and 0 < got["a", "b"] < got["a", "a"] < 100
    for bad in ([("a", 0), ("a", 1), ("b", 0), ("c", 1)], [("a", 0), ("b", 0)], [("a", 0), ("b", 0), ("c", 1)]):
        with pytest.raises((PySparkException, ValueError)):
            targets.endpoint_counts(spark.createDataFrame(bad, "u string, p int"), edges, "u", "p", "x", "y", replicates=5).collect()
    with pytest.raises(PySparkException, match="not among"):
        targets.endpoint_counts(units, spark.createDataFrame([("a", "z")], "x string, y string"), "u", "p", "x", "y", replicates=5).collect()


def test_features_are_whole_or_refused(spark):
    kind = "method string, sample_id string, column_id string, value double"
    cells = [("m", s, c, float(i)) for s in ("s1", "s2") for i, c in enumerate("ab")]
    samples = spark.createDataFrame([("s1",), ("s2",)], "sample_id string")
    run = lambda parts, want={"m": ["b", "a"]}: features.assemble_features([spark.createDataFrame(p, kind) for p in parts], samples, want, ["m"]).collect()  # noqa: B006, E731
    assert [(r.features, r.direct) for r in run([cells[:3], cells[3:]])] == [([1.0, 0.0], True)] * 2
    for parts, want in (([cells[:3]], None), ([cells, cells[:1]], None), ([cells + [("m", "s3", "a", 1.0)]], None), ([cells + [("n", "s1", "a", 1.0)]], None), ([cells + [("m", "s1", "z", 1.0)]], None),
                        ([cells[:3] + [("m", "s2", "b", float("nan"))]], None), ([cells[:3] + [("m", "s2", "c", 1.0)]], None), ([cells], {"m": ["b", "a"], "n": ["a"]})):
        with pytest.raises(PySparkException, match="Feature shards"):
            run(parts, want or {"m": ["b", "a"]})


def test_two_stages(spark, monkeypatch):
    monkeypatch.setattr(features, "HELD_MOST", 1)
    rng = np.random.default_rng(2)
    rows = [(q, c, float(rng.choice([-0.5, 0.1, 0.1, 0.9]))) for q in range(5) for c in range(40)]
    first = spark.createDataFrame(rows, "query int, candidate int, score double").repartition(4)
    want = {(q, c) for q in range(5) for _, c in sorted((-s, c) for p, c, s in rows if p == q)[:3]}
    assert {(r.query, r.candidate) for r in features.best_of_each(first, "query", "candidate", "score", 3).collect()} == want
    judged = spark.createDataFrame([(q, c, 0.25) for q, c in want], "query int, candidate int, probability double")
    out = features.two_stage_priority(first, judged, 3).collect()
    assert len(out) == 200 and all((r.priority == 2.25 and r.selected) if (r.query, r.candidate) in want else (r.priority == r.score and r.probability is None) for r in out)
    for bad in (judged.limit(14), judged.selectExpr("query", "candidate", "1.5 AS probability"), judged.union(spark.createDataFrame([(0, 99, 0.5)], judged.schema))):
        with pytest.raises(PySparkException, match="do not fit"):
            features.two_stage_priority(first, bad, 3).collect()
    with pytest.raises(PySparkException, match="cosines"):
        features.two_stage_priority(first.selectExpr("query", "candidate", "score * 2 AS score"), judged, 3).collect()
