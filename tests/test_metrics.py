"""Closed forms and refusals of the metrics."""

import pytest
from pyspark.errors import PySparkException

from conceptframe.operators import metrics


def cells(spark, rows, kind="sample_id string, anchor_id string, score double, label int, position int"):
    return spark.createDataFrame(rows, kind)


def test_ties_share_one_threshold(spark):
    rows = cells(spark, [("a", "x", 0.8, 1, 0), ("b", "x", 0.8, 0, 1), ("c", "x", 0.1, 1, 2)])
    assert abs(metrics.average_precision(rows, ["anchor_id"]).first().ap - 7 / 12) < 1e-12


def test_columns_without_positives_are_left_out_and_named(spark):
    rows = cells(spark, [("a", "x", 0.8, 1, 0), ("b", "x", 0.2, 0, 1), ("a", "y", 0.8, 0, 0), ("b", "y", 0.2, 0, 1)])
    one = metrics.evaluate_multilabel(rows).first()
    assert one.macro_ap == 1.0 and one.excluded == ["y"] and one.anchors == 1


def test_candidates(spark):
    rows = cells(spark, [("a", "x", 0.5, 0, 0), ("a", "y", 0.5, 1, 1), ("b", "x", 0.1, 1, 0), ("b", "y", 0.2, 1, 1), ("c", "x", 0.3, 0, 0)])
    out = {r.sample_id: r for r in metrics.evaluate_candidates(rows).collect()}
    assert (out["a"].ap, out["a"].rr) == (0.5, 0.5)
    assert out["b"].excluded == "no_contrast" and out["b"].ap is None and out["c"].excluded == "no_relevant"
    free = {r.sample_id: r for r in metrics.evaluate_candidates(rows, require_contrast=False).collect()}
    assert free["b"].ap == 1.0


def test_success_is_not_recall(spark):
    rows = cells(spark, [("q", "a", 0.9, 1, 0), ("q", "b", 0.8, 0, 1), ("q", "c", 0.7, 1, 2), ("z", "a", 0.9, 0, 0)])
    out = metrics.retrieval_metrics(rows, "sample_id", "position", (1, 3)).collect()
    assert len(out) == 1 and (out[0].success_1, out[0].recall_1, out[0].recall_3) == (1, 0.5, 1.0)


def test_spearman_with_ties_and_constant_sides(spark):
    rows = spark.createDataFrame([("k", 1.0, 1.0), ("k", 2.0, 1.0), ("k", 2.0, 3.0), ("c", 1.0, 5.0), ("c", 1.0, 6.0), ("k", None, 2.0)], "k string, a double, b double")
    out = {r.k: r for r in metrics.spearman(rows, ["k"], "a", "b").collect()}
    assert abs(out["k"].spearman - 0.5) < 1e-12 and out["k"].n == 3 and out["c"].spearman is None


@pytest.mark.parametrize("labels", [[("a", "x", 1)], [("a", "x", 1), ("b", "x", 0), ("c", "x", 0)], [("a", "x", 1), ("a", "x", 1), ("b", "x", 0)]])
def test_one_sided_or_repeated_keys_stop_the_job(spark, labels):
    p = spark.createDataFrame([("a", "x", 0.5), ("b", "x", 0.1)], "sample_id string, anchor_id string, score double")
    g = spark.createDataFrame(labels, "sample_id string, anchor_id string, label int")
    with pytest.raises(PySparkException):
        metrics.align(p, g, ["sample_id", "anchor_id"]).collect()


@pytest.mark.parametrize("score,label", [(float("nan"), 1), (None, 1), (0.5, 2), (0.5, None)])
def test_bad_values_stop_the_job(spark, score, label):
    with pytest.raises(PySparkException):
        metrics.average_precision(cells(spark, [("a", "x", score, label, 0), ("b", "x", 0.2, 1, 1)]), ["anchor_id"]).collect()


def test_alpha(spark):
    rows = spark.createDataFrame([("k", i, s, float(v)) for i in (0, 1) for s, v in enumerate((1, 2, 3))] + [("z", i, s, 1.0) for i in (0, 1) for s in (0, 1)],
                                 "k string, item int, sample_id int, value double")
    out = {r.k: r for r in metrics.cronbach_alpha(rows, ["k"], "item", "sample_id").collect()}
    assert abs(out["k"].alpha - 1.0) < 1e-12 and out["z"].status == "zero_variance" and out["z"].alpha is None


def test_false_discovery(spark):
    rows = spark.createDataFrame([("f", 1, 0.01), ("f", 2, 0.04), ("f", 3, 0.03), ("f", 4, None), ("f", 5, float("nan"))], "f string, i int, p double")
    q = {r.i: r.q for r in metrics.bh_fdr(rows, ["f"]).collect()}
    assert abs(q[1] - 0.03) < 1e-12 and abs(q[2] - 0.04) < 1e-12 and abs(q[3] - 0.04) < 1e-12 and q[4] is None and q[5] is None


def test_order_and_partitions_do_not_matter(spark):
    rows = [("s%d" % i, "x", (i * 7 % 5) / 5.0, i % 3 == 0, i) for i in range(200)]
    rows = [(a, b, c, int(d), e) for a, b, c, d, e in rows]
    one = metrics.average_precision(cells(spark, rows).coalesce(1), ["anchor_id"]).first().ap
    other = metrics.average_precision(cells(spark, rows[::-1]).repartition(7), ["anchor_id"]).first().ap
    assert abs(one - other) < 1e-12
