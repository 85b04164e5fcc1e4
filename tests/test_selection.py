"""Choice of wordings: objectives, modes, rules, budgets and refusals."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conceptframe.operators import selection
from conceptframe.operators.grid import Bridge
from conceptframe.operators.selection import Search
from conceptframe.schema import Refused

LABELS = np.column_stack([np.arange(12) < 6, np.arange(12) % 2 == 0]).astype(int)
RIGHT = LABELS + np.arange(12)[:, None] * 0.001


def wordings(n=3):
    return [Bridge(f"seed{i}", f"Content associated with concept variant {i}:\n") for i in range(n)]


def labels_of(spark, labels=LABELS):
    return spark.createDataFrame([(f"s{i}", f"a{j}", int(labels[i, j])) for i in range(labels.shape[0]) for j in range(labels.shape[1])], "sample_id string, anchor_id string, label int")


def scores_of(spark, by_bridge):
    rows = [(f"s{i}", f"a{j}", b, float(x[i, j])) for b, x in by_bridge.items() for i in range(x.shape[0]) for j in range(x.shape[1])]
    return spark.createDataFrame(rows, "sample_id string, anchor_id string, bridge_id string, value double")


def chosen(spark, by_bridge, generations, search=Search(rounds=0), labels=LABELS):
    return selection.select_bridge_subset(scores_of(spark, by_bridge), labels_of(spark, labels), generations, search)


def test_alpha_looks_inside_concepts_and_random_not_at_labels(spark):
    x = np.column_stack([np.arange(12), np.arange(12) ** 2]).astype(float)
    pool = wordings(4)
    scores = {b.id: x * (100 if b.id == "seed3" else 1) for b in pool}
    one = chosen(spark, scores, [pool], Search("alpha", rounds=0))
    assert one.bridges == ["seed0", "seed1", "seed2"] and one.measures["alpha"] == pytest.approx(1)
    a, b = (chosen(spark, scores, [pool], Search("random", rounds=0), lab) for lab in (LABELS, 1 - LABELS))
    assert a.bridges == b.bridges and a.measures["objective"] == 0


def test_wrong_scores_agree_but_are_not_valid(spark):
    one = chosen(spark, {b.id: 1 - RIGHT for b in wordings()}, [wordings()])
    assert one.measures["reliability"] == pytest.approx(1) and one.measures["validity"] < 0.5 and one.measures["objective"] < 0.6
    pool = wordings(4)
    two = chosen(spark, {b.id: RIGHT for b in pool}, [pool], Search("validity", rounds=0))
    assert two.measures["objective"] == two.measures["validity"] == pytest.approx(1)


def test_one_wording_against_the_others(spark):
    one = chosen(spark, {"seed0": RIGHT, "seed1": 1 - RIGHT, "seed2": RIGHT}, [wordings()])
    assert one.measures["reliability"] == pytest.approx(1 / 3) and one.measures["validity"] == pytest.approx(1)


def test_constant_scores_have_no_reliability(spark):
    one = chosen(spark, {b.id: np.ones(LABELS.shape) for b in wordings()}, [wordings()])
    assert one.status == "undefined_reliability" and not one.measures and not one.trace


def test_concepts_need_both_labels(spark):
    labels = np.column_stack([LABELS[:, 0], np.ones(12), np.arange(12) == 0]).astype(int)
    scores = {b.id: labels + np.arange(12)[:, None] * 0.001 for b in wordings()}
    assert chosen(spark, scores, [wordings()], labels=labels).eligible == ["a0"]
    assert chosen(spark, scores, [wordings()], labels=np.ones_like(labels)).status == "no_eligible_anchors"
    rows = selection.eligible_anchors(labels_of(spark, labels)).orderBy("anchor_id").collect()
    assert [(r.positives, r.negatives, r.eligible) for r in rows] == [(6, 6, True), (12, 0, False), (1, 11, False)]


def test_later_wordings_are_named_when_left_out_and_taken_when_better(spark):
    noise = np.random.default_rng(3).normal(size=LABELS.shape)
    better = [Bridge(f"child{i}", f"Content associated with proposal {i}:\n") for i in range(4)]
    bad = [Bridge("alias", wordings()[0].prefix), Bridge("seed1", "Another prefix:\n"), Bridge("nan", "Content with nothing:\n"), Bridge("cut", "No end of line")]
    scores = {b.id: noise + i * 0.01 * RIGHT for i, b in enumerate(wordings())} | {b.id: RIGHT + 0.001 * i * noise for i, b in enumerate(better)} | {"nan": np.full(LABELS.shape, np.nan)}
    one = chosen(spark, scores, [wordings(), better[:3] + [better[3]], bad], Search(rounds=2))
    assert one.status == "ok" and len(one.bridges) == 3 and all(b.startswith("child") for b in one.bridges)
    assert {r["bridge_id"]: r["rejected"] for r in one.trace if "rejected" in r} == {"alias": "duplicate", "seed1": "duplicate", "nan": "invalid_scores", "cut": "invalid_delimiter_or_length"}


@pytest.mark.parametrize("prefix,relation,language,reason", [
    ("Different relation:\n", "supports", "en", "relation_or_language_changed"), ("关联概念：\n", "associated_with", "zh", "relation_or_language_changed"),
    ("Content associated with [MASK]:\n", "associated_with", "en", "control_token"), ("Content associated with <|assistant|>:\n", "associated_with", "en", "control_token"),
    ("Content associated with \x01:\n", "associated_with", "en", "control_token"), ("Content associated with FAIRNESS:\n", "associated_with", "en", "answer_surface_inserted"),
    ("Content supports a concept:\n", "associated_with", "en", "protected_relation_changed"), ("Content associated with a concept:", "associated_with", "en", "invalid_delimiter_or_length"),
    ("x" * 512 + "\n", "associated_with", "en", "invalid_delimiter_or_length"), ("Content associated with unfairness:\n", "associated_with", "en", None),
    ("Content associated with 公平性:\n", "associated_with", "en", "answer_surface_inserted"), ("Content associated with (a+b):\n", "associated_with", "en", "answer_surface_inserted")])
def test_rules_of_wordings(spark, prefix, relation, language, reason):
    row = spark.createDataFrame([(prefix, relation, language)], "prefix string, relation string, language string")
    assert row.select(selection.rejection("associated_with", "en", "associated with", ("fairness", "公平", "a+b", "")).alias("why")).first().why == reason


def test_words_and_their_distance(spark):
    df = spark.createDataFrame([(1, "The idea, the Idea!", "en"), (1, "an idea", "en"), (2, "概念", "zh"), (2, "概观", "zh"), (3, "alone", "en")], "k int, prefix string, language string")
    out = {r.k: r.lexical_diversity for r in selection.lexical_diversity(df, ["k"]).collect()}
    assert out[1] == pytest.approx(2 / 3) and out[2] == pytest.approx(2 / 3) and out[3] is None


@pytest.mark.parametrize("change", [{"most": 17}, {"most": 0}, {"most": 2}, {"most": 16.5}, {"subset_size": 1}, {"subset_size": 17}, {"rounds": -1}, {"rounds": 1.5}, {"offspring": -1},
                                    {"offspring": True}, {"min_positive": 0}, {"min_negative": 0}, {"validity_weight": -0.1}, {"validity_weight": float("nan")}, {"objective": "best"}])
def test_budgets_are_checked_first(change):
    with pytest.raises(Refused):
        Search(**change)


def test_refusals(spark):
    scores, labels = scores_of(spark, {b.id: RIGHT for b in wordings()}), labels_of(spark)
    run = lambda s=scores, la=labels, g=None, search=Search(rounds=0), **more: selection.select_bridge_subset(s, la, g or [wordings()], search, **more)
    with pytest.raises(Refused, match="budget"):
        run(g=[wordings(4)], search=Search(most=3))
    with pytest.raises(Refused, match="own"):
        run(g=[[*wordings(2), wordings(1)[0]]])
    with pytest.raises(Refused, match="control_token"):
        run(g=[[*wordings(2), Bridge("x", "a <think>:\n")]])
    for split in ("test", "dev"):
        with pytest.raises(Refused, match="training"):
            run(la=labels.withColumn("split", F.lit(split)))
    g = spark.createDataFrame([("source",)], "group_id string")
    with pytest.raises(Refused, match="overlap"):
        run(groups=g, reference_groups=g)
    for s, la in ((scores.union(scores.limit(1)), labels), (scores, labels.filter("anchor_id = 'a0' or sample_id <> 's3'")), (scores, labels.withColumn("label", F.lit(2)))):
        with pytest.raises(PySparkException):
            run(s, la)
