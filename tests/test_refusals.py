"""Rules that stop a job, and cases that must not."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conceptframe.operators import calibrate, grid, prepare
from conceptframe.schema import Refused

STUDY = grid.Instrument((grid.Anchor("a", "x"),), (grid.Bridge("b", "p "), grid.Bridge("c", "q ")))


def stops(df):
    with pytest.raises((PySparkException, Refused)):
        df.collect()


def test_identity_holds_budgets_and_texts_with_markers_are_scored(spark):
    small = grid.Instrument(STUDY.anchors, STUDY.bridges, budgets=grid.Budgets(text_tokens=5))
    assert small.measurement_id != STUDY.measurement_id
    with pytest.raises(Refused):
        grid.Instrument((grid.Anchor("a", "x <think>"),), STUDY.bridges)


def test_ratings_round_half_to_even(spark):
    rows = spark.createDataFrame([("i", v) for v in (2, 2, 2, 2, 2, 2, 2, 3)], "k string, v int")
    assert prepare.aggregate_ratings(rows, "k", ["v"]).first().v == 2.12


def test_short_samples(spark):
    s = spark.createDataFrame([("a", "g", "train"), ("b", "h", "dev")], "sample_id string, group_id string, split string")
    stops(prepare.quota_sample(s, 2))
    stops(prepare.round_robin(s, ["split"], 3))
    assert prepare.round_robin(s, ["split"], 2).count() == 2
    stops(prepare.rank_terms(spark.createDataFrame([("p", "t")], "pair string, term string"), "pair", "term", 2))


def test_pairs_with_an_unknown_end(spark):
    s = spark.createDataFrame([("a", "train")], "sample_id string, split string")
    stops(prepare.pairs_crossing_splits(spark.createDataFrame([("a", "z")], "left string, right string"), s))


def test_official_splits(spark):
    s = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    named = lambda rows: spark.createDataFrame(rows, "sample_id string, official_split string")
    assert {r.split for r in prepare.map_official_splits(s, named([("a", "Training"), ("b", "valid")]), "sample_id").collect()} == {"train", "dev"}
    for rows in ([("a", "train")], [("a", "train"), ("b", "external")], [("a", "train"), ("a", "train"), ("b", "test")], [("a", "train"), ("b", "test"), ("c", "test")]):
        stops(prepare.map_official_splits(s, named(rows), "sample_id"))


def test_candidates_twice_and_answers_that_are_no_option(spark):
    twice = spark.createDataFrame([("s", "x", 0), ("s", "x", 1)], "sample_id string, surface string, relevant int")
    stops(prepare.blind_candidates(twice))
    stops(prepare.explode_options(spark.createDataFrame([("s", ["A. x", "B. y"], "C")], "sample_id string, o array<string>, a string"), "o", "a"))


def test_names_paths_and_spans(spark):
    listing = spark.createDataFrame([("a ",), ("b",)], "file string")
    stops(prepare.repair_filenames(spark.createDataFrame([("a",)], "name string"), listing))
    assert prepare.repair_filenames(spark.createDataFrame([("b  ",)], "name string"), listing).first().matched == "b"
    paths = spark.createDataFrame([("a/../b",), ("../b",), ("/b",), ("a/../../b",), ("",)], "p string")
    assert [r.ok for r in paths.select(prepare.is_safe_relative_path(F.col("p")).alias("ok")).collect()] == [True, False, False, False, False]
    spans = spark.createDataFrame([("1:99999999999",), ("1:3",), ("3:1",)], "s string").select(prepare.char_span(F.col("s")).alias("x")).collect()
    assert [r.x is None for r in spans] == [True, False, True]
    word = spark.createDataFrame([("a b",)], "t string").select(prepare.token_span(F.col("t"), F.lit(1)).alias("x")).first().x
    assert (word.start, word.end) == (2, 3)


def test_faults_with_nulls_are_found(spark):
    part = "type string, text string, path string, clip_start double, clip_end double"
    df = spark.createDataFrame([([("video", None, "", None, -1.0)], (0, 0, 1, "x"))], f"parts array<struct<{part.replace(' string', ':string').replace(' double', ':double')}>>, target struct<part_index:int,start:int,end:int,lemma:string>")
    reasons = prepare.with_reasons(df, prepare.sample_faults()).first().reasons
    assert {"media_part", "clip_bounds"} <= set(reasons)


def scores(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, anchor_id string, bridge_id string, raw_logp double, status string, split string")


def full(split="train"):
    return [(s, "a", b, -1.0 - i - j, "ok", split) for i, s in enumerate("uvw") for j, b in enumerate("bc")]


def test_reference_guards(spark):
    out = calibrate.fit_reference(scores(spark, full())).collect()
    assert len(out) == 2 and all(r.reference_n == 3 and r.z_status == "ok" for r in out)
    stops(calibrate.fit_reference(scores(spark, full("test"))))
    stops(calibrate.fit_reference(scores(spark, full()[:-1] + [("w", "a", "c", None, "BudgetExceeded", "train")])))
    tiny = calibrate.fit_reference(scores(spark, [("u", "a", "b", -10000.0, "ok", "train"), ("v", "a", "b", -10001.0, "ok", "train")])).first()
    assert abs(tiny.log_mean_probability - (-10000 + 0.6201145069582775 - 1)) < 1e-6 or abs(tiny.log_mean_probability + 10000.379885493) < 1e-6


def test_transform_refuses_missing_and_repeated_coordinates(spark):
    s = scores(spark, full())
    ref = calibrate.fit_reference(s)
    assert calibrate.transform(s, ref).filter("reference_z is null").count() == 0
    stops(calibrate.transform(s, ref.filter("bridge_id = 'b'")))
    stops(calibrate.transform(s, ref.unionByName(ref)))


def test_missing_policies(spark):
    s = scores(spark, full()[:-1])
    ids = spark.createDataFrame([("u",), ("v",), ("w",)], "sample_id string")
    with pytest.raises((PySparkException, Refused)):
        calibrate.complete_grid(s, ids, STUDY).collect()
    assert calibrate.complete_grid(s, ids, STUDY, missing="drop_samples").select("sample_id").distinct().count() == 2
    with pytest.raises((PySparkException, Refused)):
        calibrate.complete_grid(s, ids, STUDY, missing="drop_anchors")
    stray = s.withColumn("anchor_id", F.lit("other"))
    with pytest.raises((PySparkException, Refused)):
        calibrate.complete_grid(stray, ids, STUDY, missing="drop_samples").collect()


def test_fixed_shards_keep_large_ids_apart(spark):
    df = spark.range(10).select((F.col("id") + (1 << 53)).alias("id"))
    out = prepare.shard_manifest(prepare.fixed_shards(df, "id", 4), "id").orderBy("shard").collect()
    assert [r.n for r in out] == [4, 4, 2] and out[0].first_id == 1 << 53
