"""What the third round found: shared paths, rounds that end early, passes and rows that were too many."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conceptframe.operators import geometry, metrics, neighbours, selection, shards, uncertainty


def test_files_that_share_a_path_are_told_apart_by_their_key(spark):
    recorded = spark.createDataFrame([(1, "p", "a"), (2, "p", "b"), (3, None, "c"), (4, "q", None)], "id int, path string, digest string")
    actual = spark.createDataFrame([(1, "a"), (2, "x"), (4, None)], "id int, digest string")
    got = {tuple(r) for r in shards.digest_audit(recorded, actual, key="id").collect()}
    assert got == {("p", "b", "x"), (None, "c", None)}


def test_centres_after_a_number_of_rounds(spark):
    x = np.random.default_rng(3).normal(size=(200, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    _, first, _ = geometry.kmeans(df, "id", "v", 5, 1, starts=1, settled=False)
    _, second, inertia = geometry.kmeans(df, "id", "v", 5, 2, starts=1, settled=False)
    near = ((x[:, None] - first[None]) ** 2).sum(2).argmin(1)
    assert second == pytest.approx(np.array([x[near == c].mean(0) for c in range(5)]))
    assert inertia == pytest.approx(((x[:, None] - second[None]) ** 2).sum(2).min(1).sum())


def counted(spark, df, column):
    """The table with a column that counts how often it is worked out."""
    seen = spark.sparkContext.accumulator(0)

    def look(v):
        seen.add(1)
        return v

    return df.withColumn(column, F.udf(look, df.schema[column].dataType).asNondeterministic()(column)), seen


def test_votes_of_different_pairs_do_not_travel_by_material(spark):
    for name in ("rank_terms", "instrument_variants"):
        plan = preparation_query(name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(sample_id" not in plan and "hashpartitioning(term" in plan


def preparation_query(name):
    import __spark_entry__ as entry
    return entry.queries()[name]


def test_rank_agreement_goes_through_the_rows_once(spark):
    df = spark.createDataFrame([("k", float(i % 7), float(i % 5)) for i in range(60)], "k string, a double, b double")
    rows, seen = counted(spark, df, "a")
    assert metrics.spearman(rows, ["k"], "a", "b").first().n == 60 and seen.value == 60


def test_vectors_travel_in_single_precision_where_that_loses_nothing():
    x = np.arange(12.0).reshape(4, 3)
    assert len(neighbours._packed(x)) == 48 and len(neighbours._packed(x + 1e-12)) == 96 and len(neighbours._packed(x + 1e300)) == 96
    for y in (x, x + 1e-12, x + 1e300):
        assert (neighbours._unpacked(neighbours._packed(y), 4, 3) == y).all()


def test_shuffled_columns_in_small_buckets(spark, monkeypatch):
    assert uncertainty.BUCKET_BYTES <= 4 << 20
    df = spark.createDataFrame([(f"s{i}", [float(i), float(-i)]) for i in range(50)], "id string, v array<double>")
    whole = sorted(map(tuple, uncertainty.column_null(df, "id", "v").collect()))
    monkeypatch.setattr(uncertainty, "BUCKET_BYTES", 16 * 7)
    assert sorted(map(tuple, uncertainty.column_null(df, "id", "v").collect())) == whole
    assert sorted(v[0] for _, v in whole) == [float(i) for i in range(50)]


def test_shards_are_gone_through_once(spark):
    def part(samples, measurement="m", bridges=("x", "y")):
        return spark.createDataFrame([(s, "a", b, measurement) for s in samples for b in bridges], "sample_id string, anchor_id string, bridge_id string, measurement_id string")

    expected = spark.createDataFrame([("p",), ("q",), ("r",)], "sample_id string")
    one, seen = counted(spark, part(["p", "q"]), "bridge_id")
    assert shards.merge_shards([part(["r"]), one], expected, 2).count() == 6 and seen.value == 4
    for bad in ([part(["p", "q"])], [part(["p", "q"]), part(["q", "r"])], [part(["p", "q"]), part(["r", "z"])], [part(["p", "q"]), part(["r"], bridges=("x",))],
                [part(["p", "q"]), part(["r"], bridges=("x", "x"))], [part(["p", "q"]), part(["r"], "n")]):
        with pytest.raises(PySparkException, match="missing|different"):
            shards.merge_shards(bad, expected, 2).collect()


def test_tied_scores_are_worked_out_once(spark):
    df = spark.createDataFrame([("k", i % 2, float(i % 7)) for i in range(60)], "k string, label int, score double")
    rows, seen = counted(spark, df, "score")
    assert metrics.average_precision(rows, ["k"]).first().rows == 60 and seen.value == 60


def test_objectives_are_compared_on_the_same_measures(spark, monkeypatch):
    from test_selection import RIGHT, labels_of, scores_of, wordings
    pool = wordings(4)
    scores = scores_of(spark, {b.id: RIGHT * (1 + n) + n * (-1) ** n for n, b in enumerate(pool)})
    searches = [selection.Search(mode, rounds=0) for mode in selection.MODES]
    alone = [selection.select_bridge_subset(scores, labels_of(spark), [pool], s) for s in searches]
    calls, own = [], selection.subset_measures
    monkeypatch.setattr(selection, "subset_measures", lambda *a, **k: calls.append(1) or own(*a, **k))
    together = selection.select_bridge_subsets(scores, labels_of(spark), [pool], searches)
    assert together == alone and len(calls) == 1


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_draws_of_targets_are_ranked_without_a_row_a_draw(spark, monkeypatch, block):
    from conceptframe.operators import drawranks, targets
    from conceptframe.operators.resample import group_weights, numbered_groups
    rng = np.random.default_rng(block)
    x, y = np.round(rng.normal(size=23)), np.where(np.arange(23) < 15, 1.0, rng.normal(size=23))  # values that go on over several blocks
    x[:2] = np.nan
    tables, own = [], drawranks.written
    for module in (targets, drawranks):
        monkeypatch.setattr(module, "written", lambda df, name: tables.append(own(df, name)) or tables[-1])
    monkeypatch.setattr(drawranks, "BLOCK", block)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "t int, x double, y double")
    got = {r.replicate: r.v for r in targets.correlation_draws(df, "t", "x", "y", "spearman", replicates=40).collect()}
    assert max(t.count() for t in tables) <= 2 * len(x)  # before: a row for each target of each draw
    number = {r.t: r._number for r in numbered_groups(df.select("t"), "t").collect()}
    weights = np.zeros((41, len(x)), int)
    weights[-1] = 1
    for r in group_weights(spark, len(x), 40).collect():
        weights[r.replicate, r._number] = r.weight
    weights = weights[:, [number[i] for i in range(len(x))]]
    ranks = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    want = [np.corrcoef(ranks(np.repeat(np.nan_to_num(x, nan=9.0), w)), ranks(np.repeat(y, w)))[0, 1] for w in weights]
    assert sorted(got) == [-1, *range(40)] and [got[r] for r in [*range(40), -1]] == pytest.approx(want)


def test_cached_cells_travel_by_material(spark):
    from conceptframe.operators import grid, scorers
    plan = preparation_query("cache_split")(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "content_key" not in plan  # before: a digest for each cell in several shuffles
    study = grid.Instrument((grid.Anchor("p", "this"), grid.Anchor("q", "with this")), (grid.Bridge("x", "About:"), grid.Bridge("y", "With:")))
    model = scorers.LanguageModel(100, 50, {"this": 7, "with": 3})
    docs = spark.createDataFrame([("1", "this one", "A"), ("2", "this one", "A"), ("3", "with what", "B"), ("4", "with what", "B"), ("5", None, None), ("6", "more", "C")], "sample_id string, text string, content string")
    asked = []

    def score(one):
        asked.extend(r.sample_id for r in one.collect())
        return scorers.query_likelihood(docs, study, model, keep=("content",), only=one)

    whole = scorers.query_likelihood(docs, study, model, keep=("content",))
    # all cells of A, one of B; what is stored differs from what would be scored
    cache = whole.filter("content = 'A' or sample_id = '3' and anchor_id = 'q' and bridge_id = 'y'").withColumn("raw_logp", F.col("raw_logp") - 1)
    got = {(r.sample_id, r.anchor_id, r.bridge_id): (r.raw_logp, r.token_count, r.status, r.cache_hit) for r in grid.replayed(docs.drop("text"), cache, study, score).collect()}
    assert sorted(asked) == ["3", "5", "6"] and len(got) == 24
    for r in whole.collect():
        hit = r.content == "A" or (r.content == "B" and (r.anchor_id, r.bridge_id) == ("q", "y"))
        assert got[r.sample_id, r.anchor_id, r.bridge_id] == (r.raw_logp - 1 if hit else r.raw_logp, r.token_count, r.status, hit)
