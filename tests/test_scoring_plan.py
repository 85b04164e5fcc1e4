from conceptframe.operators import scorers
from conceptframe.sources import tables as T

FOLDER = "/root/testdata/sf0.001"


def test_tokens_are_filtered_once_not_once_for_every_term(spark):
    model = T.language_model(spark, FOLDER)
    plan = scorers.query_likelihood(T.samples(spark, FOLDER), T.STUDY, model)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(_tokens") == 1
    assert "filter(filter(" not in plan


def test_counts_of_materials_with_and_without_hits(spark):
    rows = spark.createDataFrame([("a", "that that with"), ("b", "nothing here"), ("c", ""), ("d", None)], "sample_id string, text string")
    model = scorers.fit_language_model(rows, T.STUDY)
    got = {(r.sample_id, r.anchor_id, r.bridge_id): r for r in scorers.query_likelihood(rows, T.STUDY, model).collect()}
    assert got["a", "a_that", "b_mention"].raw_logp > got["b", "a_that", "b_mention"].raw_logp
    assert got["c", "a_that", "b_mention"].status == "ok" and got["d", "a_that", "b_mention"].raw_logp is None
