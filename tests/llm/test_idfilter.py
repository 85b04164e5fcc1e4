from pyspark.sql import functions as F

from conceptframe.llm.idfilter import possible, without
from conceptframe.llm.shared import kept


def tables(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 50 != 49, F.col("id")).alias("k"), F.lit("x").alias("_maybe"))
    ids = spark.range(0, 3000, 7).select(F.col("id").alias("k"))
    return rows, kept(ids, "ids")


def test_every_id_is_possible_and_few_others(spark):
    rows, ids = tables(spark)
    can = possible(ids, "k")
    own = {r.k for r in ids.collect()}
    through = [r.k for r in rows.filter(can(F.col("k"))).collect()]
    assert {r for r in range(2000) if r in own and r % 50 != 49} <= set(through)
    assert len([r for r in through if r not in own]) < 60
    assert possible(kept(spark.createDataFrame([(None,)], "k bigint"), "null_id"), "k") is not None


def test_without_is_an_anti_join_beyond_the_filter_too(spark):
    rows, ids = tables(spark)
    expected = sorted(map(str, rows.join(ids, "k", "left_anti").select("k", "_maybe").collect()))
    for most in (1 << 20, 1):
        out = without(rows, "k", ids, most)
        assert out.columns == rows.columns
        assert sorted(map(str, out.collect())) == expected
    none = kept(spark.createDataFrame([], "k bigint"), "none")
    assert without(rows, "k", none).count() == 2000
    assert without(rows.limit(0), "k", ids).count() == 0


def test_null_is_an_id(spark):
    ids = kept(spark.createDataFrame([(None,), (3,)], "k bigint"), "ids")
    can = possible(ids, "k")
    rows = spark.createDataFrame([(None,), (3,)], "k bigint")
    assert rows.filter(can(F.col("k"))).count() == 2
