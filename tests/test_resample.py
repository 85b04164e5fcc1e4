from conceptframe.operators import resample


def test_replicates_are_those_of_the_reference(spark):
    rows = spark.createDataFrame([(i % 7, float(i)) for i in range(40)], "g int, v double")
    one = resample.group_bootstrap_mean(rows, "g", "v").first()
    assert one.valid + one.invalid == 1000
