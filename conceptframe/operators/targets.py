"""Uncertainty over targets and over the sources behind edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptframe.functions.numeric import weighted_pearson
from conceptframe.operators.checks import refused_if
from conceptframe.operators.drawranks import rank_correlation_draws
from conceptframe.operators.resample import REPLICATES, group_weights, interval, numbered_groups
from conceptframe.session import written

STATISTICS = ("pearson", "spearman")


def correlation_draws(rows: DataFrame, target: str, x: str, y: str, statistic: str = "pearson", replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """(replicate, v): the correlation over targets drawn with replacement, and over all of them as replicate -1.

    One row a target; a target drawn twice counts twice, by its weight. Constant sides give NULL. Targets
    with a NULL on either side are left out; fewer than two stop the job.
    """
    if statistic not in STATISTICS:
        raise ValueError(f"Statistics are {STATISTICS}.")
    own = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(target).agg(
        refused_if(F.count("*") > 1, "A target has two rows", F.max(F.col(x).cast("double"))).alias("x"), F.max(F.col(y).cast("double")).alias("y"))
    numbered = written(numbered_groups(own, target), "targets")
    count, mx, my = numbered.agg(F.count("*"), F.avg("x"), F.avg("y")).first()
    if count < 2:
        raise ValueError("A bootstrap of targets needs at least two.")
    if statistic == "spearman":
        return rank_correlation_draws(numbered, count, replicates, seed)
    centred = numbered.select("_number", (F.col("x") - mx).alias("x"), (F.col("y") - my).alias("y"))
    point = centred.select(F.lit(-1).cast("bigint").alias("replicate"), F.lit(1).cast("bigint").alias("weight"), "x", "y")
    drawn = group_weights(rows.sparkSession, count, replicates, seed).join(centred, "_number").select("replicate", "weight", "x", "y").unionByName(point)
    return drawn.groupBy("replicate").agg(weighted_pearson(F.col("weight").cast("double"), F.col("x"), F.col("y")).alias("v"))


def target_bootstrap(rows: DataFrame, target: str, x: str, y: str, statistic: str = "pearson", **options) -> DataFrame:
    """estimate, lower, upper, valid, invalid, status of the correlation of two columns over targets."""
    return interval(correlation_draws(rows, target, x, y, statistic, **options), F.col("v"))


def target_difference(rows: DataFrame, target: str, a: str, b: str, y: str, statistic: str = "pearson", **options) -> DataFrame:
    """The same for the difference of two columns' correlations with `y`, over the same draws."""
    both = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(y).isNotNull())
    first, second = (correlation_draws(both, target, c, y, statistic, **options).withColumnRenamed("v", n) for c, n in ((a, "_a"), (b, "_b")))
    return interval(first.join(second, "replicate"), F.col("_a") - F.col("_b"))


def endpoint_counts(units: DataFrame, edges: DataFrame, unit: str, period: str, a: str, b: str, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """Edges with how many draws hold the sources of both ends.

    Each of the two periods draws as many of its sources as it has, with replacement. A source carries its
    draws as bits; two sources are drawn together where both have the bit, so draws are never joined with
    each other. A source in both periods, another number of periods than two and a period with one source
    stop the job, and so does an edge whose source is not among `units`.
    """
    own = units.groupBy(F.col(unit).alias("_u")).agg(refused_if(F.min(period) != F.max(period), "A source crosses periods", F.min(period)).alias("_p"))
    held = written(own, "units")
    pools = held.groupBy("_p").count().orderBy("_p").limit(3).collect()
    if len(pools) != 2 or min(r["count"] for r in pools) < 2:
        raise ValueError("Two periods with at least two sources each are needed.")
    spark, words, bits = units.sparkSession, -(-replicates // 64), None
    for n, pool in enumerate(pools):
        numbered = numbered_groups(held.filter(F.col("_p") == pool["_p"]).select("_u"), "_u")
        drawn = group_weights(spark, pool["count"], replicates, seed + n).groupBy("_number", F.expr("replicate div 64").cast("int").alias("_w")).agg(
            F.expr("bit_or(shiftleft(1L, cast(replicate % 64 as int)))").alias("_b"))
        packed = drawn.groupBy("_number").agg(F.map_from_entries(F.collect_list(F.struct("_w", "_b"))).alias("_m"))
        each = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda w: F.coalesce(F.try_element_at("_m", w), F.lit(0).cast("bigint")))
        part = numbered.join(packed, "_number", "left").select("_u", F.coalesce(each, F.array_repeat(F.lit(0).cast("bigint"), words)).alias("_bits"))
        bits = part if bits is None else bits.unionByName(part)
    bits = written(bits, "draw-bits")
    out = edges
    for end, name in ((a, "_x"), (b, "_y")):
        out = out.join(bits.select(F.col("_u").alias(end), F.col("_bits").alias(name)), end, "left")
    lost = F.col("_x").isNull() | F.col("_y").isNull()
    both = F.aggregate(F.zip_with("_x", "_y", lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, v: s + v)
    return out.withColumn("together", refused_if(lost, "An edge's source is not among the units", both)).drop("_x", "_y").withColumn("frequency", F.col("together") / replicates)
