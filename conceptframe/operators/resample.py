"""Resampling as weights: every draw is a digest, every statistic comes from per-group sums.

A replicate is a set of group weights. Rows are summed by group once; replicates times groups is all
that is ever expanded, and the rows of the data never are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptframe.functions.hashing import digest
from conceptframe.operators.ordering import hash_positions

REPLICATES = 1000  # that of the reference; the same in library and queries


def draw(seed: int, *parts: Column) -> Column:
    """A non-negative number of 60 bits for each combination of parts."""
    return F.conv(F.substring(digest(seed, *[p.cast("string") for p in parts]), 1, 15), 16, 10).cast("bigint")


def numbered_groups(sums: DataFrame, group: str) -> DataFrame:
    """Groups with their number (from 0) in digest order."""
    hashed = sums.withColumn("_h", F.sha2(F.col(group).cast("string"), 256))
    return hash_positions(hashed, "_h", "_number").withColumn("_number", F.col("_number") - 1).drop("_h")


def draws(spark, groups: int, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """(replicate, _number): whole groups drawn with replacement, as many as there are, a row for each draw."""
    pairs = spark.range(replicates * groups).select((F.col("id") % replicates).alias("replicate"), F.expr(f"id div {replicates}").alias("pick"))
    return pairs.select("replicate", (draw(seed, F.col("replicate"), F.col("pick")) % groups).alias("_number"))


def group_weights(spark, groups: int, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """(replicate, _number, weight): how often each group is drawn, of those that are."""
    return draws(spark, groups, replicates, seed).groupBy("replicate", "_number").agg(F.count("*").alias("weight"))


def bootstrap_sums(rows: DataFrame, group: str, sums: dict[str, Column], replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """Sums of each replicate, and of the data as replicate -1. Fewer than two groups stop the job."""
    per = numbered_groups(rows.groupBy(group).agg(*[F.sum(c).alias(n) for n, c in sums.items()]), group)
    count = per.count()
    if count < 2:
        raise ValueError("A group bootstrap needs at least two groups.")
    weights = group_weights(rows.sparkSession, count, replicates, seed)
    drawn = weights.join(per, "_number").groupBy("replicate").agg(*[F.sum(F.col("weight") * F.col(n)).alias(n) for n in sums])
    point = per.agg(*[F.sum(n).alias(n) for n in sums]).select(F.lit(-1).cast("bigint").alias("replicate"), *sums)
    return drawn.unionByName(point)


def interval(replicates: DataFrame, value: Column, confidence: float = 0.95, min_valid: float = 0.8) -> DataFrame:
    """estimate, lower, upper, valid, invalid, status; too many undefined replicates leave no interval."""
    v = F.when(~F.isnan(value), value)
    rows = replicates.select("replicate", v.alias("v"))
    tail = (1 - confidence) / 2
    drawn = F.when(F.col("replicate") >= 0, F.col("v"))
    out = rows.agg(F.max(F.when(F.col("replicate") == -1, F.col("v"))).alias("estimate"), F.percentile(drawn, F.lit(tail)).alias("lower"),
                   F.percentile(drawn, F.lit(1 - tail)).alias("upper"), F.count(drawn).alias("valid"), F.count_if((F.col("replicate") >= 0) & F.col("v").isNull()).alias("invalid"))
    status = F.when(F.col("estimate").isNull(), "undefined").when(F.col("valid") < min_valid * (F.col("valid") + F.col("invalid")), "too_few_valid").otherwise("ok")
    good = status == "ok"
    return out.select("estimate", F.when(good, F.col("lower")).alias("lower"), F.when(good, F.col("upper")).alias("upper"), "valid", "invalid", status.alias("status"))


def group_bootstrap_mean(rows: DataFrame, group: str, value: str, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """Mean of all rows with an interval from whole groups."""
    out = bootstrap_sums(rows, group, {"s": F.col(value), "n": F.when(F.col(value).isNotNull(), 1).otherwise(0)}, replicates, seed)
    return interval(out, F.try_divide("s", "n"))


def paired_difference(rows: DataFrame, group: str, a: str, b: str, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """Mean of a - b with an interval, and the p value of the centred replicates."""
    out = bootstrap_sums(rows, group, {"s": F.col(a) - F.col(b), "n": F.when((F.col(a) - F.col(b)).isNotNull(), 1).otherwise(0)}, replicates, seed)
    value = F.try_divide("s", "n")
    point = F.max(F.when(F.col("replicate") == -1, value)).over(W.partitionBy(F.lit(0)))  # replicates only
    far = out.withColumn("_d", value).withColumn("_p", point).agg(
        F.count_if((F.col("replicate") >= 0) & (F.abs(F.col("_d") - F.col("_p")) >= F.abs("_p"))).alias("_far"), F.count_if(F.col("replicate") >= 0).alias("_all"))
    one = interval(out, value).withColumn("_k", F.lit(1))
    return one.join(far.select(F.lit(1).alias("_k"), ((F.col("_far") + 1) / (F.col("_all") + 1)).alias("p")), "_k").drop("_k")


def compare_groups(rows: DataFrame, cluster: str, side: str, a: str, b: str, value: str, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """Difference of two sides' means with an interval from whole clusters."""
    own = {f"{k}{i}": F.when((F.col(side) == s) & F.col(value).isNotNull(), F.col(value) if k == "s" else F.lit(1)).otherwise(0) for i, s in enumerate((a, b)) for k in "sn"}
    out = bootstrap_sums(rows, cluster, own, replicates, seed)
    return interval(out, F.try_divide("s0", "n0") - F.try_divide("s1", "n1"))


def cluster_permutation(rows: DataFrame, cluster: str, side: str, a: str, value: str, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """Two-sided p of the difference of means when whole clusters change sides.

    A cluster has one side. In each replicate the clusters are ordered by a digest and the first as many
    as side `a` has are called `a`; replicates times clusters rows are ranked, one window a replicate.
    """
    per = rows.groupBy(cluster).agg(F.max((F.col(side) == a).cast("int")).alias("_a"), F.min((F.col(side) == a).cast("int")).alias("_b"),
                                    F.sum(value).alias("s"), F.count(value).alias("n"))
    mixed, first = per.agg(F.count_if(F.col("_a") != F.col("_b")), F.sum("_a")).first()
    if mixed:
        raise ValueError("A cluster is on both sides.")
    drawn = per.select(cluster, "s", "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    order = W.partitionBy("replicate").orderBy(digest(seed, F.col("replicate"), F.col(cluster)))
    sides = drawn.select("replicate", "s", "n", (F.row_number().over(order) <= first).cast("int").alias("_a"))
    point = per.select(F.lit(-1).alias("replicate"), "s", "n", "_a")

    def mean(flag: int) -> Column:
        return F.try_divide(F.sum(F.when(F.col("_a") == flag, F.col("s"))), F.sum(F.when(F.col("_a") == flag, F.col("n"))))

    stats = sides.unionByName(point).groupBy("replicate").agg((mean(1) - mean(0)).alias("d"))
    stats = stats.withColumn("_p", F.max(F.when(F.col("replicate") == -1, F.col("d"))).over(W.partitionBy(F.lit(0))))
    return stats.agg(F.max("_p").alias("difference"), ((F.count_if((F.col("replicate") >= 0) & (F.abs("d") >= F.abs("_p") - 1e-12)) + 1)
                                                       / (F.count_if(F.col("replicate") >= 0) + 1)).alias("p"))


def label_shuffle(rows: DataFrame, group: Sequence[str], key: str, label: str, seed: int = 42) -> DataFrame:
    """Labels dealt anew inside each group: the row at one digest place gets the label at another."""
    keep = list(group)
    place = hash_positions(rows.withColumn("_h", digest(seed, F.col(key))), "_h", "_at", keep)
    give = hash_positions(rows.select(*keep, key, F.col(label).alias("_new")).withColumn("_h", digest(seed + 1, F.col(key))), "_h", "_at", keep)
    return place.drop("_h").join(give.select(*keep, "_at", "_new"), [*keep, "_at"]).drop("_at", label).withColumnRenamed("_new", label)
