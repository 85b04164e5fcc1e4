"""Running totals and positions over a whole table without a single-task window.

A window over one hot key (or over no key at all) lands in one task. Here the order column is first
cut into buckets that keep its order; a window runs inside (key, bucket), and the bucket totals,
at most a few thousand rows per key, carry the offsets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptframe.functions.hashing import hash_bucket

BUCKETS = 64


def running_sums(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
                 sums: Mapping[str, Column]) -> DataFrame:
    """Inclusive cumulative sums of `sums` inside `keys`, along `order`; `bucket` must be monotone in it."""
    cut = df.withColumn("_bucket", bucket)
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = cut.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    key = list(keys) or [F.lit(0)]
    before = W.partitionBy(*key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    local = cut.select("*", *[F.sum(c).over(inside).alias(f"_l_{n}") for n, c in sums.items()])
    joined = local.join(offsets, [*keys, "_bucket"])
    return joined.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def value_bucket(df: DataFrame, value: str, buckets: int = BUCKETS) -> Column:
    """Bucket number of a number, ascending, cut at the column's own approximate quantiles.

    The cut points are at most `buckets` numbers, read once; only the balance of the buckets depends
    on them, never the result.
    """
    shares = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.agg(F.percentile_approx(value, shares, 1000)).first()[0] or []))
    if not cuts:
        return F.lit(0)
    kind = df.schema[value].dataType
    return F.size(F.filter(F.array(*[F.lit(c).cast(kind) for c in cuts]), lambda c: c < F.col(value)))


def hash_positions(df: DataFrame, hexes: str, name: str = "position", keys: Sequence[str] = (),
                   digits: int = 2) -> DataFrame:
    """1-based position of every row in digest order (inside `keys`), spread over 16^digits buckets."""
    return running_sums(df, keys, hash_bucket(F.col(hexes), digits), [F.col(hexes)],
                        {name: F.lit(1).cast("bigint")})


def mid_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str, weight: Column | None = None) -> DataFrame:
    """Average rank of every distinct (key, value); with weights, the rank of rows repeated `weight` times.

    Equal values are one row before anything is ordered, so a popular value costs one row.
    """
    w = F.lit(1).cast("double") if weight is None else weight.cast("double")
    tied = df.groupBy(*keys, value).agg(F.sum(w).alias("_w"))
    run = running_sums(tied, keys, value_bucket(df, value), [F.col(value)], {"_cum": F.col("_w")})
    return run.select(*keys, value, (F.col("_cum") - F.col("_w") + (F.col("_w") + 1) / 2).alias(name))
