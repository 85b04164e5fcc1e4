"""Null-safe statistics. Undefined is NULL, never NaN, never an error of the whole job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and infinities to NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def pearson(x: Column, y: Column) -> Column:
    """Pearson r as an aggregate; NULL if a side is constant or has fewer than two rows."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varied, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def weighted_pearson(w: Column, x: Column, y: Column) -> Column:
    """Pearson r of rows repeated `w` times, from moments of columns that are roughly centred."""
    n, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    cov = F.sum(w * x * y) - F.try_divide(sx * sy, n)
    vx = F.sum(w * x * x) - F.try_divide(sx * sx, n)
    vy = F.sum(w * y * y) - F.try_divide(sy * sy, n)
    present = w > 0
    varied = (F.min(F.when(present, x)) < F.max(F.when(present, x))) & (
        F.min(F.when(present, y)) < F.max(F.when(present, y)))
    floor = F.lit(1e-300)
    r = F.try_divide(cov, F.sqrt(F.greatest(vx, floor)) * F.sqrt(F.greatest(vy, floor)))
    return F.when(varied, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def log_mean_exp(x: Column, peak: Column) -> Column:
    """Stable log of the mean probability; `peak` is the maximum of the group, already joined on."""
    return F.max(peak) + F.log(F.avg(F.exp(x - peak)))


def r9(c: Column) -> Column:
    return F.round(c, 9)


def interval(values: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Percentile interval with linear interpolation, as two aggregates."""
    tail = (1 - confidence) / 2
    return F.percentile(values, F.lit(tail)), F.percentile(values, F.lit(1 - tail))


def mid_ranks_of(values: Column | str) -> Column:
    """Mid-ranks inside an array whose size is bounded by the instrument."""
    return F.transform(values, lambda x: F.aggregate(values, F.lit(0.5), lambda r, y: r + F.when(y < x, 1.0).when(y == x, 0.5).otherwise(0.0)))


def rank_agreement(a: str, b: str) -> Column:
    """Spearman of two arrays of one length; NULL if a side is constant."""
    ra, rb = mid_ranks_of(F.col(a)), mid_ranks_of(F.col(b))
    middle = (F.size(a) + 1) / F.lit(2.0)
    both = F.arrays_zip(ra.alias("x"), rb.alias("y"))
    sums = F.aggregate(both, F.struct(*[F.lit(0.0).alias(n) for n in ("xy", "xx", "yy")]), lambda s, v: F.struct(
        (s["xy"] + (v["x"] - middle) * (v["y"] - middle)).alias("xy"), (s["xx"] + (v["x"] - middle) * (v["x"] - middle)).alias("xx"),
        (s["yy"] + (v["y"] - middle) * (v["y"] - middle)).alias("yy")))
    return F.when((sums["xx"] > 0) & (sums["yy"] > 0), sums["xy"] / F.sqrt(sums["xx"] * sums["yy"]))
