"""Refusals: rules that stop a job, each one aggregate pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptframe.schema import Refused


def require_columns(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise Refused(f"{name} lacks columns {missing}; found {df.columns}")
    return df


def refuse_rows(df: DataFrame, message: str) -> None:
    """Stop if the table of violations has any row; shows a few of them."""
    bad = [row.asDict() for row in df.limit(5).collect()]
    if bad:
        raise Refused(f"{message}: {bad}")


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One pass that counts, per rule, the rows that break it (a NULL verdict breaks it)."""
    counts = df.agg(*[F.coalesce(F.sum(F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1)), F.lit(0))
                      .cast("bigint").alias(name) for name, ok in rules.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules])
    return counts.select(F.explode(pairs).alias("r")).select("r.rule", "r.violations")


def enforce(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    refuse_rows(violations(df, rules).filter("violations > 0"), "Values outside their domain")
    return df


def unique_keys(df: DataFrame, keys: Sequence[str], message: str = "Duplicate keys") -> DataFrame:
    null = F.lit(False)
    for key in keys:
        null = null | F.col(key).isNull()
    refuse_rows(df.groupBy(*keys).count().filter((F.col("count") > 1) | null), message)
    return df


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has, with the side's name."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, list(keys), "full_outer")
    side = F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right")
    return both.withColumn("side", side).filter("side is not null").select(*keys, "side")


def small_rows(df: DataFrame, limit: int) -> list:
    """Rows of a table that must be small (configuration, statistics per group); refuses anything larger."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise Refused(f"More than {limit} rows; this table may not pass through the driver.")
    return rows


def refused_if(bad: Column, message: str, value: Column) -> Column:
    """The value, or a failed job where the rule is broken: the check is part of the result's own plan."""
    return F.when(bad, F.raise_error(F.lit(message))).otherwise(value)


def at_least(df: DataFrame, n: int, message: str) -> DataFrame:
    """A sample of exactly `n` rows, refused when shorter. `df` is already limited to `n`, so the count
    is over a table of that size."""
    first = df.columns[0]
    counted = df.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(F.lit(0))))
    return counted.select(refused_if(F.col("_n") < n, message, F.col(first)).alias(first), *df.columns[1:])
