"""Shard algebra of score tables, and audits of what was recorded against what is there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptframe.operators.checks import refuse_rows, refused_if


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    out = None
    for i, t in enumerate(tables):
        one = t.withColumn("_part", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def merge_shards(tables: Sequence[DataFrame], expected: DataFrame, cells: int) -> DataFrame:
    """Disjoint sample shards of one measurement; every expected sample has its `cells` cells once.

    A sample in two shards, an unexpected or missing one, an incomplete one or a second measurement
    stops the job. The rows are gone through once: the rule stands beside each of them, among the cells of
    its sample, and is part of the result's plan.
    """
    rows = _union(tables)
    one = rows.select("measurement_id").limit(1).collect()
    sample = W.partitionBy("sample_id")
    marked = rows.select("*", F.min("_part").over(sample).alias("_first"), F.max("_part").over(sample).alias("_last"), F.count("*").over(sample).alias("_n"),
                         F.count("*").over(W.partitionBy("sample_id", "anchor_id", "bridge_id")).alias("_same"))
    known = expected.select("sample_id").distinct().withColumn("_known", F.lit(1))
    both = marked.join(known, "sample_id", "full_outer")  # a missing sample cannot drop out unseen
    good = (F.col("_first") == F.col("_last")) & (F.col("_n") == cells) & (F.col("_same") == 1) & F.col("_known").isNotNull()
    alone = F.coalesce(F.col("measurement_id") == (one[0][0] if one else None), F.lit(False))
    fine = (F.when(~F.coalesce(good, F.lit(False)), F.raise_error(F.lit("A sample is missing, strange, repeated or incomplete")).cast("boolean"))
            .when(~alone, F.raise_error(F.lit("Shards of different measurements")).cast("boolean")).otherwise(True))
    return both.filter(fine).select(*tables[0].columns)


def execution_totals(tables: Sequence[DataFrame]) -> DataFrame:
    """Summed counters of the shards."""
    rows = _union(tables)
    return rows.groupBy("_part").agg(F.count("*").alias("score_items"), F.count_if(F.col("status") != "ok").alias("failed_items")).agg(
        F.count("*").alias("shards"), F.sum("score_items").alias("score_items"), F.sum("failed_items").alias("failed_items"))


def combine_bridges(tables: Sequence[DataFrame]) -> DataFrame:
    """Tables of the same samples and anchors but other bridges, under a new measurement id.

    The new id is a digest of the parents' ids, which stay in `parents`. A bridge in two tables, or a
    sample that lacks one of the tables, stops the job.
    """
    rows = _union(tables)
    owners = rows.select("bridge_id", "_part").distinct().groupBy("bridge_id").count().filter("count > 1")
    refuse_rows(owners, "A bridge is in two tables")
    parents = sorted(r[0] for r in rows.select("measurement_id").distinct().collect())  # one for each table
    per = rows.groupBy("sample_id", "anchor_id").agg(F.count_distinct("_part").alias("_parts"))
    bad = F.col("_parts") != len(tables)
    checked = per.select("sample_id", "anchor_id", refused_if(bad, "A sample or anchor is not in all tables", F.lit(1)).alias("_ok"))
    out = rows.join(checked.filter("_ok = 1"), ["sample_id", "anchor_id"]).drop("_ok", "_part")
    new = F.sha2(F.lit("|".join(parents)), 256)
    return out.withColumn("measurement_id", new).select(*tables[0].columns, F.lit(",".join(parents)).alias("parents"))


def select_bridges(scores: DataFrame, wanted: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Cells of the bridges with the given (prefix, relation), renamed to the given ids.

    Bridges are chosen by definition, not by id. A calibrated table is refused (its statistics belong to
    the old set), and so is a definition that no bridge or more than one has.
    """
    if {"reference_z", "reference_log_ratio"} & set(scores.columns):
        refuse_rows(scores.limit(1).select("sample_id"), "Select bridges before calibration")
    spark = scores.sparkSession
    table = spark.createDataFrame([tuple(w) for w in wanted], "bridge_prefix string, relation string, _new string")
    defs = scores.select("bridge_id", "bridge_prefix", "relation").distinct()  # instrument-sized
    found = table.join(defs, ["bridge_prefix", "relation"], "left").groupBy("_new").agg(F.count("bridge_id").alias("n"), F.first("bridge_id").alias("bridge_id"))
    refuse_rows(found.filter("n <> 1"), "A wanted bridge has no match or more than one")
    chosen = F.broadcast(found.select("bridge_id", "_new"))
    return scores.join(chosen, "bridge_id").withColumn("bridge_id", F.col("_new")).drop("_new").select(*scores.columns)


def bridge_bank(searches: Sequence[tuple[str, DataFrame]], seeds: DataFrame, scored: DataFrame) -> DataFrame:
    """Winners of several searches merged by exact wording: id, wording, source and whether it is new work.

    A wording of a seed keeps the seed's id; any other is named by its digest. The first search in
    order stays as source.
    """
    rows = None
    for place, (name, t) in enumerate(searches):
        one = t.select("bridge_prefix", F.struct(F.lit(place).alias("place"), F.lit(name).alias("method")).alias("_s"))
        rows = one if rows is None else rows.unionByName(one)
    one = rows.groupBy("bridge_prefix").agg(F.min("_s").alias("_s"))
    named = one.join(seeds.select("bridge_prefix", F.col("bridge_id").alias("_seed")), "bridge_prefix", "left")
    new = scored.select("bridge_prefix").distinct().withColumn("_done", F.lit(1))
    return named.join(new, "bridge_prefix", "left").select(
        F.coalesce("_seed", F.concat(F.lit("rewrite_"), F.substring(F.sha2("bridge_prefix", 256), 1, 12))).alias("bridge_id"), "bridge_prefix",
        F.col("_s.method").alias("method"), F.col("_done").isNull().alias("to_score"))


# --- audits ------------------------------------------------------------------------------------

def recompute_audit(rows: DataFrame, report: DataFrame, keys: Sequence[str], value: str, reported: str, tolerance: float = 1e-12) -> DataFrame:
    """Means taken again against those reported: per key the difference, and `ok`; one-sided keys are not ok."""
    again = rows.groupBy(*keys).agg(F.avg(value).alias("_again"))
    both = again.join(report.select(*keys, F.col(reported).alias("_said")), list(keys), "full_outer")
    off = F.abs(F.col("_again") - F.col("_said"))
    return both.select(*keys, off.alias("difference"), F.coalesce(off <= tolerance, F.lit(False)).alias("ok"))


def digest_audit(recorded: DataFrame, actual: DataFrame, path: str = "path", digest: str = "digest", key: str | None = None) -> DataFrame:
    """Recorded digests that the actual files do not have: a file is gone, or has another digest.

    Files are told apart by `key`, by their path without one; several files may share a path then.
    """
    key = key or path
    there = actual.select(F.col(key).alias("_key"), F.col(digest).alias("_actual"), F.lit(True).alias("_there"))
    both = recorded.join(there, F.col(key) == F.col("_key"), "left")
    return both.filter(F.col("_there").isNull() | ~F.col("_actual").eqNullSafe(F.col(digest))).select(path, digest, F.col("_actual").alias("actual"))


def membership_audit(used: DataFrame, registered: DataFrame, roles: DataFrame, group: str, role: str) -> DataFrame:
    """(rule, violations): rows used but not registered, registered but not used, groups in two roles."""
    def count(df: DataFrame, rule: str) -> DataFrame:
        return df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")

    shared = roles.select(group, role).distinct().groupBy(group).count().filter("count > 1")
    return (count(used.exceptAll(registered), "not_registered").unionByName(count(registered.exceptAll(used), "not_used"))
            .unionByName(count(shared, "group_in_two_roles")))


def metadata_lookup(samples: DataFrame, field: str, metadata: str = "metadata") -> DataFrame:
    """The field of each sample, from its column or else its metadata; a sample without it stops the job."""
    held = F.try_element_at(metadata, F.lit(field))
    value = F.coalesce(F.col(field).cast("string"), held) if field in samples.columns else held
    return samples.withColumn(field, refused_if(value.isNull(), f"A sample lacks {field}", value))


