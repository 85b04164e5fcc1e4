"""Reference statistics, calibrated scores and the material-by-concept matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptframe.functions.numeric import finite
from conceptframe.operators.checks import refuse_rows, refused_if, require_columns
from conceptframe.operators.grid import Instrument
from conceptframe.schema import OK, REFERENCE_SPLITS, SCORE_KEYS, VARIANTS, Refused

STEP = 64.0  # nats; exponentials inside one step neither overflow nor underflow


def configuration_faults(scores: DataFrame, instrument: Instrument | None = None) -> DataFrame:
    """(rule, violations): unique non-null keys, functional ids, one relation/event/model, declared coordinates."""
    require_columns(scores, [*SCORE_KEYS, "anchor_surface", "bridge_prefix", "relation", "event", "raw_logp",
                             "status", "model_id", "model_revision"], "scores")
    null_key = F.col("sample_id").isNull() | F.col("anchor_id").isNull() | F.col("bridge_id").isNull()
    keys = (scores.groupBy(*SCORE_KEYS).agg(F.count("*").alias("n"))
            .agg(F.coalesce(F.sum(F.when((F.col("n") > 1) | null_key, 1).otherwise(0)), F.lit(0)).alias("v"))
            .select(F.lit("unique_keys").alias("rule"), F.col("v").cast("bigint").alias("violations")))
    # The distinct definitions are instrument-sized, so the remaining rules run on a few rows.
    defs = scores.select("anchor_id", "anchor_surface", "bridge_id", "bridge_prefix", "relation", "event",
                         "model_id", "model_revision").distinct()

    def mixed(rule: str, by: str, *columns: str) -> DataFrame:
        return (defs.groupBy(by).agg(F.count_distinct(F.struct(*columns)).alias("n"))
                .agg(F.count_if(F.col("n") > 1).alias("v")).select(F.lit(rule).alias("rule"), F.col("v").alias("violations")))

    constant = defs.agg(*[F.count_distinct(F.struct(c)).alias(c) for c in ("relation", "event", "model_id", "model_revision")])
    total = sum((F.col(c) - 1 for c in ("event", "model_id", "model_revision")), F.col("relation") - 1)
    out = (keys.unionByName(mixed("anchor_definition", "anchor_id", "anchor_surface"))
           .unionByName(mixed("bridge_definition", "bridge_id", "bridge_prefix", "relation"))
           .unionByName(constant.select(F.lit("single_measurement").alias("rule"), total.cast("bigint").alias("violations"))))
    if instrument is not None:
        spark = scores.sparkSession
        a = instrument.anchors_df(spark).select("anchor_id", "anchor_surface")
        b = instrument.bridges_df(spark).select("bridge_id", "bridge_prefix", "relation")
        stray = (defs.select("anchor_id", "anchor_surface").distinct().join(a, ["anchor_id", "anchor_surface"], "left_anti")
                 .select(F.lit(1).alias("x"))
                 .unionByName(defs.select("bridge_id", "bridge_prefix", "relation").distinct()
                              .join(b, ["bridge_id", "bridge_prefix", "relation"], "left_anti").select(F.lit(1).alias("x"))))
        out = out.unionByName(stray.agg(F.count("*").alias("violations")).select(F.lit("declared_coordinates").alias("rule"), "violations"))
    return out


def check_configuration(scores: DataFrame, instrument: Instrument | None = None) -> DataFrame:
    refuse_rows(configuration_faults(scores, instrument).filter("violations > 0"), "Not one consistent measurement")
    if scores.isEmpty():
        raise Refused("The score table is empty.")
    return scores


def valid_value(variant: str) -> Column:
    if variant not in VARIANTS:
        raise Refused(f"Unknown variant {variant!r}.")
    return F.when(F.col("status") == OK, finite(F.col(variant)))


def complete_grid(scores: DataFrame, samples: DataFrame, instrument: Instrument, variant: str = "raw_logp",
                  missing: str = "error") -> DataFrame:
    """Declared grid with its values; the policy decides what happens to samples or anchors with gaps."""
    if missing not in ("error", "drop_samples", "drop_anchors"):
        raise Refused("missing must be error, drop_samples or drop_anchors.")
    known = F.col("anchor_id").isin([a.id for a in instrument.anchors]) & F.col("bridge_id").isin([b.id for b in instrument.bridges])
    cells = scores.select("sample_id", refused_if(~known, "A score row is not declared", F.col("anchor_id")).alias("anchor_id"), "bridge_id",
                          valid_value(variant).alias("value"))
    ids = samples.select("sample_id").distinct()
    if missing == "drop_anchors":
        wanted = ids.count() * len(instrument.bridges)
        full = cells.groupBy("anchor_id").agg(F.count("value").alias("_n")).filter(F.col("_n") == wanted).select("anchor_id")
        return _some(cells.join(F.broadcast(full), "anchor_id", "left_semi").select(*SCORE_KEYS, "value"))
    # valid cells are counted for each sample, the declared grid is never built
    wanted = len(instrument.anchors) * len(instrument.bridges)
    held = cells.groupBy("sample_id").agg(F.count("value").alias("_n"))
    counted = ids.join(held, "sample_id", "full_outer").withColumn("_n", F.coalesce("_n", F.lit(0)))
    if missing == "error":
        counted = counted.withColumn("_n", refused_if(F.col("_n") != wanted, "Incomplete score grid", F.col("_n")))
    return _some(cells.join(counted.filter(F.col("_n") == wanted).select("sample_id"), "sample_id").select(*SCORE_KEYS, "value"))


def _some(cells: DataFrame) -> DataFrame:
    if cells.isEmpty():
        raise Refused("The missing policy leaves nothing.")
    return cells


def grid_coverage(scores: DataFrame, samples: DataFrame, instrument: Instrument, variant: str = "raw_logp") -> DataFrame:
    per_sample = len(instrument.anchors) * len(instrument.bridges)
    valid = (scores.select(*SCORE_KEYS, valid_value(variant).alias("value"))
             .join(samples.select("sample_id"), "sample_id", "left_semi")
             .groupBy("sample_id").agg(F.count("value").alias("n_valid")))
    return (samples.select("sample_id").join(valid, "sample_id", "left")
            .select(F.coalesce("n_valid", F.lit(0)).alias("n_valid"))
            .agg((F.count("*") * per_sample).alias("expected_cells"), F.sum("n_valid").alias("valid_cells"),
                 F.count_if(F.col("n_valid") < per_sample).alias("incomplete_samples")))


def leaking_reference_rows(samples: DataFrame, split: str = "split", also: Sequence[str] = ()) -> DataFrame:
    """Reference rows recorded as test or validation anywhere; an override in one place hides nothing."""
    wrong = F.lit(False)
    for column in (split, *also):
        wrong = wrong | (F.col(column).isNotNull() & ~F.lower(F.col(column)).isin(*REFERENCE_SPLITS))
    return samples.filter(wrong)


def guard_reference(samples: DataFrame, split: str = "split", also: Sequence[str] = ()) -> DataFrame:
    refuse_rows(leaking_reference_rows(samples, split, also).select("sample_id"), "Reference material must be training or external")
    return samples


def fit_reference(scores: DataFrame, value: str = "raw_logp") -> DataFrame:
    """Per (anchor, bridge): n, log mean probability, mean, sample SD and the status of z scores.

    One scan: the values of a coordinate are first summed within steps of `STEP` nats, so that no
    exponential underflows, and the few steps of a coordinate are then brought together. Rows that say
    they are no reference material (a split column is there) and cells without a value are refused.
    """
    keys = ["anchor_id", "bridge_id"]
    v = F.col(value)
    if "split" in scores.columns:
        wrong = F.col("split").isNotNull() & ~F.lower("split").isin(*REFERENCE_SPLITS)
        v = refused_if(wrong, "Reference material must be training or external", v)
    v = refused_if(finite(F.col(value)).isNull(), "A reference cell has no value", v)
    rows = scores.select(*keys, v.alias("v"), F.floor(F.col(value) / STEP).alias("step"))
    steps = rows.groupBy(*keys, "step").agg(
        F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.sum(F.exp(F.col("v") - F.col("step") * STEP)).alias("e"))
    top = steps.groupBy(*keys).agg(F.sum("n").alias("reference_n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                                   F.collect_list(F.struct("step", "n", "m", "s", "e")).alias("parts"))
    total = lambda f: F.aggregate("parts", F.lit(0.0), lambda a, p: a + f(p))
    peak = F.array_max(F.transform("parts", lambda p: p["step"]))
    stats = top.withColumn("mean_logp", total(lambda p: p["n"] * p["m"]) / F.col("reference_n")).withColumn("_peak", peak)
    spread = total(lambda p: p["n"] * (p["s"] + (p["m"] - F.col("mean_logp")) * (p["m"] - F.col("mean_logp"))))
    sd = F.sqrt(F.try_divide(spread, F.col("reference_n") - 1))
    lmp = F.col("_peak") * STEP + F.log(total(lambda p: p["e"] * F.exp((p["step"] - F.col("_peak")) * STEP)) / F.col("reference_n"))
    return (stats.select(*keys, "reference_n", lmp.alias("log_mean_probability"), "mean_logp",
                         F.when(F.col("lo") == F.col("hi"), F.when(F.col("reference_n") > 1, 0.0)).otherwise(sd).alias("std_logp"))
            .withColumn("z_status", F.when(F.col("std_logp") > 0, OK).when(F.col("std_logp") == 0, "undefined_constant")
                        .otherwise("undefined_insufficient")))


def transform(scores: DataFrame, reference: DataFrame) -> DataFrame:
    """Reference log ratio and z added; raw scores stay. A coordinate without statistics stops the job."""
    # one row for each (anchor, bridge) of the instrument: a bound that does not grow with the data
    stats = F.broadcast(reference.groupBy("anchor_id", "bridge_id").agg(
        F.count("*").alias("_found"), *[F.first(c).alias(c) for c in ("log_mean_probability", "mean_logp", "std_logp")]))
    joined = scores.join(stats, ["anchor_id", "bridge_id"], "left")
    valid = (F.col("status") == OK) & finite(F.col("raw_logp")).isNotNull()
    scale = F.col("std_logp") > 0
    lmp = refused_if(F.coalesce(F.col("_found"), F.lit(0)) != 1, "Reference lacks a coordinate or has it twice", F.col("log_mean_probability"))
    return joined.select(
        *scores.columns,
        F.when(valid, F.col("raw_logp") - lmp).alias("reference_log_ratio"),
        F.when(valid & scale, F.try_divide(F.col("raw_logp") - F.col("mean_logp"), F.col("std_logp"))).alias("reference_z"),
        F.when(~valid, "failed_score").when(scale, OK).otherwise("undefined_reference_scale").alias("reference_z_status"))


def to_matrix(scores: DataFrame, n_bridges: int, variant: str = "raw_logp", keep: Sequence[str] = ()) -> DataFrame:
    """Plain mean over the fixed set of wordings; a cell with a wording missing has no value."""
    value = valid_value(variant)
    return (scores.groupBy("sample_id", *keep, "anchor_id")
            .agg(F.when(F.count(value) == n_bridges, F.avg(value)).alias("value")))


def matrix_vectors(matrix: DataFrame, anchors: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per sample with its values in instrument order; incomplete samples are refused as NULL vectors."""
    cells = F.map_from_entries(F.collect_list(F.struct("anchor_id", "value")))
    wide = matrix.groupBy("sample_id", *keep).agg(cells.alias("_m"))
    vector = F.array(*[F.element_at("_m", F.lit(a)) for a in anchors])
    return wide.select("sample_id", *keep, F.when(~F.exists(vector, lambda v: v.isNull()), vector).alias("vector"))


def wide_matrix(matrix: DataFrame, anchors: Sequence[str]) -> DataFrame:
    """One column per anchor, for export."""
    return matrix.groupBy("sample_id").agg(*[F.max(F.when(F.col("anchor_id") == a, F.col("value"))).alias(a) for a in anchors])


def long_matrix(wide: DataFrame, anchors: Sequence[str]) -> DataFrame:
    return wide.unpivot("sample_id", list(anchors), "anchor_id", "value")


def overlapping_reference(reference: DataFrame, evaluation: DataFrame, columns: Sequence[str] = ("sample_id", "group_id")) -> DataFrame:
    """Identities that reference and evaluation share, per kind of identity."""
    out = None
    for c in columns:
        shared = (reference.select(c).distinct().join(evaluation.select(c).distinct(), c, "left_semi")
                  .select(F.lit(c).alias("kind"), F.col(c).cast("string").alias("identity")))
        out = shared if out is None else out.unionByName(shared)
    return out
