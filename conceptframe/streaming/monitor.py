"""Incremental forms: run states, score statistics and scoring of what is new, as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptframe.schema import OK


def run_status(events: DataFrame, run: str = "run", time: str = "utc", status: str = "status") -> DataFrame:
    """Last status of every run and its number of events; one small state for each run (complete or update mode)."""
    last = F.max(F.struct(F.col(time), F.col(status)))
    return events.groupBy(run).agg(last.alias("_l"), F.count("*").alias("events"), F.min(time).alias("started")).select(
        run, "started", F.col(f"_l.{time}").alias("seen"), F.col(f"_l.{status}").alias("status"), "events")


def score_monitor(scores: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Per window and coordinate: cells, failures, mean and SD of scores; late rows count until the watermark."""
    valid = F.when(F.col("status") == OK, F.col("raw_logp"))
    out = scores.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "anchor_id", "bridge_id").agg(
        F.count("*").alias("cells"), F.count_if(F.col("status") != OK).alias("failed"), F.avg(valid).alias("mean_logp"), F.stddev_samp(valid).alias("std_logp"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "anchor_id", "bridge_id", "cells", "failed", "mean_logp", "std_logp")


def score_new(materials: DataFrame, score: Callable[[DataFrame], DataFrame], key: str, time: str, late: str, folder: str, checkpoint: str):
    """A query that scores every material once: repeats of a key within the watermark are dropped, rows
    are appended to `folder` exactly once by the file sink."""
    fresh = materials.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return score(fresh).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
