"""Explicit schemas of the tables and the status values that rows may carry."""

from __future__ import annotations

from pyspark.sql import types as T

PART = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("clip_start", T.DoubleType()),
    T.StructField("clip_end", T.DoubleType()),
])

TARGET = T.StructType([
    T.StructField("part_index", T.IntegerType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("lemma", T.StringType()),
])

SAMPLE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("parts", T.ArrayType(PART)),
    T.StructField("language", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("group_id", T.StringType()),
    T.StructField("time", T.StringType()),
    T.StructField("pair_id", T.StringType()),
    T.StructField("target", TARGET),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

SCORE_KEYS = ["sample_id", "anchor_id", "bridge_id"]
SCORE_COLUMNS = [
    "sample_id", "anchor_id", "anchor_surface", "bridge_id", "bridge_prefix", "relation", "event",
    "status", "error", "raw_logp", "token_count", "mean_token_logp", "model_id", "model_revision",
    "measurement_id",
]
VARIANTS = ("raw_logp", "mean_token_logp", "reference_log_ratio", "reference_z")
EVENTS = ("token_prefix", "turn_terminated")

# Fixed status values of failed score rows.
BOUNDARY = "BoundaryError"
BUDGET = "BudgetExceeded"
MEDIA = "MissingMedia"
OK = "ok"

# Fixed split names: only these may serve as reference material.
REFERENCE_SPLITS = ("train", "training", "external")
SPLIT_ALIASES = {
    "train": "train", "training": "train",
    "dev": "dev", "validation": "dev", "valid": "dev", "development": "dev",
    "test": "test", "external": "external",
}


class Refused(ValueError):
    """An input breaks a rule that the operator must not paper over."""
