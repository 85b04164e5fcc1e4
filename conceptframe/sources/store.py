"""Reading inputs and keeping results: samples, score tables, statistics, matrices, networks, ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptframe.operators.checks import refuse_rows, refused_if, require_columns
from conceptframe.operators.grid import Instrument
from conceptframe.schema import SAMPLE, SCORE_KEYS, Refused

# --- inputs ------------------------------------------------------------------------------------

def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples from JSON Lines (.jsonl) or JSON arrays; relative media paths follow the file's folder.

    Repeated ids stop the job where the rows are used.
    """
    raw = spark.read.schema(SAMPLE).option("multiLine", not path.rstrip("/").endswith(".jsonl")).json(path)
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    absolute = "^([a-z]+:/|/)"
    parts = F.transform("parts", lambda p: p.withField("path", F.when(p["path"].isNull() | p["path"].rlike(absolute), p["path"]).otherwise(F.concat(F.col("_folder"), F.lit("/"), p["path"]))))
    rows = raw.withColumn("_folder", folder).withColumn("parts", parts).drop("_folder")
    twice = rows.groupBy("id").agg(F.count("*").alias("_n")).filter("_n > 1")
    marked = rows.join(twice, "id", "left")
    return marked.withColumn("id", refused_if(F.col("_n").isNotNull(), "Duplicate sample ids", F.col("id"))).select(*rows.columns)


def separator_of(spark: SparkSession, path: str) -> str:
    """Tab, semicolon or comma: what the header line has most of."""
    head = spark.read.text(path).limit(1).first()
    line = head[0] if head else ""
    return max("\t;,", key=line.count)


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A table of strings with a header: separator from the header, byte-order mark dropped, empty strings kept."""
    rows = (spark.read.option("header", True).option("sep", sep or separator_of(spark, path)).option("nullValue", "\0")
            .option("emptyValue", "").option("multiLine", True).option("quote", '"').option("escape", '"').csv(path))
    names = [c.removeprefix("﻿") for c in rows.columns]
    return rows.toDF(*names).select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names])


def read_unquoted_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tab table in which quotes are ordinary characters."""
    return spark.read.option("header", True).option("sep", "\t").option("quote", "").option("escape", "\0").option("emptyValue", "").csv(path)


def _lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Lines of one text file with their numbers: a file read whole keeps its order."""
    whole = spark.read.text(path, wholetext=True)
    text = F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), "\n$", "")
    return whole.select(F.posexplode(F.split(text, "\n")).alias("line", name))


def read_line_aligned_pair(spark: SparkSession, data: str, gold: str) -> DataFrame:
    """(line, data, gold) of two files of equal length; another length stops the job."""
    both = _lines(spark, data, "data").join(_lines(spark, gold, "gold"), "line", "full_outer")
    bad = F.col("data").isNull() | F.col("gold").isNull()
    return both.select("line", refused_if(bad, "The files differ in length", F.col("data")).alias("data"), "gold")


def read_json_annotations(spark: SparkSession, path: str, schema: str, explode: str) -> DataFrame:
    """A JSON list of nested records, one row for each entry of one of its arrays (kept if empty)."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    others = [c for c in rows.columns if c != explode]
    return rows.select(*others, F.posexplode_outer(explode).alias("position", explode))


def read_files_with_digest(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """path, bytes, digest of every file; another digest than the expected one stops the job."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        F.regexp_replace("path", "^.*/", "").alias("name"), "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))
    if expected is None:
        return found
    both = expected.select("name", F.col("digest").alias("_said")).join(found, "name", "left")
    bad = F.col("digest").isNull() | (F.col("digest") != F.col("_said"))
    return both.select("name", "path", "bytes", refused_if(bad, "A file has another digest than recorded", F.col("digest")).alias("digest"))


def read_shard_glob(spark: SparkSession, *globs: str) -> DataFrame:
    """Parts of many runs as one table that names the file of each row."""
    return spark.read.parquet(*globs).withColumn("source_file", F.col("_metadata.file_path"))


# --- score tables, statistics, matrices --------------------------------------------------------

def finite_or_null(df: DataFrame) -> DataFrame:
    """NaN and infinities of every float column become NULL; other columns stay."""
    def clean(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c).alias(field.name)
        return c
    return df.select(*[clean(f) for f in df.schema])


def write_scores(scores: DataFrame, instrument: Instrument, folder: str) -> None:
    """The table by measurement, and its coordinates as side tables."""
    spark = scores.sparkSession
    require_columns(scores, [*SCORE_KEYS, "raw_logp", "status", "measurement_id"], "scores")
    scores.write.partitionBy("measurement_id").parquet(f"{folder}/scores")
    instrument.anchors_df(spark).write.parquet(f"{folder}/anchors")
    instrument.bridges_df(spark).write.parquet(f"{folder}/bridges")


def read_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The table; coordinates that its side tables do not name stop the job."""
    scores = spark.read.parquet(f"{folder}/scores")
    anchors = F.broadcast(spark.read.parquet(f"{folder}/anchors").select("anchor_id", F.lit(1).alias("_a")))
    bridges = F.broadcast(spark.read.parquet(f"{folder}/bridges").select("bridge_id", F.lit(1).alias("_b")))
    both = scores.join(anchors, "anchor_id", "left").join(bridges, "bridge_id", "left")
    bad = F.col("_a").isNull() | F.col("_b").isNull()
    return both.withColumn("sample_id", refused_if(bad, "A coordinate is not in the manifest", F.col("sample_id"))).select(*scores.columns)


def write_reference(reference: DataFrame, folder: str) -> None:
    finite_or_null(reference).write.parquet(folder)


def read_reference(spark: SparkSession, folder: str) -> DataFrame:
    return require_columns(spark.read.parquet(folder), ["anchor_id", "bridge_id", "reference_n", "log_mean_probability", "mean_logp", "std_logp"], "reference")


def write_matrix(wide: DataFrame, anchors: Sequence[str], variant: str, folder: str) -> None:
    """The wide form, and the ids it must have when it is read again."""
    require_columns(wide, ["sample_id", *anchors], "matrix")
    wide.select("sample_id", *anchors).write.parquet(f"{folder}/values")
    rows = [(i, a, variant) for i, a in enumerate(anchors)]
    wide.sparkSession.createDataFrame(rows, "position int, anchor_id string, variant string").write.parquet(f"{folder}/anchors")
    wide.select("sample_id").write.parquet(f"{folder}/samples")


def read_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The wide form with its columns in the written order; other ids than the written ones stop the job."""
    wide = spark.read.parquet(f"{folder}/values")
    anchors = [r.anchor_id for r in spark.read.parquet(f"{folder}/anchors").orderBy("position").collect()]
    if wide.columns != ["sample_id", *anchors]:
        raise Refused("The matrix has other anchors than its manifest.")
    ids = spark.read.parquet(f"{folder}/samples").groupBy("sample_id").agg(F.count("*").alias("_n"))
    both = wide.withColumn("_here", F.lit(1)).join(ids, "sample_id", "full_outer")
    bad = F.col("_here").isNull() | F.coalesce(F.col("_n") != 1, F.lit(True))
    return both.select(refused_if(bad, "The matrix has other samples than its manifest", F.col("sample_id")).alias("sample_id"), *anchors)


# --- partitions, shards, networks, ledgers -----------------------------------------------------

def write_splits(samples: DataFrame, labels: DataFrame, folder: str, key: str = "sample_id", split: str = "split") -> None:
    """Samples and their labels by split; labels take their sample's split."""
    samples.write.partitionBy(split).parquet(f"{folder}/samples")
    labels.drop(split).join(samples.select(key, split), key).write.partitionBy(split).parquet(f"{folder}/labels")


def write_shards(shards: DataFrame, order: str, folder: str) -> DataFrame:
    """Rows by their shard number, and a manifest row for each: rows, first and last id."""
    shards.repartition("shard").sortWithinPartitions("shard", order).write.partitionBy("shard").parquet(f"{folder}/rows")
    manifest = shards.groupBy("shard").agg(F.count("*").alias("n"), F.min(order).alias("first_id"), F.max(order).alias("last_id"))
    manifest.write.parquet(f"{folder}/manifest")
    return shards.sparkSession.read.parquet(f"{folder}/manifest")


def write_network(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes, and every undirected edge once, smaller end first; an edge to an unknown node stops the job."""
    known = nodes.select(F.col("node").alias("_k"))
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *[c for c in edges.columns if c not in ("a", "b")])
    refuse_rows(ends.select(F.explode(F.array("a", "b")).alias("_k")).distinct().join(known, "_k", "left_anti"), "An edge names an unknown node")
    nodes.write.parquet(f"{folder}/nodes")
    ends.dropDuplicates(["a", "b"]).write.parquet(f"{folder}/edges")


def append_ledger(events: DataFrame, folder: str) -> None:
    """Event rows (utc, run, status, details) at the end of a ledger; nothing in it is ever rewritten."""
    require_columns(events, ["utc", "run", "status", "details"], "events")
    events.select("utc", "run", "status", "details").write.mode("append").parquet(folder)


def create_run(df: DataFrame, folder: str) -> None:
    """Results of one run; a folder that is there already is refused."""
    df.write.mode("errorifexists").parquet(folder)
