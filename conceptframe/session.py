"""Session defaults and the shared folder used for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "conceptframe", **conf: str) -> SparkSession:
    """A session with the settings the operators expect; `master` stays with the cluster if unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; only a local session without that setting gets a temporary folder."""
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"Set {CHECKPOINT_KEY} to a folder that the driver and all executors share.")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = Path(tempfile.mkdtemp(prefix="spark-")).as_uri()
    return _LOCAL[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back.

    Cuts the lineage of a result that several branches read, and survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
