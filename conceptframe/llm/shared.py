"""Tables cut off from their lineage, written where all executors can read them."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; only a local session without that setting gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = Path(tempfile.mkdtemp(prefix="spark-")).as_uri()
    return _LOCAL[app]


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back: later steps neither recompute nor lose it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(spark: SparkSession, at_least: int = 1) -> int:
    """Number of partitions to deal work into: the session's, or more where the work asks for it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), at_least)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def give_back() -> None:
    """What the driver's Python no longer uses goes back to the system; else it is kept beside the JVM's memory until the job ends."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
