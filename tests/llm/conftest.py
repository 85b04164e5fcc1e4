import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = "/root/testdata/sf0.001"
#: Columns whose names clash with what operators add.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, label double, score double, tie string, n bigint, bucket int, _id bigint"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    session = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "3g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def table(spark):
    """Documents with further columns, from (id, text) or (id, text, source) rows."""
    def make(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, 2, 3.0, 4.0, "t", 5, 6, 7) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)
    return make


EDGES = [(None, "a null id"), (None, None), (1, None), (2, ""), (3, "   \n\t "), (4, "x"), (4, "x"), (5, "Ünï ß 日本   \x00 end"),
         (6, "one two three four five six"), (7, "one two three four five six"), (8, "ONE two  three\nfour five six"), (9, "w" * 30_000),
         (10, "many words " * 4_000)]
