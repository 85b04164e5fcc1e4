"""Streams over files give what one batch over all files gives."""

import datetime as dt

from pyspark.sql import functions as F

from conceptframe.operators import grid, scorers
from conceptframe.streaming import monitor

AT = dt.datetime(2024, 1, 1)


def files(spark, folder, batches, kind):
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_run_states(spark, tmp_path):
    kind = "utc timestamp, run string, status string"
    batches = [[(AT, "a", "started"), (AT, "b", "started")], [(AT + dt.timedelta(minutes=1), "a", "done")]]
    stream = monitor.run_status(files(spark, tmp_path / "e", batches, kind))
    q = stream.writeStream.format("memory").queryName("runs").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    out = {r.run: (r.status, r.events) for r in spark.table("runs").collect()}
    assert out == {"a": ("done", 2), "b": ("started", 1)}
    batch = monitor.run_status(spark.read.parquet(str(tmp_path / "e")))
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, spark.table("runs").collect()))


def test_monitor_counts_failures_apart(spark, tmp_path):
    kind = "t timestamp, anchor_id string, bridge_id string, raw_logp double, status string"
    rows = [(AT, "a", "b", -1.0, "ok"), (AT, "a", "b", -3.0, "ok"), (AT, "a", "b", None, "BudgetExceeded")]
    stream = monitor.score_monitor(files(spark, tmp_path / "s", [rows], kind), "t")
    q = stream.writeStream.format("memory").queryName("mon").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    one = spark.table("mon").first()
    assert (one.cells, one.failed, one.mean_logp) == (3, 1, -2.0)


def test_what_is_new_is_scored_once(spark, tmp_path):
    study = grid.Instrument((grid.Anchor("a", "one"),), (grid.Bridge("p", "about "),))
    docs = spark.createDataFrame([("s", "one two"), ("t", "two")], "sample_id string, text string")
    model = scorers.fit_language_model(docs, study)
    kind = "sample_id string, text string, t timestamp"
    stream = files(spark, tmp_path / "m", [[("s", "one two", AT)], [("s", "one two", AT), ("t", "two", AT)]], kind)
    q = monitor.score_new(stream, lambda d: scorers.query_likelihood(d, study, model), "sample_id", "t", "1 hour", str(tmp_path / "out"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out")).select("sample_id", F.round("raw_logp", 9)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, scorers.query_likelihood(docs, study, model).select("sample_id", F.round("raw_logp", 9)).collect()))
