"""Round trips of what is read and kept, and the cases that must stop."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conceptframe.operators import grid, prepare, scorers
from conceptframe.schema import Refused
from conceptframe.sources import store

STUDY = grid.Instrument((grid.Anchor("a", "one"), grid.Anchor("b", "two")), (grid.Bridge("p", "about "),))


def stops(do):
    with pytest.raises((PySparkException, Refused)):
        do()


def test_samples(spark, tmp_path):
    rows = [{"id": "x", "parts": [{"type": "image", "path": "m/1.png"}, {"type": "text", "text": "t"}]}, {"id": "y", "parts": [{"type": "image", "path": "/abs.png"}]}]
    (tmp_path / "s.json").write_text(json.dumps(rows))
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, rows)))
    for name in ("s.json", "s.jsonl"):
        out = {r.id: r.parts for r in store.read_samples(spark, str(tmp_path / name)).collect()}
        assert out["x"][0].path.endswith(f"{tmp_path}/m/1.png") and out["x"][1].path is None and out["y"][0].path == "/abs.png"
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, [rows[0], rows[0]])))
    stops(lambda: store.read_samples(spark, str(tmp_path / "d.jsonl")).collect())


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id;text\n1;\"a;b\"\n2;\n".encode())
    out = store.read_delimited(spark, str(tmp_path / "a.csv"))
    assert out.columns == ["id", "text"] and [tuple(r) for r in out.collect()] == [("1", "a;b"), ("2", "")]
    (tmp_path / "b.tsv").write_text('id\ttext\n1\tsay "hi\n')
    assert store.read_unquoted_tsv(spark, str(tmp_path / "b.tsv")).first().text == 'say "hi'
    (tmp_path / "d.txt").write_text("a\nb\n")
    (tmp_path / "g.txt").write_text("T\nF\n")
    assert [tuple(r) for r in store.read_line_aligned_pair(spark, str(tmp_path / "d.txt"), str(tmp_path / "g.txt")).orderBy("line").collect()] == [(0, "a", "T"), (1, "b", "F")]
    (tmp_path / "h.txt").write_text("T\n")
    stops(lambda: store.read_line_aligned_pair(spark, str(tmp_path / "d.txt"), str(tmp_path / "h.txt")).collect())
    (tmp_path / "j.json").write_text(json.dumps([{"id": 1, "cap": ["u", "v"]}, {"id": 2, "cap": []}]))
    assert sorted(map(str, store.read_json_annotations(spark, str(tmp_path / "j.json"), "id int, cap array<string>", "cap").collect())) == sorted(
        ["Row(id=1, position=0, cap='u')", "Row(id=1, position=1, cap='v')", "Row(id=2, position=None, cap=None)"])


def test_digests(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/1.bin").write_bytes(b"abc")
    one = store.read_files_with_digest(spark, str(tmp_path / "m")).first()
    assert one.bytes == 3 and one.digest.startswith("ba7816bf")
    said = lambda d: spark.createDataFrame([("1.bin", d)], "name string, digest string")
    assert store.read_files_with_digest(spark, str(tmp_path / "m"), said(one.digest)).count() == 1
    stops(lambda: store.read_files_with_digest(spark, str(tmp_path / "m"), said("0")).collect())


def scores(spark):
    docs = spark.createDataFrame([("s", "one two two"), ("t", "two")], "sample_id string, text string")
    return scorers.query_likelihood(docs, STUDY, scorers.fit_language_model(docs, STUDY))


def test_scores_come_back(spark, tmp_path):
    s = scores(spark)
    store.write_scores(s, STUDY, str(tmp_path / "s"))
    back = store.read_scores(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, back.select(s.columns).collect())) == sorted(map(tuple, s.collect()))
    s.limit(1).withColumn("anchor_id", F.lit("zzz")).write.mode("append").partitionBy("measurement_id").parquet(str(tmp_path / "s/scores"))
    stops(lambda: store.read_scores(spark, str(tmp_path / "s")).collect())


def test_matrix_and_statistics(spark, tmp_path):
    wide = spark.createDataFrame([("s", 1.0, None), ("t", 2.0, 3.0)], "sample_id string, a double, b double")
    store.write_matrix(wide, ["a", "b"], "raw_logp", str(tmp_path / "m"))
    assert sorted(map(tuple, store.read_matrix(spark, str(tmp_path / "m")).collect())) == [("s", 1.0, None), ("t", 2.0, 3.0)]
    wide.limit(1).withColumn("sample_id", F.lit("new")).write.mode("append").parquet(str(tmp_path / "m/values"))
    stops(lambda: store.read_matrix(spark, str(tmp_path / "m")).collect())
    odd = spark.createDataFrame([(float("nan"), float("inf"), 1.0, "x")], "a double, b double, c double, d string")
    assert tuple(store.finite_or_null(odd).first()) == (None, None, 1.0, "x")


def test_splits_shards_networks_ledgers(spark, tmp_path):
    s = spark.createDataFrame([("a", "train"), ("b", "test")], "sample_id string, split string")
    store.write_splits(s, spark.createDataFrame([("a", 1), ("b", 0), ("z", 1)], "sample_id string, y int"), str(tmp_path / "b"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "b/labels")).select("sample_id", "y", "split").collect()} == {("a", 1, "train"), ("b", 0, "test")}
    ids = spark.range(10)
    manifest = store.write_shards(prepare.fixed_shards(ids, "id", 4), "id", str(tmp_path / "f"))
    assert sorted(r.n for r in manifest.collect()) == [2, 4, 4]
    assert store.read_shard_glob(spark, str(tmp_path / "f/rows/shard=0"), str(tmp_path / "f/rows/shard=2")).select("id", "source_file").distinct().count() == 6
    nodes = spark.createDataFrame([("x",), ("y",)], "node string")
    store.write_network(nodes, spark.createDataFrame([("y", "x", 0.5), ("x", "y", 0.5)], "a string, b string, w double"), str(tmp_path / "n"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "n/edges")).select("a", "b", "w").collect()] == [("x", "y", 0.5)]
    stops(lambda: store.write_network(nodes, spark.createDataFrame([("x", "q", 0.5)], "a string, b string, w double"), str(tmp_path / "n2")))
    event = spark.createDataFrame([("2024", "r", "done", "")], "utc string, run string, status string, details string")
    for _ in range(2):
        store.append_ledger(event, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 2
    store.create_run(event, str(tmp_path / "r"))
    stops(lambda: store.create_run(event, str(tmp_path / "r")))
