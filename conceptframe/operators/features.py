"""Feature tables of several methods from many shards, and rankings in two stages."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptframe.operators.checks import refused_if
from conceptframe.operators.grid import literal_rows

HELD_MOST = 100_000  # queries whose best rows a task holds before it sends them


def assemble_features(shards: Sequence[DataFrame], samples: DataFrame, columns: Mapping[str, Sequence[str]], direct: Sequence[str] = ()) -> DataFrame:
    """(method, sample_id, features, direct): every method's whole matrix, columns in the manifest's order.

    shards: (method, sample_id, column_id, value). A cell that comes twice, a column missing or unknown, a
    value that is NULL or not finite, a method or sample that nobody asked for, and one without cells stop
    the job: nothing is filled, dropped or intersected. A row's columns are checked by one digest of their
    sorted names. `direct` names the methods whose columns are scores of concepts.
    """
    cells = reduce(DataFrame.unionByName, shards)
    manifest = literal_rows([{"method": m, "c": sorted(c), "o": [sorted(c).index(x) for x in c], "d": m in direct} for m, c in columns.items()], "method string, c array<string>, o array<int>, d boolean")
    wanted = samples.select("sample_id").distinct().select("sample_id", F.inline(manifest)).withColumn("_key", F.sha2(F.array_join("c", "\x00"), 256))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = cells.groupBy("method", "sample_id").agg(F.array_sort(F.collect_list(F.struct("column_id", F.col("value").cast("double").alias("value")))).alias("_c"), F.count("*").alias("_n"))
    rows = rows.withColumn("_found", F.sha2(F.array_join("_c.column_id", "\x00"), 256)).withColumn("_values", F.col("_c.value"))
    both = wanted.join(rows, ["method", "sample_id"], "full_outer")
    wrong = ~F.coalesce((F.col("_key") == F.col("_found")) & (F.col("_n") == F.size("c")) & ~F.exists("_values", bad), F.lit(False))
    ordered = F.transform("o", lambda i: F.get("_values", i))
    return both.select("method", "sample_id", refused_if(wrong, "Feature shards are incomplete, repeated, unknown or not finite", ordered).alias("features"), F.col("d").alias("direct"))


def best_of_each(rows: DataFrame, query: str, candidate: str, score: str, k: int) -> DataFrame:
    """(query, candidate): the k best of each query, ties to the smaller candidate.

    Every task keeps k rows a query, and those lists are merged; no query's rows are sorted as a whole.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def send() -> pa.RecordBatch:
            flat = [(q, s, c) for q, best in held.items() for s, c in best]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*flat), types)], ["q", "s", "c"])

        for batch in batches:
            types = (batch.schema.field(0).type, pa.float64(), batch.schema.field(1).type)
            fresh: dict = {}
            for q, c, s in zip(*(col.to_pylist() for col in batch.columns)):
                fresh.setdefault(q, []).append((-s, c))
            for q, new in fresh.items():
                held[q] = sorted(held.get(q, []) + new)[:k]
            if len(held) > HELD_MOST:
                yield send()
                held = {}
        if held:
            yield send()

    parts = rows.select(query, candidate, F.col(score).cast("double")).mapInArrow(work, f"q {kinds[query]}, s double, c {kinds[candidate]}")
    merged = parts.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("s", "c"))), 1, k).alias("_best"))
    return merged.select(F.col("q").alias(query), F.explode("_best.c").alias(candidate))


def two_stage_priority(first: DataFrame, probabilities: DataFrame, k: int, query: str = "query", candidate: str = "candidate") -> DataFrame:
    """Rows of stage one with `selected`, `probability` and `priority`: the k best of a query come first, by
    2 + their second-stage probability, all others keep their first score.

    first: (query, candidate, score) with cosines; probabilities: (query, candidate, probability) for the
    selected pairs. A score that is no cosine, a selected pair without a probability in 0..1, and a
    probability for a pair that was not selected stop the job. Probabilities that nobody made stay NULL.
    """
    no_cosine = F.col("score").isNull() | F.isnan("score") | (F.abs("score") > 1 + 1e-5)
    scored = first.select(query, candidate, refused_if(no_cosine, "Stage one must be complete cosines", F.col("score")).alias("score"))
    chosen = best_of_each(scored, query, candidate, "score", k).withColumn("selected", F.lit(True))
    given = probabilities.select(query, candidate, "probability").withColumn("_given", F.lit(True))
    both = scored.join(chosen, [query, candidate], "left").join(given, [query, candidate], "full_outer")
    selected = F.coalesce("selected", F.lit(False))
    p = F.col("probability")
    wrong = (selected & ~F.coalesce((p >= 0) & (p <= 1) & ~F.isnan(p), F.lit(False))) | (~selected & F.col("_given").isNotNull() & p.isNotNull()) | F.col("score").isNull()
    return both.select(query, candidate, refused_if(wrong, "Second-stage probabilities do not fit the selected pairs", F.col("score")).alias("score"), selected.alias("selected"), "probability",
                       F.when(selected, 2 + p).otherwise(F.col("score")).alias("priority"))
