"""Exact top-k by inner product: columnar branch and bound.

A task holds its candidates in blocks, dimension by dimension. Scores of all queries of a small batch
grow by `STEP` dimensions at a time; after each step a candidate whose score so far plus the largest
possible rest (the product of the lengths of both vectors' remaining parts) is below the k-th best
score of every query is dropped, and the survivors are moved together. What the task found so far
sets the bar for its next block. Each task gives k rows for a query at most, and those meet in one
last ranking.

Components are integers, floor(1024 x), and scores are exact integers. Where a block's components are so
large that a score could pass 2^53, its scores are worked out in whole numbers instead of doubles, without
the bounds; a score that no long can hold counts as the nearest long. The queries travel in blocks of at
most `QUERY_BYTES`; a larger query set means more passes over the candidates, not more memory.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an
id. Shorter vectors count as filled up with zeros. A query's own id is no candidate of it; repeated
ids are candidates each, and repeated query rows are answered each. Fewer than k candidates: all of
them. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAME = "op7_exact_top_k"
SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM r WHERE place <= 10"""
K, SCALE, STEP = 10, 1024, 16
QUERY_BYTES = 32 << 20
CANDIDATES, QUERIES = 8192, 128


def vectors(batch: pa.RecordBatch, id_column: str, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer components (as doubles) of the rows that take part."""
    lists = batch.column(column)
    usable = np.asarray(lists.is_valid()) & np.asarray(batch.column(id_column).is_valid())
    lengths = np.where(usable, np.asarray(pc.fill_null(pc.list_value_length(lists), 0)), 0).astype(np.int64)
    batch = batch.filter(pa.array(usable))
    lengths = lengths[usable]
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max()) if len(lengths) else 0
    row = np.repeat(np.arange(len(lengths)), lengths)
    out = np.zeros((len(lengths), width))
    out[row, np.arange(len(flat)) - (np.cumsum(lengths) - lengths)[row]] = flat
    good = np.isfinite(out).all(1)
    return batch.column(id_column).to_numpy(zero_copy_only=False).astype(np.int64)[good], scaled(out[good])


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(1024 x); what no double can hold is the largest double."""
    most = np.finfo(np.float64).max
    return np.floor(SCALE * np.clip(x, -most / SCALE, most / SCALE))


def whole_scores(query: np.ndarray, candidates: np.ndarray, most: float) -> np.ndarray:
    """Inner products of one query in whole numbers; `most` bounds their size."""
    if most < 2.0 ** 62:
        return candidates.astype(np.int64) @ query.astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    sums = exact(candidates) @ exact(query) if candidates.size else np.zeros(len(candidates), object)
    ends = np.iinfo(np.int64)
    return np.array([min(max(int(s), ends.min), ends.max) for s in sums], np.int64)


def _fit(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


class Best:
    """The k best of each query so far: scores and ids, best first."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), np.iinfo(np.int64).min)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.found = np.zeros(queries, np.int64)

    def bar(self, rows: slice) -> np.ndarray:
        """What a score must reach, as doubles; beyond 2^53 no block that is searched in doubles reaches it."""
        return np.where(self.found[rows] < self.k, -np.inf, self.score[rows, -1].astype(np.float64))

    def add(self, rows: slice, ids: np.ndarray, scores: np.ndarray, able: np.ndarray) -> None:
        """scores: queries x candidates, whole numbers; able: which of them count."""
        scores = scores.astype(np.int64)
        for i, q in enumerate(range(*rows.indices(len(self.score)))):
            at = np.flatnonzero(able[i] & (scores[i] >= self.score[q, -1]))
            if not len(at):
                continue
            score = np.concatenate([self.score[q], scores[i, at]])
            own = np.concatenate([self.id[q], ids[at]])
            self.found[q] = min(self.k, self.found[q] + len(at))
            if len(score) > 4 * self.k:
                edge = np.partition(score, len(score) - self.k)[len(score) - self.k]
                near = score >= edge
                score, own = score[near], own[near]
            order = np.lexsort((own, ~score))[:self.k]  # ~ turns the order round and cannot overflow
            self.score[q], self.id[q] = score[order], own[order]


def search_block(best: Best, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray) -> None:
    """Branch and bound of all queries over one block of candidates."""
    width = queries.shape[1]
    with np.errstate(over="ignore"):
        most = width * np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0)
    if most >= 2.0 ** 53:
        for i in range(len(queries)):
            best.add(slice(i, i + 1), ids, whole_scores(queries[i], candidates, most)[None], query_ids[i] != ids[None])
        return
    if not width:
        order = np.array([], np.int64)
    else:  # large parts first, so that the bounds close early
        order = np.argsort(-(np.abs(candidates).mean(0) * np.abs(queries).mean(0)), kind="stable")
    queries, columns = queries[:, order], np.ascontiguousarray(candidates[:, order].T)
    cuts = list(range(0, width, STEP)) + [width]
    rest_q = [np.sqrt((queries[:, c:] ** 2).sum(1)) for c in cuts]
    rest_c = [np.sqrt((columns[c:] ** 2).sum(0)) for c in cuts]
    for start in range(0, len(queries), QUERIES):
        rows = slice(start, min(start + QUERIES, len(queries)))
        alive = np.arange(len(ids))
        able = query_ids[rows, None] != ids[None, :]
        score = np.zeros((rows.stop - start, len(ids)))
        bar = best.bar(rows)[:, None]
        for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            score += queries[rows, a:b] @ columns[a:b, alive]
            if b == width:
                break
            reach = score + (rest_q[n + 1][rows, None] * rest_c[n + 1][None, alive]) * (1 + 1e-9) + 1e-6
            able &= reach >= bar
            stay = able.any(0)
            if stay.mean() < 0.8:
                alive, score, able = alive[stay], score[:, stay], able[:, stay]
            if not len(alive):
                break
        best.add(rows, ids[alive], score, able)


def query_blocks(rows: DataFrame, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Query vectors in blocks of at most `most` bytes."""
    ids, held, size = [], [], 0
    for row in rows.toLocalIterator():
        if row[0] is None or row[1] is None or any(x is None or not np.isfinite(x) for x in row[1]):
            continue
        ids.append(row[0])
        held.append(scaled(np.array(row[1], np.float64)))
        size += 8 * len(row[1])
        if size >= most:
            yield np.array(ids, np.int64), _stacked(held)
            ids, held, size = [], [], 0
    if ids:
        yield np.array(ids, np.int64), _stacked(held)


def _stacked(rows: list[np.ndarray]) -> np.ndarray:
    width = max(map(len, rows))
    return np.stack([np.pad(r, (0, width - len(r))) for r in rows])


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, id_column: str = "vec_id", column: str = "embedding",
          most: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query, ties to smaller ids."""
    spark = candidates.sparkSession
    rows = candidates.select(F.col(id_column).alias("vec_id"), F.col(column).alias("embedding"))
    found, before = [], 0
    for ids, block in query_blocks(queries.select(id_column, column), most):
        found.append(_pass(spark, rows, ids, block, before, k))
        before += len(ids)
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    near = found[0]
    for one in found[1:]:
        near = near.unionByName(one)
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _pass(spark: SparkSession, rows: DataFrame, ids: np.ndarray, block: np.ndarray, before: int, k: int) -> DataFrame:
    sent = spark.sparkContext.broadcast((ids, block))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = sent.value
        best = Best(len(query_ids), k)
        for batch in batches:
            own, values = vectors(batch, "vec_id", "embedding")
            width = max(queries.shape[1], values.shape[1])
            for start in range(0, len(own), CANDIDATES):
                part = slice(start, start + CANDIDATES)
                search_block(best, query_ids, _fit(queries, width), own[part], _fit(values[part], width))
        q, place = np.nonzero(np.arange(k) < best.found[:, None])
        yield pa.RecordBatch.from_arrays(
            [pa.array(q + before), pa.array(query_ids[q]), pa.array(best.id[q, place]), pa.array(best.score[q, place])],
            ["number", "query_id", "vec_id", "score"])

    return rows.mapInArrow(work, "number bigint, query_id bigint, vec_id bigint, score bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.filter("vec_id % 100 = 0"))
