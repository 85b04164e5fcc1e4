"""Hard negatives of embedding anchors by Fagin's threshold algorithm.

A task holds its candidates in blocks with one sorted list for each dimension. For an anchor the lists
are gone down together, from the large end where the anchor's component is positive and from the small
end where it is negative. Rows that come into sight for the first time are scored as a whole (random
access, exact integers). The threshold is the score of a row that would have, in every dimension, the
value reached there: no unseen row is better. An anchor is done with a block when the threshold is
strictly below the k-th score of each of its windows, or below the window's lower end, or when all rows
have been seen. What a task has found sets the bars for its next block.

Two rounds: the first finds an anchor's positives (lists of its own label's rows), the second the best
rows of other labels in the window of each positive. A task sends at most `positives` rows an anchor in
the first and `negatives` rows a window in the second; one ranking of those follows. Anchors travel in
blocks of at most `ANCHOR_BYTES` (their number grows with the table, and each block is a pass of its
own that is written before the next is sent).

Components are integers, floor(256 x); scores above the range of a long are held at its end. Vectors
that are null or hold null or non-finite components, rows without label and rows without id take no
part. A shorter vector counts as filled up with zeros. Rows with the anchor's own id are not its
positives; repeated ids are candidates each, and repeated anchor rows are answered each. An anchor
without positives, or a window without rows, gives no rows; an empty table gives none. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conceptframe.llm.shared import kept, spread

NAME = "op11_hard_negatives"
SQL = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""
SCALE, POSITIVES, NEGATIVES = 256, 5, 3
LOW, HIGH = 50, 95  # hundredths of the positive's score
ANCHOR_BYTES = 32 << 20
CANDIDATES, FIRST_STEP = 8192, 16
LONG = (1 << 63) - 1


def components(lists: pa.Array, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite vectors, zero-filled; doubles where exact, Python integers beyond."""
    lengths = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if np.abs(flat).max(initial=0) * scale >= 2.0 ** 53:
        whole = np.array([int(x) * scale if abs(x) >= 2.0 ** 53 else floor(x * scale) for x in flat.tolist()], object)
        out = np.zeros((len(lengths), int(lengths.max(initial=0))), object)
    else:
        whole = np.floor(flat * scale)
        out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - (np.cumsum(lengths) - lengths)[row]] = whole
    return out


def fit(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if a hundred times any score is exact in one, else as Python integers."""
    if a.dtype != object and b.dtype != object and 100 * a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2.0 ** 53:
        return a, b
    whole = lambda x: x if x.dtype == object else np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
    return whole(a), whole(b)


class Lists:
    """Candidates with one list for each dimension, sorted by value."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray):
        self.ids, self.labels, self.values = ids, labels, values

    @cached_property
    def order(self) -> np.ndarray:
        return np.argsort(self.values, axis=0, kind="stable")

    @cached_property
    def sorted(self) -> np.ndarray:
        return np.take_along_axis(self.values, self.order, 0)

    def accessed(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """Rows in the order of first sight, in growing steps, with the threshold after each step."""
        n = len(self.ids)
        live = np.flatnonzero(anchor != 0)
        if not len(live):  # all scores are 0
            yield np.arange(n), -np.inf
            return
        up, weight = anchor[live] > 0, anchor[live]
        unseen, left, depth, step = np.ones(n, bool), n, 0, FIRST_STEP
        while left:
            to = min(n, depth + step)
            rows = np.where(up, self.order[n - to:n - depth][:, live], self.order[depth:to][:, live]).ravel()
            fresh = np.unique(rows[unseen[rows]])
            unseen[fresh] = False
            left -= len(fresh)
            limit = (weight * np.where(up, self.sorted[n - to, live], self.sorted[to - 1, live])).sum()
            yield fresh, limit if left else -np.inf
            depth, step = to, 2 * step


Found = list[tuple[int, int]]  # (-score, id), best first


def merged(found: Found, ids: np.ndarray, scores: np.ndarray, k: int) -> Found:
    """The k best of what was found and of new rows."""
    if len(ids) > 4 * k and scores.dtype != object:
        near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[near], scores[near]
    return sorted([*found, *((-int(s), i) for s, i in zip(scores.tolist(), ids.tolist()))])[:k]


def bar(found: Found, k: int) -> float:
    return -found[-1][0] if len(found) == k else -np.inf


def positives(found: list[Found], anchor_ids: np.ndarray, anchor_labels: np.ndarray, anchors: np.ndarray, block: Lists, k: int) -> None:
    """Adds a block's rows of each anchor's own label."""
    for label in np.unique(block.labels).tolist():
        own = np.flatnonzero(block.labels == label)
        asked = np.flatnonzero(anchor_labels == label)
        if not len(asked):
            continue
        lists = Lists(block.ids[own], block.labels[own], block.values[own])
        for a in asked.tolist():
            for fresh, limit in lists.accessed(anchors[a]):
                scores = lists.values[fresh] @ anchors[a]
                able = (scores >= bar(found[a], k)) & (lists.ids[fresh] != anchor_ids[a])
                if able.any():
                    found[a] = merged(found[a], lists.ids[fresh][able], scores[able], k)
                if limit < bar(found[a], k):
                    break


def negatives(found: list[list[Found]], anchor_labels: np.ndarray, anchors: np.ndarray, targets: list[list[int]], block: Lists, k: int) -> None:
    """Adds a block's rows of other labels to the window of each positive score."""
    for a, scores_of in enumerate(targets):
        windows = [w for w, p in enumerate(scores_of) if LOW * p <= HIGH * p]
        for fresh, limit in block.accessed(anchors[a]) if windows else ():
            scores = block.values[fresh] @ anchors[a]
            other = block.labels[fresh] != anchor_labels[a]
            for w in windows:
                p = scores_of[w]
                able = other & (100 * scores <= HIGH * p) & (100 * scores >= LOW * p) & (scores >= bar(found[a][w], k))
                if able.any():
                    found[a][w] = merged(found[a][w], block.ids[fresh][able], scores[able], k)
            if all(limit < bar(found[a][w], k) or 100 * limit < LOW * scores_of[w] for w in windows):
                break


def _blocks(batches: Iterator[pa.RecordBatch], anchors: np.ndarray) -> Iterator[tuple[np.ndarray, Lists]]:
    """Anchors and candidates in numbers that fit each other; blocks of at most `CANDIDATES` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, CANDIDATES):
            part = batch.slice(start, CANDIDATES)
            values = components(part.column("vector"))
            width = max(values.shape[1], anchors.shape[1])
            own, values = exact(fit(anchors, width), fit(values, width))
            ids, labels = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
            yield own, Lists(ids, labels, values)


def _rows(found: dict[str, list], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found.values(), types)], list(found))


def held(score: int) -> int:
    return max(-LONG - 1, min(LONG, score))


def highest_first() -> list[Column]:
    """Order of scores sent as text: whole numbers of any size, exact up to 38 digits."""
    return [F.desc(F.col("score").cast("double")), F.desc(F.col("score").try_cast("decimal(38,0)"))]


def as_long() -> Column:
    end = F.when(F.col("score").startswith("-"), -LONG - 1).otherwise(LONG)
    return F.coalesce(F.col("score").try_cast("bigint"), end)


def usable(rows: DataFrame, id_column: str, label_column: str, vector_column: str) -> DataFrame:
    """vec_id, label, vector of the rows that take part, dealt evenly and written once, numbered."""
    vector = F.col(vector_column).cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(label_column).cast("bigint").alias("label"), vector.alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad)
    return kept(good.repartition(spread(rows.sparkSession)).withColumn("row", F.monotonically_increasing_id()), "vectors")


def mined(rows: DataFrame, anchor: str = "vec_id % 50 = 0", n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, id_column: str = "vec_id",
          label_column: str = "label", vector_column: str = "embedding", most: int = ANCHOR_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; `anchor` picks anchors by vec_id and label."""
    spark = rows.sparkSession
    table = usable(rows, id_column, label_column, vector_column)
    anchors = table.filter(anchor)
    count, width = anchors.agg(F.count("*"), F.max(F.size("vector"))).first()
    passes = max(1, -(-count * 8 * max(width or 0, 1) // most))
    out = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    for i in range(passes if count else 0):
        block = anchors.filter(F.pmod(F.xxhash64("row"), F.lit(passes)) == i).select("vec_id", "label", "vector").toArrow()
        if block.num_rows:
            part = _pass(spark, table.select("vec_id", "label", "vector"), block.combine_chunks(), n_positives, n_negatives)
            out = out.unionByName(kept(part, "negatives"))
    return out


def _pass(spark: SparkSession, table: DataFrame, block: pa.Table, n_positives: int, n_negatives: int) -> DataFrame:
    ids, labels = block.column("vec_id").to_numpy(), block.column("label").to_numpy()
    values = components(block.column("vector").combine_chunks())
    sent = spark.sparkContext.broadcast((ids, labels, values))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, values = sent.value
        found: list[Found] = [[] for _ in ids]
        for own, lists in _blocks(batches, values):
            positives(found, ids, labels, own, lists, n_positives)
        rows = [(a, i, str(-s)) for a, one in enumerate(found) for s, i in one]
        a, i, s = zip(*rows) if rows else ((), (), ())
        yield _rows({"anchor": a, "positive_id": i, "score": s}, [pa.int32(), pa.int64(), pa.string()])

    best = Window.partitionBy("anchor").orderBy(*highest_first(), "positive_id")
    near = table.mapInArrow(first, "anchor int, positive_id bigint, score string").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= n_positives)
    chosen: list[list[tuple[int, int]]] = [[] for _ in ids]
    for r in near.orderBy("anchor", "n").collect():  # at most n_positives rows for each anchor of the block
        chosen[r.anchor].append((r.positive_id, int(r.score)))
    windows = spark.sparkContext.broadcast(chosen)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, labels, values = sent.value
        chosen = windows.value
        found: list[list[Found]] = [[[] for _ in one] for one in chosen]
        targets = [[p for _, p in one] for one in chosen]
        for own, lists in _blocks(batches, values):
            negatives(found, labels, own, targets, lists, n_negatives)
        rows = [(a, w, i, str(-s)) for a, one in enumerate(found) for w, top in enumerate(one) for s, i in top]
        a, w, i, s = zip(*rows) if rows else ((), (), (), ())
        yield _rows({"anchor": a, "window": w, "negative_id": i, "score": s}, [pa.int32(), pa.int32(), pa.int64(), pa.string()])

    rank = Window.partitionBy("anchor", "window").orderBy(*highest_first(), "negative_id")
    best_rows = table.mapInArrow(second, "anchor int, window int, negative_id bigint, score string").withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= n_negatives)
    names = [(a, w, int(ids[a]), p, held(s)) for a, one in enumerate(chosen) for w, (p, s) in enumerate(one)]
    asked = spark.createDataFrame(pa.table(dict(zip(("anchor", "window", "anchor_id", "positive_id", "positive_score"), zip(*names))), schema=pa.schema(
        [("anchor", pa.int32()), ("window", pa.int32()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())]))) if names else spark.createDataFrame(
        [], "anchor int, window int, anchor_id bigint, positive_id bigint, positive_score bigint")
    return best_rows.join(asked, ["anchor", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
        as_long().alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.select("vec_id", label.alias("label"), "embedding"))
