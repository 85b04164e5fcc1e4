"""Graph of nearest materials: exact k nearest neighbours under Euclidean distance, by pivots.

Every material belongs to the cell of its nearest pivot and, inside it, to a ring of distances to that
pivot; rings are cut into chunks of bounded size by a digest. Each chunk first finds neighbours inside
itself, which bounds how far any of its members has to look. By the triangle inequality a unit (one ring
of one cell) can only hold neighbours of another if their distance can be that small; only chunks of such
units meet. Each meeting sends what is within a material's bound, k rows at most, and the nearest k are
taken of those. The table of all distances is never formed.

Equal vectors are folded first: of more than k + 1 copies only the k + 1 smallest ids can be anybody's
neighbours, so the others never meet a chunk, and their own neighbours are the k smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptframe.operators.checks import refuse_rows
from conceptframe.schema import Refused
from conceptframe.session import written

#: Pivots and rings of a cell, and members of a chunk, at most. There are no more units than full chunks, since
#: every unit that cannot be ruled out is a meeting; the table of units is PIVOTS * RINGS rows at most. What the
#: meetings move shrinks with the size of a chunk; few materials are still cut into CHUNKS parts.
PIVOTS, RINGS, CHUNK, CHUNKS = 64, 8, 16384, 16
UNIT = ["cell", "ring"]
#: Allowance for rounding where bounds are compared, relative to the lengths involved.
SLACK = 1e-9


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


def _packed(x: np.ndarray) -> bytes:
    """Bytes of a matrix, in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return (small if np.array_equal(small, x) else x).tobytes()


def _unpacked(data: bytes, rows: int, width: int) -> np.ndarray:
    kind = np.float32 if len(data) == 4 * rows * width else np.float64
    return np.frombuffer(data, kind).reshape(rows, width).astype(float)


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(-1))


def _nearest(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int, bounds: np.ndarray
             ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of x: the k nearest rows of y within its bound, other than itself, ties to smaller ids."""
    sx, sy = (x * x).sum(1), (y * y).sum(1)
    slack = SLACK * (sx.max(initial=0) + sy.max(initial=0))
    step = max(16, (1 << 21) // max(1, len(y)))  # distances held at once
    for start in range(0, len(x), step):
        part = slice(start, start + step)
        near = sx[part, None] + sy[None] - 2 * x[part] @ y.T
        if len(y) > k + 1:  # one of them may be the row itself
            reach = np.partition(near, k, axis=1)[:, k]
        else:
            reach = np.full(len(near), np.inf)
        reach = np.minimum(reach, bounds[part] ** 2 * (1 + SLACK)) + 2 * slack
        for i in range(len(near)):
            at = np.flatnonzero(near[i] <= reach[i])
            at = at[others[at] != ids[start + i]]
            far = _between(y[at], x[start + i])
            best = np.lexsort((others[at], far))[:k]
            yield start + i, at[best], far[best]


def _assigned(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Cell and distance to its pivot."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector")) if batch.num_rows else np.zeros((0, pivots.shape[1]))
            if x.shape[1] != pivots.shape[1]:
                raise ValueError("Vectors must be of one length.")
            far = np.stack([_between(x, p) for p in pivots], 1)
            cell = far.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("sample_id"), batch.column("vector"), pa.array(cell, pa.int32()), pa.array(far[np.arange(len(x)), cell])],
                                             ["sample_id", "vector", "cell", "away"])

    return rows.mapInArrow(work, "sample_id string, vector array<double>, cell int, away double")


def _chunks(rows: DataFrame, k: int, rings: int, chunk: int) -> DataFrame:
    """One row for each chunk: ids and vectors, its range of distances to the pivot, and what bounds its members' search."""
    cuts = rows.groupBy("cell").agg(F.percentile_approx("away", F.lit([i / rings for i in range(1, rings + 1)])).alias("cuts"))
    ringed = rows.join(F.broadcast(cuts), "cell").withColumn("ring", F.size(F.filter(F.slice("cuts", 1, rings - 1), lambda c: c < F.col("away")))).drop("cuts")
    sizes = ringed.groupBy(*UNIT).agg(F.ceil(F.count("*") / chunk).alias("parts"))
    dealt = ringed.join(F.broadcast(sizes), UNIT).withColumn("part", F.pmod(F.xxhash64("sample_id"), F.col("parts"))).drop("parts")

    def pack(table: pa.Table) -> pa.Table:
        ids = np.array(table.column("sample_id").to_pylist(), object)
        x = _matrix(table.column("vector").combine_chunks())
        bounds = np.full(len(ids), np.inf)
        if len(ids) > k:
            for i, _, far in _nearest(ids, x, ids, x, k, bounds.copy()):
                bounds[i] = far[-1]
        away = table.column("away").to_numpy()
        return pa.table({"cell": table.column("cell").slice(0, 1), "ring": table.column("ring").slice(0, 1), "part": table.column("part").slice(0, 1), "low": [away.min()], "high": [away.max()],
                         "bound": [bounds.max()], "ids": pa.array([ids.tolist()], pa.list_(pa.string())), "data": [_packed(x)], "bounds": [bounds.tobytes()]})

    return dealt.groupBy(*UNIT, "part").applyInArrow(pack, "cell int, ring int, part bigint, low double, high double, bound double, ids array<string>, data binary, bounds binary")


def _meetings(units: pd.DataFrame, pivots: np.ndarray) -> pd.DataFrame:
    """Pairs of units of which the second can hold neighbours of the first."""
    cell = units["cell"].to_numpy()
    low, high, bound = (units[c].to_numpy() for c in ("low", "high", "bound"))
    found = []
    for i in range(len(units)):
        apart = _between(pivots[cell], pivots[cell[i]])
        least = np.maximum.reduce([apart - high[i] - high, low - apart - high[i], low[i] - apart - high, np.zeros(len(units))])
        meets = np.flatnonzero(least <= bound[i] + SLACK * (1 + apart + high + high[i]))
        found.append(pd.DataFrame({"cell": cell[i], "ring": units["ring"].iloc[i], "to_cell": cell[meets], "to_ring": units["ring"].to_numpy()[meets]}))
    return pd.concat(found, ignore_index=True).astype("int32")


def nearest_neighbours(rows: DataFrame, k: int = 5, *, pivots: int = PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """(sample_id, neighbour, distance) of (sample_id, vector): min(k, n - 1) rows for each material, ties to smaller ids.

    Ids are unique strings; a null id, a null or non-finite component or vectors of several lengths are refused.
    """
    if not isinstance(k, int) or k < 1:
        raise Refused("k must be a positive whole number.")
    spark = rows.sparkSession
    rows = rows.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("vector").cast("array<double>").alias("vector"))
    wrong = F.col("sample_id").isNull() | F.col("vector").isNull() | F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    refuse_rows(rows.filter(wrong), "materials without id or with missing scores")
    # an array keeps -0.0 apart from 0.0; adding zero does not
    rows = rows.withColumn("vector", F.transform("vector", lambda v: v + F.lit(0.0)))
    place = F.row_number().over(W.partitionBy("vector").orderBy("sample_id"))
    first = written(rows.withColumn("_place", place).filter(F.col("_place") <= k + 1).drop("_place"), "firsts")
    materials = first.count()
    chunk = min(chunk, max(1024, -(-materials // CHUNKS)))
    units = max(1, materials // chunk)
    pivots = min(pivots, units)
    chosen = first.orderBy(F.sha2("sample_id", 256), "sample_id").limit(pivots).select("vector").collect()
    if not chosen:
        return spark.createDataFrame([], "sample_id string, neighbour string, distance double")
    middle = np.array([r["vector"] for r in chosen], float).reshape(len(chosen), -1)
    width = middle.shape[1]

    packed = written(_chunks(_assigned(first, middle), k, min(RINGS, -(-units // pivots)), chunk), "chunks")
    units = packed.groupBy(*UNIT).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("bound").alias("bound")).toPandas()
    pairs = spark.createDataFrame(_meetings(units, middle))
    other = packed.select(F.col("cell").alias("to_cell"), F.col("ring").alias("to_ring"), F.col("part").alias("to_part"), F.col("ids").alias("to_ids"), F.col("data").alias("to_data"))
    keys = packed.select(*UNIT, "part")
    tiles = (keys.join(pairs, UNIT).join(other.select("to_cell", "to_ring", "to_part"), ["to_cell", "to_ring"])
             .join(packed.select(*UNIT, "part", "ids", "data", "bounds"), [*UNIT, "part"]).join(other, ["to_cell", "to_ring", "to_part"])
             .select("ids", "data", "bounds", "to_ids", "to_data"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in range(batch.num_rows):
                tile = {c: batch.column(c)[t].as_py() for c in ("ids", "data", "bounds", "to_ids", "to_data")}
                ids, others = np.array(tile["ids"], object), np.array(tile["to_ids"], object)
                x, y = (_unpacked(tile[d], len(i), width) for d, i in (("data", ids), ("to_data", others)))
                found = list(_nearest(ids, x, others, y, k, np.frombuffer(tile["bounds"])))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids[[i for i, *_ in found]], [len(at) for _, at, _ in found]), pa.string()),
                         pa.array(others[np.concatenate([at for _, at, _ in found])], pa.string()), pa.array(np.concatenate([far for *_, far in found]))],
                        ["sample_id", "neighbour", "distance"])

    near = tiles.mapInArrow(search, "sample_id string, neighbour string, distance double")
    rank = F.row_number().over(W.partitionBy("sample_id").orderBy("distance", "neighbour"))
    near = near.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")
    # further copies of a vector: their neighbours are the k smallest ids that have it
    heads = (first.groupBy("vector").agg(F.array_sort(F.collect_list("sample_id")).alias("heads")).filter(F.size("heads") > k))
    surplus = (rows.join(heads, "vector").filter(~F.array_contains("heads", F.col("sample_id")))
               .select("sample_id", F.explode(F.slice("heads", 1, k)).alias("neighbour"), F.lit(0.0).alias("distance")))
    return near.unionByName(surplus)


def sample_distance_graph(rows: DataFrame, k: int = 5, **options: int) -> DataFrame:
    """(source, target, distance): pairs of which one is among the k nearest of the other, source < target."""
    near = nearest_neighbours(rows, k, **options)
    return (near.select(F.least("sample_id", "neighbour").alias("source"), F.greatest("sample_id", "neighbour").alias("target"), "distance")
            .groupBy("source", "target").agg(F.min("distance").alias("distance")))
