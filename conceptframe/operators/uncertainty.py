"""Uncertainty and controls of networks of concept columns, from sums that groups of rows leave behind."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptframe.functions.hashing import NUL
from conceptframe.operators import geometry
from conceptframe.operators.checks import refused_if
from conceptframe.operators.ordering import hash_positions
from conceptframe.operators.resample import REPLICATES, group_weights, numbered_groups
from conceptframe.session import written

SALTS = 16  # parts in which the rows of a group are added up
AT_ONCE = 100  # replicates whose moments one task holds
MIN_VALID = 0.8
FIELDS = ("sums", "products", "least", "most")


class Moments:
    """Row count, column sums, products (upper triangle), smallest and largest values; with weights they add up."""

    def __init__(self, width: int, replicates: int = 1):
        i, _ = np.triu_indices(width)
        self.n = np.zeros(replicates)
        self.sums, self.products = np.zeros((replicates, width)), np.zeros((replicates, len(i)))
        self.least, self.most = np.full((replicates, width), np.inf), np.full((replicates, width), -np.inf)

    def add_rows(self, x: np.ndarray) -> None:
        self.n += len(x)
        self.sums += x.sum(0)
        self.products += (x.T @ x)[np.triu_indices(x.shape[1])]
        self.least, self.most = np.minimum(self.least, x.min(0)), np.maximum(self.most, x.max(0))

    def add(self, at: np.ndarray, weight: np.ndarray, n: float, sums, products, least, most) -> None:
        self.n[at] += weight * n
        self.sums[at] += weight[:, None] * np.asarray(sums)
        self.products[at] += weight[:, None] * np.asarray(products)
        self.least[at], self.most[at] = np.minimum(self.least[at], least), np.maximum(self.most[at], most)

    def rows(self, keys: Sequence, kind: pa.DataType, name: str, some: np.ndarray) -> pa.RecordBatch:
        lists = [pa.array(getattr(self, f)[some].tolist(), pa.list_(pa.float64())) for f in FIELDS]
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(self.n[some]), *lists], [name, "n", *FIELDS])


LAYOUT = "n double, sums array<double>, products array<double>, least array<double>, most array<double>"


def group_moments(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, moments) of each group's vectors; a hot group is added up in `SALTS` parts first."""
    kind = rows.schema[group].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            keys, lists = batch.column("_g").to_pylist(), batch.column("_v")
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            if lists.null_count or len(x) % len(lists) or not np.isfinite(x).all():
                raise ValueError("Vectors must be finite and of one length.")
            x = x.reshape(len(lists), -1)
            heads = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for a, b in zip(heads[:-1], heads[1:]):
                if held is None or keys[a] != now:
                    if held is not None:
                        yield held.rows([now], batch.schema.field("_g").type, "g", np.array([0]))
                    now, held = keys[a], Moments(x.shape[1])
                held.add_rows(x[a:b])
        if held is not None:
            yield held.rows([now], batch.schema.field("_g").type, "g", np.array([0]))

    salted = rows.select(F.col(group).alias("_g"), F.col(vector).alias("_v")).withColumn("_salt", F.pmod(F.xxhash64(F.col("_v")) + F.monotonically_increasing_id(), F.lit(SALTS)))
    parts = salted.repartition("_g", "_salt").sortWithinPartitions("_g").drop("_salt").mapInArrow(work, f"g {kind}, {LAYOUT}")
    return _merged(parts, "g", kind).withColumnRenamed("g", group)


def _merged(parts: DataFrame, key: str, kind: str) -> DataFrame:
    """Moments with equal keys added up, a key's rows one after the other."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, type_ = None, None, None
        for batch in batches:
            type_ = batch.schema.field(key).type
            for row in batch.to_pylist():
                if held is None or row[key] != now:
                    if held is not None:
                        yield held.rows([now], type_, key, np.array([0]))
                    now, held = row[key], Moments(len(row["sums"]))
                held.add(np.array([0]), np.ones(1), row["n"], *[row[f] for f in FIELDS])
        if held is not None:
            yield held.rows([now], type_, key, np.array([0]))

    return parts.repartition(key).sortWithinPartitions(key).mapInArrow(work, f"{key} {kind}, {LAYOUT}")


def replicate_moments(groups: DataFrame, group: str, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """(replicate, moments) of whole groups drawn with replacement; replicate -1 is the data itself."""
    numbered = written(numbered_groups(groups, group), "group-moments")
    count = numbered.count()
    if count < 2:
        raise ValueError("A group bootstrap needs at least two groups.")
    chunk = F.expr(f"replicate div {AT_ONCE}")
    drawn = group_weights(groups.sparkSession, count, replicates, seed)
    point = numbered.select(F.lit(-1).cast("bigint").alias("replicate"), "_number", F.lit(1).cast("bigint").alias("weight"))
    packed = drawn.unionByName(point).groupBy("_number", F.when(F.col("replicate") < 0, -1).otherwise(chunk).cast("int").alias("_chunk")).agg(
        F.collect_list("replicate").alias("_at"), F.collect_list("weight").alias("_weight"))
    dealt = packed.join(numbered.drop(group), "_number").withColumn("_salt", F.pmod(F.xxhash64("_number"), F.lit(SALTS)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if held is None or row["_chunk"] != now:
                    if held is not None:
                        yield _chunk_rows(held, now)
                    now, held = row["_chunk"], Moments(len(row["sums"]), AT_ONCE)
                at = np.array(row["_at"]) - now * AT_ONCE if now >= 0 else np.zeros(1, int)
                held.add(at, np.array(row["_weight"], float), row["n"], *[row[f] for f in FIELDS])
        if held is not None:
            yield _chunk_rows(held, now)

    parts = dealt.repartition("_chunk", "_salt").sortWithinPartitions("_chunk").mapInArrow(work, f"replicate bigint, {LAYOUT}")
    return _merged(parts, "replicate", "bigint")


def _chunk_rows(held: Moments, chunk: int) -> pa.RecordBatch:
    some = np.flatnonzero(held.n > 0)
    return held.rows((some + chunk * AT_ONCE if chunk >= 0 else some - 1).tolist(), pa.int64(), "replicate", some)


def edges_of(n: float, sums: np.ndarray, products: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray | None:
    """Correlations of all pairs of columns i < j; None if a column is constant."""
    if (least == most).any():
        return None
    width = len(sums)
    i, j = np.triu_indices(width)
    cov = np.zeros((width, width))
    cov[i, j] = products - sums[i] * sums[j] / n
    spread = np.sqrt(np.diag(cov))
    if not (spread > 0).all():
        return None
    i, j = np.triu_indices(width, 1)
    return np.clip(cov[i, j] / (spread[i] * spread[j]), -1, 1)


def rank_correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    """Spearman with mid-ranks; None if a side is constant."""
    def ranks(v: np.ndarray) -> np.ndarray:
        _, inverse, counts = np.unique(v, return_inverse=True, return_counts=True)
        ends = np.cumsum(counts)
        return (ends - (counts - 1) / 2)[inverse] - (len(v) + 1) / 2
    a, b = ranks(x), ranks(y)
    size = float(np.sqrt((a @ a) * (b @ b)))
    return float(a @ b) / size if size > 0 else None


def strongest(edges: np.ndarray, top: int) -> np.ndarray:
    """Numbers of the largest edges by size that are not 0, ties in order."""
    order = np.argsort(-np.abs(edges), kind="stable")
    return order[edges[order] != 0][:top]


def centred(rows: DataFrame, vector: str) -> DataFrame:
    """Vectors less their column means, so that moments lose no digits."""
    means = rows.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()  # one row a column
    return rows.withColumn(vector, F.zip_with(vector, F.array(*[F.lit(r.m) for r in means]), lambda x, m: x - m)) if means else rows


def edge_bootstrap(rows: DataFrame, group: str, vector: str, reference: str, replicates: int = REPLICATES, top: int = 20, seed: int = 42, min_valid: float = MIN_VALID) -> tuple[DataFrame, DataFrame]:
    """Edges of the network of `vector` with intervals and how often each is among the strongest; a summary of one row.

    Whole groups are drawn; replicates are weighted sums of the groups' moments. The summary compares every
    replicate with the network of `reference` (another vector of the same columns and rows) by the Spearman
    correlation of edges. Replicates with a constant column in either network are left out and counted;
    fewer than `min_valid` of them valid stop the job.
    """
    both = rows.select(group, F.col(vector).cast("array<double>").alias("_a"), F.col(reference).cast("array<double>").alias("_b"))
    moments = [replicate_moments(group_moments(centred(both, side), group, side), group, replicates, seed) for side in ("_a", "_b")]
    pair = moments[0].join(moments[1].withColumnsRenamed({c: f"{c}_b" for c in ("n", *FIELDS)}), "replicate")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                a, b = (edges_of(row["n"], *[np.array(row[f + s]) for f in FIELDS]) for s in ("", "_b"))
                rho = rank_correlation(a, b) if a is not None and b is not None else None
                good = rho is not None
                out.append({"replicate": row["replicate"], "rho": rho, "weights": a.tolist() if good else None, "top": strongest(a, top).tolist() if good else None, "width": len(row["sums"])})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("replicate", pa.int64()), ("rho", pa.float64()), ("weights", pa.list_(pa.float64())), ("top", pa.list_(pa.int32())), ("width", pa.int32())]))

    drawn = written(pair.mapInArrow(work, "replicate bigint, rho double, weights array<double>, top array<int>, width int"), "replicates")
    is_draw, good = F.col("replicate") >= 0, F.col("rho").isNotNull()
    rho = F.when(is_draw, F.col("rho"))
    summary = drawn.agg(F.max(F.when(~is_draw, F.col("rho"))).alias("edge_weight_spearman"), F.percentile(rho, F.lit(0.025)).alias("ci_lower"), F.percentile(rho, F.lit(0.975)).alias("ci_upper"),
                        F.count(rho).alias("valid"))
    few = F.col("valid") < min_valid * replicates
    summary = summary.withColumn("valid", refused_if(few, "Too few valid replicates; uncertainty is not identifiable", F.col("valid"))).withColumn("invalid", replicates - F.col("valid"))
    width = drawn.select(F.max("width")).first()[0]
    i, j = np.triu_indices(width, 1)
    named = rows.sparkSession.createDataFrame(pa.table({"edge": pa.array(range(len(i)), pa.int32()), "a": pa.array(i, pa.int32()), "b": pa.array(j, pa.int32())}))
    each = drawn.filter(good).select("replicate", "top", F.posexplode("weights").alias("edge", "weight"))
    draw = F.when(is_draw, F.col("weight"))
    edges = each.groupBy("edge").agg(F.max(F.when(~is_draw, F.col("weight"))).alias("weight"), F.percentile(draw, F.lit(0.025)).alias("ci_lower"), F.percentile(draw, F.lit(0.975)).alias("ci_upper"),
                                     (F.count_if(is_draw & F.array_contains("top", F.col("edge"))) / F.count(draw)).alias("top_frequency"), F.count(draw).alias("_valid"))
    edges = edges.withColumn("weight", refused_if(F.col("_valid") < min_valid * replicates, "Too few valid replicates; uncertainty is not identifiable", F.col("weight")))
    return named.join(edges, "edge").select("a", "b", "weight", "ci_lower", "ci_upper", "top_frequency"), summary


# --- controls ----------------------------------------------------------------------------------

BUCKET_BYTES = 4 << 20
FACTOR_BITS = 20


def _drawn(seed: int, *parts: object) -> int:
    return int(hashlib.sha256(NUL.join(map(str, (seed, *parts))).encode()).hexdigest()[:15], 16)


def column_maps(columns: int, rows: int, seed: int = 42, common: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Factor and shift of each column's permutation p -> (factor p + shift) mod rows of row numbers."""
    factors, shifts = [], []
    for j in range(columns):
        who = 0 if common else j
        factor = _drawn(seed, "factor", who) % (1 << FACTOR_BITS) + 1
        while gcd(factor, rows) > 1:
            factor += 1
        factors.append(factor)
        shifts.append(_drawn(seed, "shift", who) % rows)
    return np.array(factors, np.int64), np.array(shifts, np.int64)


def column_null(rows: DataFrame, key: str, vector: str, seed: int = 42, common: bool = False) -> DataFrame:
    """(key, vector) with every column shuffled on its own, or (`common`) all columns alike.

    Rows are numbered once, in digest order of their keys, and a column's permutation is arithmetic on these
    numbers: a value's new place is computed, not looked up. Values travel packed by the bucket of rows that
    they go to, never as a row each. Keys must be unique; vectors of one length, without NULL.
    """
    text = rows.select(F.col(key).cast("string").alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    placed = hash_positions(text.withColumn("_h", F.sha2("_id", 256)), "_h", "_p").select("_id", "_v", (F.col("_p") - 1).alias("_p"))
    held = written(placed, "numbered-rows")
    count, width = held.agg(F.count("*"), F.max(F.size("_v"))).first()
    if not count:
        return rows.select(key, F.col(vector).cast("array<double>").alias(vector))
    factors, shifts = column_maps(width, count, seed, common)
    size = max(1, BUCKET_BYTES // (8 * max(width, 1)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, ids = batch.column("_p").to_numpy(), batch.column("_id")
            x = batch.column("_v").flatten().to_numpy(zero_copy_only=False)
            if batch.column("_v").null_count or len(x) != len(place) * width or np.isnan(x).any():
                raise ValueError("Vectors must be whole and of one length.")
            to = ((place[:, None] * factors[None, :] + shifts[None, :]) % count).ravel()
            column = np.tile(np.arange(width, dtype=np.int32), len(place))
            order = np.argsort(to // size, kind="stable")
            to, column, x = to[order], column[order], x[order]
            cuts = np.flatnonzero(np.diff(to // size)) + 1
            packs = [(int(t[0] // size), (t % size).astype(np.int32).tobytes(), c.tobytes(), v.tobytes(), None) for t, c, v in zip(*(np.split(a, cuts) for a in (to, column, x))) if len(t)]
            own = np.argsort(place // size, kind="stable")
            for part in np.split(own, np.flatnonzero(np.diff(place[own] // size)) + 1):
                packs.append((int(place[part[0]] // size), (place[part] % size).astype(np.int32).tobytes(), None, None, ids.take(pa.array(part)).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*packs), (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string())))],
                                             ["bucket", "at", "column", "x", "ids"])

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, values, ids = None, None, None

        def done() -> pa.RecordBatch:
            ends = np.arange(0, values.size + 1, width, dtype=np.int32) if width else np.zeros(len(ids) + 1, np.int32)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))], ["_id", "_v"])

        for batch in batches:
            buckets, places, columns, xs, names = (batch.column(c) for c in ("bucket", "at", "column", "x", "ids"))
            for t in range(batch.num_rows):  # one pack at a time, read where it lies
                if buckets[t].as_py() != now:
                    if now is not None:
                        yield done()
                    now = buckets[t].as_py()
                    rows_here = min(size, count - now * size)
                    values, ids = np.zeros((rows_here, width)), [None] * rows_here
                at = np.frombuffer(places[t].as_buffer(), np.int32)
                if names[t].is_valid:
                    for p, i in zip(at.tolist(), names[t].as_py()):
                        ids[p] = i
                else:
                    values[at, np.frombuffer(columns[t].as_buffer(), np.int32)] = np.frombuffer(xs[t].as_buffer())
        if now is not None:
            yield done()

    sent = held.mapInArrow(send, "bucket bigint, at binary, column binary, x binary, ids array<string>")
    back = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(receive, "_id string, _v array<double>")
    return back.select(F.col("_id").cast(rows.schema[key].dataType).alias(key), F.col("_v").alias(vector))


def common_row_check(rows: DataFrame, key: str, vector: str, seed: int = 42, tolerance: float = 1e-12) -> DataFrame:
    """(edges, max_error, ok): one permutation for all columns must leave every correlation as it is."""
    own, moved = (geometry.concept_network(df, vector).select("a", "b", F.col("weight").alias(w)) for df, w in (
        (centred(rows, vector), "_w"), (centred(column_null(rows, key, vector, seed, common=True), vector), "_m")))
    both = own.join(moved, ["a", "b"], "full_outer")
    wrong = F.coalesce(F.abs(F.col("_w") - F.col("_m")), F.when(F.col("_w").isNull() & F.col("_m").isNull(), 0.0).otherwise(float("inf")))
    return both.agg(F.count("*").alias("edges"), F.max(wrong).alias("max_error")).withColumn("ok", F.col("max_error") <= tolerance)
