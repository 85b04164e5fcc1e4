"""Geometry of concept columns from moments: one pass over the materials, then column-sized tables.

The number of columns is the instrument's, not the data's; a table of column pairs is small. Sample
pairs are never formed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptframe.operators import metrics
from conceptframe.operators.checks import refused_if
from conceptframe.schema import Refused

COLUMNS_MOST = 1024
PENALTIES = (0.01, 0.1, 1.0, 10.0, 100.0)  # fixed: the reference's grid for ridge probes


def moments(rows: DataFrame, vector: str, shift: Sequence[float] | None = None) -> DataFrame:
    """(i, j, n, si, sj, sij) for i <= j over vectors of one length; each task adds up its own rows.

    NULL vectors are left out; a NULL or non-finite value, or another length, stops the job. `shift` is
    taken off first (means from an earlier pass, for columns far from zero).
    """
    off = None if shift is None else np.asarray(shift, float)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, count = None, None, 0
        for batch in batches:
            held = batch.column(0).drop_null()
            if not len(held):
                continue
            width = len(held[0])
            flat = held.flatten().to_numpy(zero_copy_only=False).astype(float)
            if len(flat) != width * len(held) or width > COLUMNS_MOST or not np.isfinite(flat).all():
                raise ValueError("Vectors must be finite and of one bounded length.")
            x = flat.reshape(-1, width)
            x = x if off is None else x - off
            if total is None:
                total, sums = np.zeros((width, width)), np.zeros(width)
            total += x.T @ x
            sums += x.sum(0)
            count += len(x)
        if count:
            i, j = np.triu_indices(len(sums))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(i), count)), pa.array(sums[i]), pa.array(sums[j]), pa.array(total[i, j])],
                ["i", "j", "n", "si", "sj", "sij"])

    parts = rows.select(F.col(vector).cast("array<double>")).mapInArrow(work, "i int, j int, n bigint, si double, sj double, sij double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sij")])


def concept_network(rows: DataFrame, vector: str) -> DataFrame:
    """(a, b, weight): Pearson correlation of every pair of columns; NULL if a column is constant."""
    m = moments(rows, vector)
    own = m.filter("i = j").select(F.col("i").alias("k"), (F.col("sij") - F.col("si") * F.col("sj") / F.col("n")).alias("v"))
    a, b = (own.withColumnsRenamed({"k": side, "v": f"v{side}"}) for side in ("i", "j"))
    both = m.filter("i < j").join(a, "i").join(b, "j")
    cov = F.col("sij") - F.col("si") * F.col("sj") / F.col("n")
    ok = (F.col("vi") > 0) & (F.col("vj") > 0)
    return both.select(F.col("i").alias("a"), F.col("j").alias("b"), F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(F.col("vi") * F.col("vj"))))).alias("weight"), "n")


def compare_networks(predicted: DataFrame, reference: DataFrame, top_k: int = 20) -> DataFrame:
    """One row: Spearman of edge weights, Jaccard of the strongest edges, sign agreement of common ones.

    Edges of weight zero are no edges. The networks must have the same pairs of nodes.
    """
    both = metrics.align(predicted.select("a", "b", F.col("weight").alias("p")), reference.select("a", "b", F.col("weight").alias("g")), ["a", "b"], "p", "g")
    rho = metrics.spearman(both, [], "p", "g").select(F.col("spearman").alias("edge_weight_spearman"), F.lit(1).alias("_k"))

    def strongest(side: str) -> DataFrame:
        return both.filter(F.col(side) != 0).orderBy(F.desc(F.abs(side)), "a", "b").limit(top_k).select("a", "b", F.signum(side).alias(f"s{side}"))

    pair = strongest("p").join(strongest("g"), ["a", "b"], "full_outer")
    common = F.col("sp").isNotNull() & F.col("sg").isNotNull()
    top = pair.agg(F.try_divide(F.count_if(common), F.count("*")).alias("top_k_edge_jaccard"),
                   F.avg(F.when(common, (F.col("sp") == F.col("sg")).cast("double"))).alias("common_edge_sign_agreement"), F.lit(1).alias("_k"))
    return rho.join(top, "_k").drop("_k")


def covariance(rows: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, covariance matrix and row count on the driver: columns squared, whatever the rows."""
    held = moments(rows, vector).toPandas()
    if not len(held):
        raise Refused("No vectors.")
    width, n = int(held["j"].max()) + 1, int(held["n"].iloc[0])
    if n < 2:
        raise Refused("A covariance needs two rows.")
    first = held[held["i"] == held["j"]].sort_values("i")
    mean = first["si"].to_numpy() / n
    cov = np.zeros((width, width))
    i, j = held["i"].to_numpy(), held["j"].to_numpy()
    cov[i, j] = cov[j, i] = (held["sij"] - held["si"] * held["sj"] / n) / (n - 1)
    return mean, cov, n


def pca(rows: DataFrame, vector: str, components: int) -> tuple[DataFrame, np.ndarray, np.ndarray, float]:
    """Rows with `components` scores, the axes, their shares of variance and the whole variance.

    Without any variance the shares are NaN. Axes are centred and signed so that the largest part of each is positive.
    """
    mean, cov, _ = covariance(rows, vector)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    axes = axes[:, order].T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    shares = values[order] / values.sum() if values.sum() > 0 else np.full(len(order), np.nan)
    return rows.withColumn("scores", F.array(*[projected(F.col(vector), a, float(-(a @ mean))) for a in axes])), axes, shares, float(values.sum())


def projected(vector: Column, weights: Sequence[float], bias: float = 0.0) -> Column:
    """Inner product with constant weights, on the JVM."""
    terms = F.zip_with(vector, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x.cast("double") * w)
    return F.aggregate(terms, F.lit(float(bias)), lambda s, v: s + v)


def fit_ridge(train: DataFrame, vector: str, label: str, penalties: Sequence[float] = PENALTIES, dev: DataFrame | None = None) -> tuple[np.ndarray, float, float]:
    """Weights, bias and penalty of a ridge probe on standardised columns.

    One pass over the training rows for all penalties; with `dev`, the penalty of least error there (all
    are compared in one pass), else the first.
    """
    joint = train.select(F.array_append(F.col(vector).cast("array<double>"), F.col(label).cast("double")).alias("_v"))
    mean, cov, n = covariance(joint, "_v")
    sd = np.sqrt(np.diag(cov)[:-1])
    live = sd > 0
    scaled = cov[:-1, :-1][np.ix_(live, live)] / np.outer(sd[live], sd[live]) * (n - 1)
    target = cov[:-1, -1][live] / sd[live] * (n - 1)
    fits = []
    for penalty in penalties:
        w = np.zeros(len(sd))
        w[live] = np.linalg.solve(scaled + penalty * np.eye(int(live.sum())), target) / sd[live]
        fits.append((w, float(mean[-1] - w @ mean[:-1]), float(penalty)))
    if dev is None or len(fits) == 1:
        return fits[0]
    errors = dev.agg(*[F.avg((projected(F.col(vector), w, b) - F.col(label)) * (projected(F.col(vector), w, b) - F.col(label))).alias(str(k)) for k, (w, b, _) in enumerate(fits)]).first()
    return fits[int(np.argmin([e if e is not None else np.inf for e in errors]))]


def predict_scores(rows: DataFrame, vector: str, weights: Sequence[float], bias: float, name: str = "prediction") -> DataFrame:
    wrong = F.size(vector) != len(weights)
    return rows.withColumn(name, refused_if(wrong, "A vector has another length than the probe", projected(F.col(vector), weights, bias)))


def kmeans(rows: DataFrame, key: str, vector: str, k: int, rounds: int = 300, seed: int = 42, starts: int = 10,
           settled: bool = True) -> tuple[DataFrame, np.ndarray, float]:
    """Rows with their cluster, the centres and the inertia of the best of several starts.

    The first centres of a start are the different vectors with the smallest digests (of the smallest key
    that has the vector). A round is one pass for all starts: each row finds its centre among k constants,
    each task adds up its own rows, and starts x k sums come back. A start ends when no centre moves; empty
    clusters keep their centre. Ties of inertia go to the earlier start. More than `rounds` rounds stop the
    job rather than give centres that still move; if they need not be `settled`, the centres after that many
    rounds are taken.
    """
    kinds = rows.filter(F.col(vector).isNotNull()).groupBy(F.col(vector).cast("array<double>").alias("_v")).agg(F.min(F.col(key).cast("string")).alias("_key"))
    first = None
    for s in range(starts):
        one = kinds.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed + s)), "_key"), 256), "_key").limit(k).select(F.lit(s).alias("s"), F.lit(seed + s).alias("n"), "_key", "_v")
        first = one if first is None else first.unionByName(one)
    held = first.withColumn("h", F.sha2(F.concat_ws("|", F.col("n").cast("string"), "_key"), 256)).orderBy("s", "h", "_key").collect()
    if len(held) < starts * k:
        raise Refused("Fewer different vectors than clusters.")
    centres = np.array([r["_v"] for r in held], float).reshape(starts, k, -1)
    moving = list(range(starts))
    for _ in range(rounds):
        parts = _cluster_sums(rows, vector, centres[moving]).groupBy("start", "cluster", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toPandas()
        new = centres.copy()
        new[np.array(moving)[parts["start"]], parts["cluster"], parts["i"]] = parts["s"] / parts["n"]
        moving = [s for s in moving if not np.allclose(new[s], centres[s], rtol=0, atol=1e-12)]
        centres = new
        if not moving:
            break
    if moving and settled:
        raise Refused(f"Centres still move after {rounds} rounds.")
    inertia = [r.d for r in _inertia(rows, vector, centres).groupBy("start").agg(F.sum("d").alias("d")).orderBy("start").collect()]
    best = int(np.argmin(inertia))
    return assigned(rows, vector, centres[best]), centres[best], inertia[best]


def assigned(rows: DataFrame, vector: str, centres: np.ndarray) -> DataFrame:
    """Rows with the number of the nearest centre (ties to the smaller number); NULL vectors have none."""
    k, width = centres.shape
    parts = [F.lit(float(c)) for c in centres.ravel()]
    far = [F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.array(*parts[c * width:(c + 1) * width]), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v) for c in range(k)]
    near = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(c).alias("c")) for c, d in enumerate(far)]))
    return rows.withColumn("cluster", F.when(F.col(vector).isNotNull(), near["c"]))


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        held = batch.column(0).drop_null()
        if len(held):
            yield held.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(held), width)


def _cluster_sums(rows: DataFrame, vector: str, centres: np.ndarray) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(centres), np.zeros(centres.shape[:2])
        for x in _matrices(batches, centres.shape[2]):
            for s, own in enumerate(centres):
                near = ((x[:, None, :] - own[None, :, :]) ** 2).sum(2).argmin(1)
                np.add.at(sums[s], near, x)
                counts[s] += np.bincount(near, minlength=len(own))
        s, c, i = np.nonzero(np.repeat(counts[:, :, None] > 0, centres.shape[2], 2))
        yield pa.RecordBatch.from_arrays([*[pa.array(v, pa.int32()) for v in (s, c, i)], pa.array(sums[s, c, i]), pa.array(counts[s, c])], ["start", "cluster", "i", "s", "n"])

    return rows.select(F.col(vector).cast("array<double>")).mapInArrow(work, "start int, cluster int, i int, s double, n double")


def _inertia(rows: DataFrame, vector: str, centres: np.ndarray) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(centres))
        for x in _matrices(batches, centres.shape[2]):
            total += [((x[:, None, :] - own[None, :, :]) ** 2).sum(2).min(1).sum() for own in centres]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres)), pa.int32()), pa.array(total)], ["start", "d"])

    return rows.select(F.col(vector).cast("array<double>")).mapInArrow(work, "start int, d double")
