"""Logistic probes of many labels and penalties at once, by Newton steps on sums that tasks send back."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptframe.operators import geometry, metrics
from conceptframe.schema import Refused

GRID = (0.01, 0.1, 1.0, 10.0)  # fixed: the reference's grid of inverse penalties for logistic probes
STEPS, CLOSE = 100, 1e-10


@dataclass
class LogisticProbe:
    """Weights and biases on the raw columns, one for each label; constant labels have their value instead."""

    labels: list[str]
    weights: np.ndarray
    biases: np.ndarray
    constants: dict[str, float]
    penalty: float
    dev_score: float | None = None
    trials: tuple[tuple[float, float], ...] = ()

    def score(self, vector: str, label: str) -> Column:
        if label in self.constants:
            return F.lit(self.constants[label])
        k = self.labels.index(label)
        return 1 / (1 + F.exp(-geometry.projected(F.col(vector), self.weights[k], float(self.biases[k]))))

    def predict(self, rows: DataFrame, vector: str, prefix: str = "p_") -> DataFrame:
        return rows.withColumns({f"{prefix}{name}": self.score(vector, name) for name in self.labels})


def _sums(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, models: Sequence[tuple[int, np.ndarray]]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Loss, gradient and Hessian of each model (label, weights with the bias last), added up by every task."""
    width = len(mean) + 1
    i, j = np.triu_indices(width)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(models), 1 + width + len(i)))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, width - 1)
            y = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            x = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
            for row, (label, w) in zip(total, models):
                z, own = x @ w, y[:, label]
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                row[0] += (np.logaddexp(0, z) - own * z).sum()
                row[1:1 + width] += x.T @ (p - own)
                row[1 + width:] += ((x * (p * (1 - p))[:, None]).T @ x)[i, j]
        m, at = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(m.ravel(), pa.int32()), pa.array(at.ravel(), pa.int32()), pa.array(total.ravel())], ["m", "i", "v"])

    held = rows.mapInArrow(work, "m int, i int, v double").groupBy("m", "i").agg(F.sum("v").alias("v")).toPandas()  # models times columns squared
    table = np.zeros((len(models), 1 + width + len(i)))
    table[held["m"], held["i"]] = held["v"]
    out = {}
    for k, row in enumerate(table):
        hessian = np.zeros((width, width))
        hessian[i, j] = hessian[j, i] = row[1 + width:]
        out[k] = (float(row[0]), row[1:1 + width], hessian)
    return out


def fit_logistic(train: DataFrame, vector: str, labels: Sequence[str], grid: Sequence[float] = GRID, dev: DataFrame | None = None) -> LogisticProbe:
    """Independent L2 logistic models on columns standardised by the training rows alone.

    All labels and penalties take their Newton steps together: a step is one pass, in which every task adds
    up losses, gradients and Hessians; a step that does not lower its loss is halved. The bias is not held
    back. With `dev` (rows that are never fitted) the inverse penalty with the highest macro average
    precision there is taken, ties to the first; without, the first. Labels other than 0 and 1 stop the job.
    """
    if not grid or any(not np.isfinite(c) or c <= 0 for c in grid):
        raise Refused("Penalties must be positive numbers.")
    counts = train.agg(F.count("*").alias("n"), *[F.sum(F.col(c)).alias(f"s{k}") for k, c in enumerate(labels)], *[F.count_if(~F.coalesce(F.col(c).isin(0, 1), F.lit(False))).alias(f"b{k}") for k, c in enumerate(labels)]).first()
    if not counts["n"] or any(counts[f"b{k}"] for k in range(len(labels))):
        raise Refused("Logistic probes take rows with labels of 0 and 1.")
    mean, cov, n = geometry.covariance(train, vector)
    scale = np.sqrt(np.diag(cov) * (n - 1) / n)
    scale = np.where(scale > 0, scale, 1.0)
    constants = {c: float(counts[f"s{k}"] > 0) for k, c in enumerate(labels) if counts[f"s{k}"] in (0, n)}
    models = [(k, c) for c in grid for k, name in enumerate(labels) if name not in constants]
    rows = train.select(F.col(vector).cast("array<double>"), F.array(*[F.col(c).cast("double") for c in labels]))
    width = len(mean) + 1
    hold = np.append(np.ones(width - 1), 0.0)
    at, step, tries = (np.zeros((len(models), width)) for _ in range(3))
    loss, moving = np.full(len(models), np.inf), list(range(len(models)))
    for _ in range(STEPS):
        if not moving:
            break
        found = _sums(rows, mean, scale, [(models[m][0], tries[m]) for m in moving])
        for n_, m in enumerate(list(moving)):
            c = models[m][1]
            f, g, h = found[n_]
            value = c * f + (hold * tries[m] ** 2).sum() / 2
            if value <= loss[m] + 1e-12 * abs(value):
                at[m], loss[m] = tries[m], value
                step[m] = np.linalg.lstsq(c * h + np.diag(hold), c * g + hold * at[m], rcond=None)[0]
            else:
                step[m] /= 2
            tries[m] = at[m] - step[m]
            if np.abs(step[m]).max() < CLOSE:
                moving.remove(m)
    if moving:
        raise Refused("Logistic probes did not settle.")

    def probe(c: float) -> LogisticProbe:
        weights, biases = np.zeros((len(labels), width - 1)), np.zeros(len(labels))
        for m, (k, own) in enumerate(models):
            if own == c:
                weights[k] = at[m][:-1] / scale
                biases[k] = at[m][-1] - (at[m][:-1] * mean / scale).sum()
        return LogisticProbe(list(labels), weights, biases, constants, float(c))

    probes = [probe(c) for c in grid]
    if dev is None:
        return probes[0]
    cells = F.array(*[F.struct(F.lit(n).alias("k"), F.lit(name).alias("anchor_id"), F.col(name).cast("int").alias("label"), p.score(vector, name).alias("score")) for n, p in enumerate(probes) for name in labels])
    ap = metrics.average_precision(dev.select(F.inline(cells)), ["k", "anchor_id"]).groupBy("k").agg(F.avg("ap").alias("ap")).collect()
    scores = {r.k: r.ap for r in ap}
    if any(scores.get(k) is None for k in range(len(probes))):
        raise Refused("The macro average precision of the development rows is undefined.")
    k = max(range(len(probes)), key=lambda k: (round(scores[k], 12), -k))
    probes[k].dev_score, probes[k].trials = scores[k], tuple((p.penalty, scores[n]) for n, p in enumerate(probes))
    return probes[k]
