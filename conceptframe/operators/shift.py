"""How far a target moved between two periods: centroid and energy distance, with whole sources as units.

Distances are never stored by pair of rows. The rows of a target are dealt into blocks; each pair of
blocks is one small group that sends the sums of its distances for every pair of cells, a cell being the
rows of one source in one period. Bootstrap and permutation are then signed weights of cells: every
replicate is a quadratic form of the cell sums, and no replicate touches a row.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptframe.functions.hashing import NUL
from conceptframe.operators import metrics
from conceptframe.operators.checks import refused_if
from conceptframe.operators.resample import REPLICATES
from conceptframe.session import written

BLOCK = 1024  # rows of a block; a group holds two of them
ROWS = 64  # cells whose sums travel together
HALVES = 100


def distance_sums(rows: DataFrame, key: str, cell: str, vector: str) -> DataFrame:
    """(key, a, b, s): sums of Euclidean distances between the rows of two cells, in both orders.

    Pairs of a row with itself are among them. `cell` is an int; vectors must be finite and of one length.
    The work is the square of a key's rows by definition; no group holds more than two blocks of them.
    """
    numbered = rows.select(F.col(key).alias("_k"), F.col(cell).cast("int").alias("_c"), F.col(vector).alias("_v")).withColumn("_row", F.monotonically_increasing_id())
    held = written(numbered, "distance-rows")
    blocks = held.groupBy("_k").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n"))
    placed = held.join(blocks, "_k").withColumn("_b", F.pmod(F.xxhash64("_row"), F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    pairs = placed.withColumn("_o", other).select(
        "_k", F.least("_b", "_o").alias("_lo"), F.greatest("_b", "_o").alias("_hi"), (F.col("_b") > F.col("_o")).alias("_right"), "_c", "_v")
    kind = rows.schema[key].dataType.simpleString()
    sums = pairs.groupBy("_k", "_lo", "_hi").applyInArrow(_block_sums, f"_k {kind}, a int, b int, s double")
    return sums.groupBy(F.col("_k").alias(key), "a", "b").agg(F.sum("s").alias("s"))


def _block_sums(group: pa.Table) -> pa.Table:
    key, lo, hi = (group.column(c)[0] for c in ("_k", "_lo", "_hi"))
    flat = group.column("_v").combine_chunks()
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(x) % len(flat) or flat.null_count or not np.isfinite(x).all() or len(set(flat.value_lengths().to_pylist())) > 1:
        raise ValueError("Vectors must be finite and of one length.")
    x = x.reshape(len(flat), -1)
    cells, right = group.column("_c").to_numpy(), group.column("_right").to_numpy(zero_copy_only=False)
    same = lo.as_py() == hi.as_py()
    left, other = (slice(None), slice(None)) if same else (~right, right)
    (own, at), (far, to) = (np.unique(cells[side], return_inverse=True) for side in (left, other))
    member = np.zeros((len(to), len(far)))
    member[np.arange(len(to)), to] = 1
    sums = np.zeros((len(own), len(far)))
    a, b = x[left], x[other]
    for start in range(0, len(a), 32):
        distance = np.sqrt(((a[start:start + 32, None, :] - b[None, :, :]) ** 2).sum(2))
        np.add.at(sums, at[start:start + 32], distance @ member)
    i, j = (v.ravel() for v in np.indices(sums.shape))
    first, second, total = own[i], far[j], sums.ravel()
    if not same:
        first, second, total = np.concatenate([first, second]), np.concatenate([second, first]), np.concatenate([total, total])
    return pa.table({"_k": pa.array([key.as_py()] * len(total), group.schema.field("_k").type), "a": pa.array(first, pa.int32()), "b": pa.array(second, pa.int32()), "s": pa.array(total)})


def energy_distance(rows: DataFrame, key: str, side: Column, vector: str) -> DataFrame:
    """(key, n_0, n_1, energy_distance) of the rows where `side` is false and true; NULL where one has none.

    Twice the mean distance across, less the mean distance inside each side, pairs of a row with itself
    included; never below 0. NULL sides and vectors are left out.
    """
    used = rows.withColumn("_side", side.cast("int")).filter(F.col("_side").isNotNull() & F.col(vector).isNotNull())
    counts = used.groupBy(key).agg(F.count_if(F.col("_side") == 0).alias("n_0"), F.count_if(F.col("_side") == 1).alias("n_1"))
    sums = distance_sums(used, key, "_side", vector)
    part = lambda a, b: F.coalesce(F.sum(F.when((F.col("a") == a) & (F.col("b") == b), F.col("s"))), F.lit(0.0)).alias(f"s{a}{b}")
    both = counts.join(sums.groupBy(key).agg(part(0, 1), part(0, 0), part(1, 1)), key)
    n, m = F.col("n_0"), F.col("n_1")
    value = 2 * F.col("s01") / (n * m) - F.col("s00") / (n * n) - F.col("s11") / (m * m)
    return both.select(key, "n_0", "n_1", F.when((n > 0) & (m > 0), F.greatest(F.lit(0.0), value)).alias("energy_distance"))


class Plan(NamedTuple):
    """Cells of a target: period 0 first, each period in the order of its sources."""

    target: str
    units: list[str]
    strata: list[str]
    rows: np.ndarray
    first: int  # cells of period 0
    paired: bool

    @property
    def sizes(self) -> tuple[int, int]:
        return self.first, len(self.units) - self.first

    @property
    def enough(self) -> bool:
        return min(self.sizes) >= 2

    @property
    def exchangeable(self) -> bool:
        """A source could have been in the other period: paired, or both periods in a stratum."""
        return self.paired or bool(set(self.strata[:self.first]) & set(self.strata[self.first:]))


def drawn(seed: int, *parts: object) -> str:
    return hashlib.sha256(NUL.join(map(str, (seed, *parts))).encode()).hexdigest()


def signed(plan: Plan, zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Weights of cells for a comparison: shares of rows on one side less shares on the other."""
    return zero / (zero @ plan.rows) - one / (one @ plan.rows)


def observed(plan: Plan) -> np.ndarray:
    place = np.arange(len(plan.units)) < plan.first
    return signed(plan, place.astype(float), (~place).astype(float))


def bootstrap(plan: Plan, r: int, seed: int) -> np.ndarray:
    """Whole sources drawn with replacement, in each period or (paired) for both at once."""
    sides = np.zeros((2, len(plan.units)))
    for side, size in enumerate(plan.sizes):
        picks = [int(drawn(seed, "boot", plan.target, 0 if plan.paired else side, r, k)[:15], 16) % size for k in range(size)]
        sides[side, side * plan.first:side * plan.first + size] = np.bincount(picks, minlength=size)
    return signed(plan, *sides)


def permuted(plan: Plan, r: int, seed: int) -> np.ndarray:
    """Periods dealt anew: by swaps inside sources if paired, else among the sources of each stratum."""
    n, first = len(plan.units), plan.first
    if plan.paired:
        swap = np.array([int(drawn(seed, "perm", plan.target, r, u)[:15], 16) % 2 == 1 for u in plan.units[:first]])
        zero = np.concatenate([~swap, swap]).astype(float)
        return signed(plan, zero, 1 - zero)
    zero = np.zeros(n)
    for stratum in set(plan.strata):
        own = [i for i in range(n) if plan.strata[i] == stratum]
        order = sorted(own, key=lambda i: drawn(seed, "perm", plan.target, r, plan.units[i]))
        zero[order[:sum(i < first for i in own)]] = 1
    return signed(plan, zero, 1 - zero)


def halved(plan: Plan, r: int, side: int, seed: int) -> np.ndarray:
    """The sources of one period in two halves."""
    start, size = side * plan.first, plan.sizes[side]
    order = sorted(range(start, start + size), key=lambda i: drawn(seed, "half", plan.target, side, r, plan.units[i]))
    sides = np.zeros((2, len(plan.units)))
    sides[0, order[:size // 2]] = 1
    sides[1, order[size // 2:]] = 1
    return signed(plan, *sides)


def kinds_of(plan: Plan, replicates: int, permutations: int, halves: int) -> list[str]:
    """What each of a target's weight vectors is for."""
    sure = plan.enough
    return (["point"] + ["boot"] * (replicates * sure) + ["perm"] * (permutations * (sure and plan.exchangeable))
            + ["half0"] * (halves * (plan.sizes[0] >= 2)) + ["half1"] * (halves * (plan.sizes[1] >= 2)))


def weights(plan: Plan, replicates: int, permutations: int, halves: int, seed: int) -> np.ndarray:
    """All weight vectors of a target, in the order of `kinds_of`."""
    make = {"point": lambda r: observed(plan), "boot": lambda r: bootstrap(plan, r, seed), "perm": lambda r: permuted(plan, r, seed),
            "half0": lambda r: halved(plan, r, 0, seed), "half1": lambda r: halved(plan, r, 1, seed)}
    rows, count = [], Counter()
    for kind in kinds_of(plan, replicates, permutations, halves):
        rows.append(make[kind](count[kind]))
        count[kind] += 1
    return np.array(rows)


def _plans(batches: Iterator[pa.RecordBatch], *sizes: int) -> Iterator[tuple[dict, np.ndarray]]:
    """Rows with the weights of their target; those of the last target are kept."""
    last: tuple[str | None, np.ndarray] = (None, np.zeros(0))
    for batch in batches:
        for row in batch.to_pylist():
            if row["target"] != last[0]:
                last = (row["target"], weights(_plan_of(row), *sizes))
            yield row, last[1]


def _result(target: str, what: str, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([target]), pa.array([what]), pa.array([values.tolist()], pa.list_(pa.float64()))], ["target", "what", "parts"])


def shift(rows: DataFrame, target: str, period: str, unit: str, vector: str, stratum: str | None = None, replicates: int = REPLICATES,
          permutations: int = REPLICATES, halves: int = 0, seed: int = 42) -> DataFrame:
    """One row a target: both distances, intervals from whole sources, permutation p and q over targets.

    Targets without exactly two periods stay with status `requires_two_periods`. A source is in one period
    or in both, and all sources of a target alike: anything between stops the job, as do NULLs. Fewer than
    two sources in a period leave intervals and p undefined, and so does a permutation that could change
    nothing (no stratum has both periods). What one task holds of a target are counts and vector sums of
    its sources and the weights, never its rows.
    """
    text = lambda c: F.col(c).cast("string") if c else F.lit("")
    bad = F.lit(False)
    for c in (target, period, unit, vector):
        bad = bad | F.col(c).isNull()
    base = written(rows.select(refused_if(bad, "Target, period, source and vector must be given", text(target)).alias("target"), text(period).alias("period"),
                               text(unit).alias("unit"), text(stratum).alias("stratum"), F.col(vector).cast("array<double>").alias("v")), "shift-rows")
    parts = base.select("target", "period", "unit", "stratum", F.posexplode("v").alias("i", "x")).groupBy("target", "period", "unit", "i").agg(
        F.sum("x").alias("x"), F.count("*").alias("n"), F.min("stratum").alias("lo"), F.max("stratum").alias("hi"))
    one = refused_if(F.min("lo") != F.max("hi"), "A source is in two strata", F.min("lo"))
    cells = parts.groupBy("target", "period", "unit").agg(F.max("n").alias("n"), one.alias("stratum"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("sum"))
    place = W.partitionBy("target").orderBy("period", "unit")
    cells = written(cells.withColumn("cell", F.row_number().over(place) - 1), "shift-cells")
    shared = cells.groupBy("target", "unit").agg(F.count_distinct("period").alias("k")).groupBy("target").agg(F.count_if(F.col("k") > 1).alias("n_shared_units"))
    side = lambda c, p: F.coalesce(F.sum(F.when(F.col("period") == F.col(p), c)), F.lit(0)).cast("bigint")
    ends = cells.groupBy("target").agg(F.min("period").alias("period_0"), F.max("period").alias("period_1"), F.count_distinct("period").alias("_periods"))
    info = cells.join(ends, "target").groupBy("target", "period_0", "period_1", "_periods").agg(
        side(F.col("n"), "period_0").alias("n_0"), side(F.col("n"), "period_1").alias("n_1"), side(F.lit(1), "period_0").alias("n_units_0"), side(F.lit(1), "period_1").alias("n_units_1"))
    mixed = (F.col("_periods") == 2) & (F.col("n_shared_units") > 0) & ((F.col("n_shared_units") != F.col("n_units_0")) | (F.col("n_shared_units") != F.col("n_units_1")))
    info = info.join(shared, "target").withColumn("n_shared_units", refused_if(mixed, "Sources partially overlap between the periods", F.col("n_shared_units")))
    info = written(info.withColumn("status", F.when(F.col("_periods") == 2, "ok").otherwise("requires_two_periods")), "shift-targets")
    good = info.filter("status = 'ok'").select("target", F.col("n_units_0").cast("int").alias("first"), (F.col("n_shared_units") > 0).alias("paired"))
    own = cells.join(good.select("target"), "target", "left_semi")
    listed = own.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("cell", "unit", "stratum", "n", F.col("sum.x").alias("x")))).alias("c")).join(good, "target")
    plan = listed.select("target", "first", "paired", F.col("c.unit").alias("units"), F.col("c.stratum").alias("strata"), F.col("c.n").alias("rows"), F.col("c.x").alias("sums"))
    placed = base.join(own.select("target", "period", "unit", "cell"), ["target", "period", "unit"])
    sums = distance_sums(placed, "target", "cell", "v").groupBy("target", F.expr(f"a div {ROWS}").alias("_block")).agg(F.collect_list(F.struct("a", "b", "s")).alias("entries"))
    sizes = (replicates, permutations, halves, seed)

    def energies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, weight in _plans(batches, *sizes):
            start = row["_block"] * ROWS
            block = np.zeros((ROWS, weight.shape[1]))
            for e in row["entries"]:
                block[e["a"] - start, e["b"]] = e["s"]
            mine = weight[:, start:start + ROWS]
            yield _result(row["target"], "energy", -(mine * (weight @ block[:mine.shape[1]].T)).sum(1))

    def centroids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, weight in _plans(batches, *sizes):
            yield _result(row["target"], "centroid", np.sqrt(((weight @ np.array(row["sums"], float)) ** 2).sum(1)))

    def summary(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        energy = np.maximum(sum(np.array(r["parts"]) for r in rows if r["what"] == "energy"), 0.0)
        centroid = np.array(next(r["parts"] for r in rows if r["what"] == "centroid"))
        kinds = np.array(kinds_of(_plan_of(rows[0]), *sizes[:3]))
        boot, perm, half = kinds == "boot", kinds == "perm", np.char.startswith(kinds, "half")
        out: dict[str, object] = {"target": rows[0]["target"], "centroid_distance": centroid[0], "energy_distance": energy[0]}
        for name, values in (("centroid", centroid), ("energy", energy)):
            low, high = np.quantile(values[boot], [0.025, 0.975]) if boot.any() else (None, None)
            out |= {f"{name}_ci_lower": low, f"{name}_ci_upper": high}
        exceed = int((energy[perm] >= energy[0] - 1e-12).sum())
        out |= {"bootstrap_replicates": int(boot.sum()), "permutations_run": int(perm.sum()), "p": (1 + exceed) / (1 + perm.sum()) if perm.any() else None,
                "within_period_energy": energy[half].mean() if half.any() else None}
        return pa.Table.from_pylist([out], schema=SUMMARY)

    lists = plan.drop("sums")
    found = sums.join(lists, "target").mapInArrow(energies, PARTS).unionByName(plan.mapInArrow(centroids, PARTS)).join(lists, "target")
    told = found.groupBy("target").applyInArrow(summary, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'bigint' if f.type == pa.int64() else 'double'}" for f in SUMMARY))
    both = info.drop("_periods").join(told, "target", "left")
    both = both.withColumn("design", F.when(F.col("status") == "ok", F.when(F.col("n_shared_units") > 0, "paired_clusters").otherwise("independent_clusters")))
    both = both.withColumn("uncertainty_status", F.when(F.col("status") != "ok", None).when(F.least("n_units_0", "n_units_1") < 2, "undefined_insufficient_sampling_units")
                           .when(F.col("bootstrap_replicates") == 0, "not_requested").otherwise("ok"))
    return metrics.bh_fdr(both, [], "p")


PARTS = "target string, what string, parts array<double>"
SUMMARY = pa.schema([("target", pa.string()), *[(n, pa.float64()) for n in ("centroid_distance", "energy_distance", "centroid_ci_lower", "centroid_ci_upper", "energy_ci_lower", "energy_ci_upper")],
                     ("bootstrap_replicates", pa.int64()), ("permutations_run", pa.int64()), ("p", pa.float64()), ("within_period_energy", pa.float64())])


def _plan_of(row: dict) -> Plan:
    return Plan(row["target"], row["units"], row["strata"], np.array(row["rows"], float), row["first"], row["paired"])


def semantic_shift(rows: DataFrame, target: str, period: str, unit: str, vector: str, **options) -> DataFrame:
    """`shift` with sources that are exchangeable between the periods."""
    return shift(rows, target, period, unit, vector, **options)


def source_shift(rows: DataFrame, target: str, period: str, unit: str, vector: str, genre: str, halves: int = HALVES, **options) -> DataFrame:
    """`shift` with disjoint sources, permuted inside genres, and the energy between halves of one period."""
    out = shift(rows, target, period, unit, vector, stratum=genre, halves=halves, **options)
    return out.withColumn("status", refused_if(F.col("n_shared_units") > 0, "A source is in both periods", F.col("status")))
