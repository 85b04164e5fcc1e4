"""Rank correlations of all draws of targets at once: a target is one row that carries its weights in every draw.

The targets are put in order of a side's values once, not once a draw. Blocks of neighbours are summed draw by
draw, windows over the blocks' sums give what lies before each block, and inside a block the ranks of all
draws are running sums of the targets' weights. What is ever expanded by draws is the table of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptframe.operators.resample import draws
from conceptframe.session import written

BLOCK = 1024  # neighbours in a block; a task holds their ranks in all draws
DRAWN_AT_ONCE = 4_000_000  # drawn rows in a partition
SUMS = "side int, head double, tail double, first bigint, numbers array<bigint>, values array<double>, weights binary, every array<bigint>, at_head array<bigint>, at_tail array<bigint>"


def _small(x: np.ndarray) -> bytes:
    """Bytes of counts, in the narrowest type that holds the largest."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _counts(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.dtype(f"u{len(data) // width}"))


def _changes(v: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin; NaN equals itself."""
    other = (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))
    return np.flatnonzero(np.concatenate([[True], other]))


def drawn_weights(spark, groups: int, replicates: int, seed: int) -> DataFrame:
    """(_number, weights): of each group that is drawn at all, how often in each replicate."""
    code = F.col("_number") * replicates + F.col("replicate")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-groups * replicates // DRAWN_AT_ONCE))
    dealt = draws(spark, groups, replicates, seed).select(code.alias("code")).repartition(parts, F.expr(f"code div {replicates}")).sortWithinPartitions("code")

    def rows(codes: np.ndarray) -> pa.RecordBatch:
        numbers, at = np.unique(codes // replicates, return_inverse=True)
        counts = np.bincount(at * replicates + codes % replicates, minlength=len(numbers) * replicates).reshape(-1, replicates)
        return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array([_small(c) for c in counts], pa.binary())], ["_number", "weights"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = np.zeros(0, np.int64)  # of the last group, whose draws may go on in the next batch
        for batch in batches:
            codes = np.concatenate([left, batch.column("code").to_numpy()])
            whole = np.searchsorted(codes, codes[-1] // replicates * replicates) if len(codes) else 0
            left = codes[whole:]
            if whole:
                yield rows(codes[:whole])
        if len(left):
            yield rows(left)

    return dealt.mapInArrow(work, "_number bigint, weights binary")


def _blocks(targets: DataFrame, width: int) -> DataFrame:
    """Blocks of neighbours in the order of each side, with their sums and those of their first and last value."""
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("side"), (F.col(c) + F.lit(0.0)).alias("v")) for n, c in enumerate(("x", "y"))]))
    order, most = ["side", "v", "_number"], BLOCK
    ordered = targets.select(each, "_number", "weights").repartitionByRange(*order).sortWithinPartitions(*order)

    def block(side: int, held: list[tuple]) -> pa.RecordBatch:
        values, numbers = np.array([v for v, _, _ in held]), [n for _, n, _ in held]
        counts = np.stack([_counts(w, width) for _, _, w in held]).astype(np.int64)
        last = _changes(values)
        end = last[1] if len(last) > 1 else len(values)
        sums = [counts.sum(0), counts[:end].sum(0), counts[last[-1]:].sum(0)]
        row = [side, values[0], values[-1], numbers[0], numbers, values.tolist(), _small(counts), *[s.tolist() for s in sums]]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, kinds)], names)

    ints, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
    names = [f.split(" ")[0] for f in SUMS.split(", ")]
    kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int64(), ints, doubles, pa.binary(), ints, ints, ints]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for side, *row in zip(*[batch.column(c).to_pylist() for c in ("side", "v", "_number", "weights")]):
                if held and (side != now or len(held) == most):
                    yield block(now, held)
                    held = []
                now = side
                held.append(row)
        if held:
            yield block(now, held)

    return ordered.mapInArrow(work, SUMS)


def _placed(blocks: DataFrame) -> DataFrame:
    """Blocks with the weight, draw by draw, below their first value (low), before them (start), and up to their last value (high)."""
    cells = blocks.select("side", "first", "head", "tail", F.posexplode(F.arrays_zip("every", "at_head", "at_tail")).alias("r", "s"))
    cells = cells.select("side", "first", "head", "tail", "r", F.col("s.every").alias("every"), F.col("s.at_head").alias("at_head"), F.col("s.at_tail").alias("at_tail"))
    line = W.partitionBy("side", "r").orderBy("head", "tail", "first")
    cells = cells.withColumn("start", F.coalesce(F.sum("every").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # a value may go on over any number of blocks: it begins in the first that ends with it, and ends in the last that begins with it
    cells = cells.withColumn("begins", F.min(F.col("start") + F.col("every") - F.col("at_tail")).over(W.partitionBy("side", "r", "tail"))).withColumn(
        "ends", F.max(F.col("start") + F.col("at_head")).over(W.partitionBy("side", "r", "head")))
    low = F.when(F.lag("tail").over(line) == F.col("head"), F.lag("begins").over(line)).otherwise(F.col("start"))
    high = F.when(F.lead("head").over(line) == F.col("tail"), F.lead("ends").over(line)).otherwise(F.col("start") + F.col("every"))
    places = cells.select("side", "first", F.struct("r", low.alias("low"), "start", high.alias("high")).alias("p")).groupBy("side", "first").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return blocks.select("side", "first", "numbers", "values", "weights").join(places, ["side", "first"]).select(
        "side", "numbers", "values", "weights", "p.low", "p.start", "p.high")


def _ranked(placed: DataFrame, width: int, count: int) -> DataFrame:
    """(_number, side, ranks, weights): twice the mid-rank of a target in each draw, less its mean; weights come with side 0."""
    kind = np.int32 if count < 1 << 30 else np.int64

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values, counts = np.array(row["values"], float), _counts(row["weights"], len(row["values"]) * width).reshape(-1, width)
                heads = _changes(values)
                upto = np.array(row["start"]) + np.cumsum(np.add.reduceat(counts.astype(np.int64), heads, axis=0), axis=0)
                upto[-1] = row["high"]
                below = np.concatenate([[row["low"]], upto[:-1]])
                ranks = np.repeat((below + upto - count).astype(kind), np.diff(np.append(heads, len(values))), axis=0)
                weights = [_small(c) for c in counts] if row["side"] == 0 else [None] * len(values)
                yield pa.RecordBatch.from_arrays([pa.array(row["numbers"], pa.int64()), pa.array([row["side"]] * len(values), pa.int32()),
                                                  pa.array([r.tobytes() for r in ranks], pa.binary()), pa.array(weights, pa.binary())], ["_number", "side", "ranks", "weights"])

    return placed.mapInArrow(work, "_number bigint, side int, ranks binary, weights binary")


def rank_correlation_draws(targets: DataFrame, count: int, replicates: int, seed: int) -> DataFrame:
    """(replicate, v): Spearman's correlation of the columns x and y over `count` targets (_number from 0), in each draw and, as replicate -1, over all.

    Where a side's drawn values are all equal v is NULL.
    """
    spark, width = targets.sparkSession, replicates + 1  # the first weight is that of all targets once

    def with_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [_small(np.concatenate([[1], _counts(w, replicates) if w else np.zeros(replicates, int)])) for w in batch.column("weights").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_number", "x", "y")], pa.array(weights, pa.binary())], ["_number", "x", "y", "weights"])

    drawn = targets.select("_number", "x", "y").join(drawn_weights(spark, count, replicates, seed), "_number", "left")
    held = written(drawn.mapInArrow(with_all, "_number bigint, x double, y double, weights binary"), "drawn-targets")
    blocks = written(_blocks(held, width), "rank-blocks")
    ranked = _ranked(_placed(blocks), width, count).repartition("_number").sortWithinPartitions("_number", "side")
    kind = np.int32 if count < 1 << 30 else np.int64

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, first = np.zeros((3, width)), None
        for batch in batches:
            for side, ranks, weights in zip(*[batch.column(c).to_pylist() for c in ("side", "ranks", "weights")]):
                own = np.frombuffer(ranks, kind).astype(float)
                if side == 0:
                    first = own, _counts(weights, width)
                    continue
                x, w = first
                sums += [w * x * x, w * own * own, w * x * own]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width) - 1), *map(pa.array, sums)], ["replicate", "xx", "yy", "xy"])

    parts = ranked.mapInArrow(work, "replicate bigint, xx double, yy double, xy double").groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("xx", "yy", "xy")])
    r = F.col("xy") / (F.sqrt("xx") * F.sqrt("yy"))
    return parts.select("replicate", F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("v"))
