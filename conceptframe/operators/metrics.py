"""Ranking and agreement metrics from tie groups: equal scores are one row before anything is ordered.

Keys may hold any number of rows: running sums go over distinct scores, bucketed by value, so that one
hot key does not pass through one task. Undefined is NULL, and what is left out is listed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptframe.functions.numeric import pearson
from conceptframe.operators.checks import refused_if
from conceptframe.operators.ordering import mid_ranks, running_sums, value_bucket
from conceptframe.session import written


# --- alignment ---------------------------------------------------------------------------------

def align(predictions: DataFrame, labels: DataFrame, keys: Sequence[str], prediction: str = "score", label: str = "label") -> DataFrame:
    """One row for each key with both values; a key that one side lacks or has twice stops the job."""
    a = predictions.groupBy(*keys).agg(F.count("*").alias("_p"), F.first(prediction).alias(prediction))
    b = labels.groupBy(*keys).agg(F.count("*").alias("_l"), F.first(label).alias(label))
    both = a.join(b, list(keys), "full_outer")
    bad = ~((F.col("_p") == 1) & (F.col("_l") == 1))
    value = refused_if(F.coalesce(bad, F.lit(True)), "Predictions and labels do not have the same keys once", F.col(prediction))
    return both.select(*keys, value.alias(prediction), label)


def melt(wide: DataFrame, id_col: str, columns: Sequence[str], name: str, value: str) -> DataFrame:
    return wide.unpivot(id_col, list(columns), name, value)


def in_order(scores: DataFrame, positions: DataFrame, key: str, position: str = "position") -> DataFrame:
    """Rows with the frozen place of their id; ids that only one side has stop the job."""
    both = scores.withColumn("_here", F.lit(1)).join(positions.select(key, position), key, "full_outer")
    bad = F.col("_here").isNull() | F.col(position).isNull()
    return both.withColumn(position, refused_if(bad, "Ids and frozen order differ", F.col(position))).drop("_here")


def many_to_one(rows: DataFrame, criterion: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with the criterion of their key; a missing or repeated criterion stops the job."""
    one = criterion.groupBy(key).agg(F.count("*").alias("_n"), F.first(value).alias(value))
    joined = rows.join(one, key, "left")
    return joined.withColumn(value, refused_if(F.coalesce(F.col("_n"), F.lit(0)) != 1, "Criterion missing or repeated", F.col(value))).drop("_n")


def pair_endpoints(pairs: DataFrame, samples: DataFrame, target: str, left: str = "left", right: str = "right", key: str = "sample_id") -> DataFrame:
    """Pairs whose two ends carry the pair's own target; an unknown end stops the job."""
    ends = samples.select(key, F.col(target).alias("_t"))
    a = ends.withColumnsRenamed({key: left, "_t": "_lt"})
    b = ends.withColumnsRenamed({key: right, "_t": "_rt"})
    joined = pairs.join(a, left, "left").join(b, right, "left")
    known = refused_if(F.col("_lt").isNull() | F.col("_rt").isNull(), "A pair names an unknown sample", F.col(target))
    return joined.withColumn(target, known).filter((F.col("_lt") == F.col(target)) & (F.col("_rt") == F.col(target))).drop("_lt", "_rt")


def checked(rows: DataFrame, label: str, score: str, binary: bool = True) -> DataFrame:
    """Finite scores and labels of 0 and 1, or no result at all."""
    bad = F.col(score).isNull() | F.isnan(score) | (F.abs(score) == float("inf")) | F.col(label).isNull()
    if binary:
        bad = bad | ~F.col(label).isin(0, 1)
    return rows.withColumn(score, refused_if(F.coalesce(bad, F.lit(True)), "Labels must be 0 or 1 and scores finite", F.col(score)))


# --- ranking -----------------------------------------------------------------------------------

def average_precision(rows: DataFrame, keys: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """Non-interpolated AP per key; equal scores share one threshold. NULL without positives."""
    rows = checked(rows, label, score)
    tied = rows.groupBy(*keys, F.col(score).cast("double").alias("_s")).agg(F.sum(label).cast("double").alias("_y"), F.count("*").cast("double").alias("_n"))
    tied = written(tied.withColumn("_o", -F.col("_s")), "ties")  # read for the buckets, for their totals and inside them
    run = running_sums(tied, keys, value_bucket(tied, "_o"), [F.col("_o")], {"_cy": F.col("_y"), "_cn": F.col("_n")})
    out = run.groupBy(*keys).agg(F.sum(F.col("_y") * F.col("_cy") / F.col("_cn")).alias("_a"), F.sum("_y").alias("positives"), F.sum("_n").alias("rows"))
    return out.select(*keys, F.try_divide("_a", "positives").alias("ap"), F.col("positives").cast("bigint").alias("positives"), F.col("rows").cast("bigint").alias("rows"))


def evaluate_multilabel(rows: DataFrame, anchor: str = "anchor_id", label: str = "label", score: str = "score") -> DataFrame:
    """One row: macro AP over anchors with positives, micro AP over all cells, and the anchors left out."""
    per = average_precision(rows, [anchor], label, score)
    whole = per.agg(F.avg("ap").alias("macro_ap"), F.count("ap").alias("anchors"),
                    F.array_sort(F.collect_list(F.when(F.col("ap").isNull(), F.col(anchor)))).alias("excluded"))
    micro = average_precision(rows.select(label, score), [], label, score).select(F.col("ap").alias("micro_ap"), "rows")
    return whole.withColumn("_k", F.lit(1)).join(micro.withColumn("_k", F.lit(1)), "_k").drop("_k")


def evaluate_candidates(rows: DataFrame, key: str = "sample_id", order: str = "position", label: str = "label", score: str = "score",
                        require_contrast: bool = True) -> DataFrame:
    """Per sample AP and reciprocal rank (ties in input order); samples without contrast have NULLs and a reason.

    The best rank of a relevant candidate is one more than the candidates before it, so no list is ordered.
    """
    ap = average_precision(rows, [key], label, score)
    first = rows.filter(F.col(label) == 1).groupBy(key).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(order).alias("o"))).alias("_b"))
    place = F.struct((-F.col(score)).alias("s"), F.col(order).alias("o"))
    before = rows.join(first, key).groupBy(key).agg((F.count_if(place < F.col("_b")) + 1).alias("rank"))
    both = ap.join(before, key, "left")
    reason = F.when(F.col("positives") == 0, "no_relevant").when(F.lit(require_contrast) & (F.col("positives") == F.col("rows")), "no_contrast")
    return both.select(key, F.when(reason.isNull(), F.col("ap")).alias("ap"), F.when(reason.isNull(), 1 / F.col("rank")).alias("rr"), reason.alias("excluded"))


def retrieval_metrics(rows: DataFrame, query: str, order: str, ks: Sequence[int] = (1, 5, 10), label: str = "label", score: str = "score") -> DataFrame:
    """Per query success@K and recall@K; ties keep the candidates' order; queries without relevant items are left out.

    Only the largest K rows of a query are ordered: each input partition keeps no more than that.
    """
    most = max(ks)
    relevant = rows.groupBy(query).agg(F.sum(label).alias("_all"))
    place = F.struct((-F.col(score)).alias("s"), F.col(order).alias("o"), F.col(label).alias("y"))
    ranked = rows.select(query, place.alias("p")).withColumn("r", F.row_number().over(W.partitionBy(query).orderBy("p"))).filter(F.col("r") <= most)
    hits = ranked.groupBy(query).agg(*[F.sum(F.when(F.col("r") <= k, F.col("p.y")).otherwise(0)).alias(f"_h{k}") for k in ks])
    both = relevant.filter("_all > 0").join(hits, query)
    return both.select(query, *[f for k in ks for f in ((F.col(f"_h{k}") > 0).cast("int").alias(f"success_{k}"), (F.col(f"_h{k}") / F.col("_all")).alias(f"recall_{k}"))])


# --- agreement ---------------------------------------------------------------------------------

def spearman(rows: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Spearman with mid-ranks per key over pairwise complete rows; NULL if a side is constant."""
    rows = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    # ranks read the pairs of values several times; they are written, so that the rows are gone through once
    cells = written(rows.groupBy(*keys, "_a", "_b").agg(F.count("*").cast("double").alias("_w")), "value-pairs")
    for side in ("_a", "_b"):
        cells = cells.join(mid_ranks(cells, keys, side, f"r{side}", F.col("_w")), [*keys, side])
    n, w = F.sum("_w"), F.col("_w")
    x, y = F.col("r_a"), F.col("r_b")
    sums = cells.groupBy(*keys).agg(n.alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * y).alias("sxy"),
                                    F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"))
    cov, vx, vy = (F.col(p) - F.col(q) * F.col(r) / F.col("n") for p, q, r in (("sxy", "sx", "sy"), ("sxx", "sx", "sx"), ("syy", "sy", "sy")))
    return sums.select(*keys, F.when((vx > 1e-9) & (vy > 1e-9), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vx * vy)))).alias("spearman"), F.col("n").cast("bigint").alias("n"))


def pearson_by(rows: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    return rows.groupBy(*keys).agg(pearson(F.col(a), F.col(b)).alias("pearson"), F.count("*").alias("n"))


def squared_errors(rows: DataFrame, keys: Sequence[str], label: str, prediction: str, constant: Column) -> DataFrame:
    """MSE per key, that of a constant prediction, and the share of it that is gone."""
    y = F.col(label)
    out = rows.groupBy(*keys).agg(F.avg((y - F.col(prediction)) * (y - F.col(prediction))).alias("mse"), F.avg((y - constant) * (y - constant)).alias("constant_mse"))
    return out.withColumn("reduction", F.lit(1.0) - F.try_divide("mse", "constant_mse"))


# --- reliability and families ------------------------------------------------------------------

def cronbach_alpha(cells: DataFrame, keys: Sequence[str], item: str, row: str, value: str = "value") -> DataFrame:
    """k/(k-1) (1 - sum of item variances / variance of the sum) per key, with a status."""
    totals = cells.groupBy(*keys, row).agg(F.sum(value).alias("_t"), F.count(value).alias("_k"))
    whole = totals.groupBy(*keys).agg(F.var_samp("_t").alias("_vt"), F.min("_k").alias("_lo"), F.max("_k").alias("_hi"), F.count("*").alias("rows"))
    items = cells.groupBy(*keys, item).agg(F.var_samp(value).alias("_v")).groupBy(*keys).agg(F.sum("_v").alias("_vi"), F.count("*").alias("items"))
    both = whole.join(items, list(keys)) if keys else whole.withColumn("_k1", F.lit(1)).join(items.withColumn("_k1", F.lit(1)), "_k1").drop("_k1")
    k = F.col("items").cast("double")
    status = (F.when((F.col("items") < 2) | (F.col("rows") < 2), "too_few").when((F.col("_lo") != F.col("_hi")) | (F.col("_hi") != F.col("items")), "incomplete")
              .when(F.col("_vt") <= 0, "zero_variance").otherwise("ok"))
    return both.select(*keys, F.when(status == "ok", k / (k - 1) * (1 - F.col("_vi") / F.col("_vt"))).alias("alpha"), "items", "rows", status.alias("status"))


def bh_fdr(pvalues: DataFrame, family: Sequence[str], p: str = "p") -> DataFrame:
    """Benjamini-Hochberg q inside a family; NULL and NaN stay undefined and do not count.

    Families are lists of hypotheses, not of data rows.
    """
    good = F.when(~F.isnan(p), F.col(p))
    w = W.partitionBy(*family)
    rows = pvalues.withColumn("_p", good).withColumn("_m", F.count("_p").over(w))
    rows = rows.withColumn("_i", F.when(F.col("_p").isNotNull(), F.rank().over(w.orderBy(F.col("_p").asc_nulls_last())) + F.count("_p").over(W.partitionBy(*family, "_p")) - 1))
    later = w.orderBy(F.col("_p").desc_nulls_first()).rangeBetween(W.unboundedPreceding, W.currentRow)
    q = F.min(F.col("_p") * F.col("_m") / F.col("_i")).over(later)
    return rows.withColumn("q", F.when(F.col("_p").isNotNull(), F.least(F.lit(1.0), q))).drop("_p", "_m", "_i")


def group_z(rows: DataFrame, group: Sequence[str], target: str, value: str) -> DataFrame:
    """Mean z of a target inside its groups; a group without spread stops the job."""
    stats = rows.groupBy(*group).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    means = rows.groupBy(*group, target).agg(F.avg(value).alias("_v"), F.count("*").alias("n"))
    spread = refused_if(F.coalesce(F.col("_s") <= 0, F.lit(True)), "A group has no spread", F.col("_s"))
    return means.join(stats, list(group)).select(*group, target, ((F.col("_v") - F.col("_m")) / spread).alias("z"), "n")


def paired_log_ratio(rows: DataFrame, keys: Sequence[str], side: str, first: str, second: str, value: str) -> DataFrame:
    """log of the first alternative minus log of the second per key; unpaired keys have a NULL and a reason."""
    pivot = rows.groupBy(*keys).agg(*[F.sum(F.when(F.col(side) == s, F.col(value))).alias(f"_{i}") for i, s in enumerate((first, second))])
    return pivot.select(*keys, (F.log("_0") - F.log("_1")).alias("log_ratio"), F.when(F.col("_0").isNull() | F.col("_1").isNull(), "unpaired").alias("reason"))


def signed_contrasts(cells: DataFrame, signs: DataFrame, keys: Sequence[str], column: str, value: str = "value") -> DataFrame:
    """Sum of signed columns per (key, dimension); `signs` (dimension, column, sign) is configuration."""
    return cells.join(F.broadcast(signs), column).groupBy(*keys, "dimension").agg(F.sum(F.col("sign") * F.col(value)).alias("contrast"))


def interaction_scores(rows: DataFrame, keys: Sequence[str], condition: str, value: str = "value") -> DataFrame:
    """both - a - b + neither per key; a missing condition makes it NULL."""
    part = {c: F.sum(F.when(F.col(condition) == c, F.col(value))) for c in ("both", "a", "b", "neither")}
    return rows.groupBy(*keys).agg((part["both"] - part["a"] - part["b"] + part["neither"]).alias("interaction"))


def judged_pairs(judgments: DataFrame, target: str, left: str, right: str, rating: str = "judgment") -> DataFrame:
    """Mean rating of unordered pairs per target; undecidable ratings (0) are dropped."""
    return (judgments.filter(F.col(rating) != 0).groupBy(target, F.least(left, right).alias("first"), F.greatest(left, right).alias("second"))
            .agg(F.avg(rating).alias("rating"), F.count("*").alias("n")))


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two partitions, from the counts of their cells."""
    def pairs(n):
        return n * (n - 1) / F.lit(2.0)

    cells = rows.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").cast("double").alias("n"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("x"), F.sum("n").alias("t"), F.lit(1).alias("k"))
    sides = [cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias(f"s{c}"), F.lit(1).alias("k")) for c in ("_a", "_b")]
    one = both.join(sides[0], "k").join(sides[1], "k")
    expected = F.col("s_a") * F.col("s_b") / pairs(F.col("t"))
    top = (F.col("s_a") + F.col("s_b")) / 2
    return one.select(F.when(top == expected, 1.0).otherwise(F.try_divide(F.col("x") - expected, top - expected)).alias("ari"), F.col("t").cast("bigint").alias("rows"))


def group_difference(rows: DataFrame, column: str, group: str, a: str, b: str, value: str = "value") -> DataFrame:
    """Per column the means of two groups and their difference."""
    ga, gb = (F.avg(F.when(F.col(group) == g, F.col(value))) for g in (a, b))
    return rows.groupBy(column).agg(ga.alias("mean_a"), gb.alias("mean_b"), (ga - gb).alias("difference"))


# --- wordings and ledgers ----------------------------------------------------------------------

def bridge_reliability(scores: DataFrame, variant: str = "raw_logp") -> DataFrame:
    """Per anchor and pair of wordings the rank agreement over materials.

    The wordings of one cell are brought together in one row first (their number is the instrument's),
    so that no table is joined with itself.
    """
    cells = scores.groupBy("sample_id", "anchor_id").agg(F.array_sort(F.collect_list(F.struct("bridge_id", F.col(variant).alias("v")))).alias("_c"))
    first = cells.select("anchor_id", "_c", F.posexplode("_c").alias("_i", "_x"))
    pairs = first.select("anchor_id", "_x", F.explode(F.filter("_c", lambda c, j: j > F.col("_i"))).alias("_y"))
    rows = pairs.select("anchor_id", F.col("_x.bridge_id").alias("first"), F.col("_y.bridge_id").alias("second"), F.col("_x.v").alias("a"), F.col("_y.v").alias("b"))
    return spearman(rows, ["anchor_id", "first", "second"], "a", "b")


def template_radii(scores: DataFrame, variant: str = "raw_logp") -> DataFrame:
    """Per material the largest distance of a wording's concept vector from the mean of all wordings."""
    cells = scores.groupBy("sample_id", "anchor_id").agg(F.avg(variant).alias("_m"), F.collect_list(F.struct("bridge_id", F.col(variant).alias("v"))).alias("_c"))
    off = cells.select("sample_id", "_m", F.explode("_c").alias("c"))
    each = off.groupBy("sample_id", "c.bridge_id").agg(F.sqrt(F.sum((F.col("c.v") - F.col("_m")) * (F.col("c.v") - F.col("_m")))).alias("_d"))
    return each.groupBy("sample_id").agg(F.max("_d").alias("radius"))


def token_count_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("anchor_id", "bridge_id").agg(F.min("token_count").alias("least"), F.max("token_count").alias("most"), F.avg("token_count").alias("mean"))


def coverage_ledger(rows: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows found per key against the number expected; unexpected and missing keys are listed too."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("found"))
    both = found.join(expected.select(*keys, "expected"), list(keys), "full_outer")
    return both.select(*keys, F.coalesce("found", F.lit(0)).alias("found"), "expected", F.coalesce(F.col("found") == F.col("expected"), F.lit(False)).alias("complete"))


def cost_ledger(jobs: DataFrame, job: str, state: str, order: str, hours: Sequence[str]) -> DataFrame:
    """Per state the number of jobs and their hours; a job counts once, under its last state."""
    one = jobs.groupBy(job).agg(F.max_by(state, order).alias(state), *[F.max(h).alias(h) for h in hours])
    return one.groupBy(state).agg(F.count("*").alias("jobs"), *[F.sum(h).alias(h) for h in hours])
