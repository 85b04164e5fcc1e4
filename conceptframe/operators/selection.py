"""Choice of a subset of wordings from scores that are there already.

Every statistic that a subset needs is worked out once: rank agreement and covariance for each pair of
wordings and concept in one pass over the cells, and the average precision of all subsets' mean scores
in one pass in which a cell carries its wordings as an array. Subsets are the instrument's, not the
data's, and so are the tables in which they are compared.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from itertools import combinations
from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptframe.functions.hashing import digest
from conceptframe.functions.numeric import pearson
from conceptframe.operators import metrics
from conceptframe.operators.checks import refuse_rows, refused_if
from conceptframe.operators.grid import Bridge, literal_rows
from conceptframe.operators.ordering import mid_ranks
from conceptframe.schema import Refused
from conceptframe.session import written

MODES = ("reference_guided", "validity", "reliability", "alpha", "random")
SCORED_MOST, PREFIX_MOST = 16, 512
# Fixed markers of prompts and templates that a wording may not hold.
MARKERS = ("<|", "[mask]", "<think>", "</think>", "[inst]", "[/inst]", "<<sys>>")
WORD = r"[\p{L}\p{N}_]"
DIGITS = 12  # objectives that agree to so many decimals are equal


@dataclass(frozen=True)
class Search:
    """What is searched and how; `most` bounds the wordings that may be looked at."""

    objective: str = "reference_guided"
    subset_size: int = 3
    rounds: int = 2
    offspring: int = 4
    most: int = SCORED_MOST
    min_positive: int = 5
    min_negative: int = 5
    validity_weight: float = 0.8
    seed: int = 42
    protected: str | None = None
    forbidden: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for name in ("subset_size", "rounds", "offspring", "most", "min_positive", "min_negative", "seed"):
            if type(getattr(self, name)) is not int:
                raise Refused(f"{name} must be a whole number.")
        if self.objective not in MODES:
            raise Refused(f"Objectives are {MODES}.")
        if self.subset_size < 2 or self.rounds < 0 or self.offspring < 0 or not self.subset_size <= self.most <= SCORED_MOST:
            raise Refused("The search does not fit its budget.")
        if self.min_positive < 1 or self.min_negative < 1 or not (isfinite(self.validity_weight) and 0 <= self.validity_weight <= 1):
            raise Refused("Eligibility needs both kinds of labels, and the weight lies between 0 and 1.")


@dataclass
class Selected:
    status: str
    bridges: list[str]
    measures: dict[str, float | None] = field(default_factory=dict)
    trace: list[dict] = field(default_factory=list)
    eligible: list[str] = field(default_factory=list)


def eligible_anchors(labels: DataFrame, min_positive: int = 5, min_negative: int = 5) -> DataFrame:
    """(anchor_id, positives, negatives, eligible) from binary labels."""
    checked = metrics.checked(labels.withColumn("_s", F.lit(0.0)), "label", "_s")
    out = checked.groupBy("anchor_id").agg(F.sum(F.col("label") + F.col("_s").cast("int")).cast("bigint").alias("positives"), F.count("*").alias("_n"))
    return out.select("anchor_id", "positives", (F.col("_n") - F.col("positives")).alias("negatives"),
                      ((F.col("positives") >= min_positive) & (F.col("_n") - F.col("positives") >= min_negative)).alias("eligible"))


def rejection(relation: str, language: str, protected: str | None = None, forbidden: Sequence[str] = ()) -> Column:
    """Why a wording (columns prefix, relation, language) may not be used; NULL if it may.

    A forbidden surface counts where it stands as words of its own; one with Han characters anywhere. Case
    is not looked at.
    """
    prefix, low = F.col("prefix"), F.lower("prefix")
    marked = F.lit(False)
    for marker in MARKERS:
        marked = marked | low.contains(marker)
    inserted = F.lit(False)
    for surface in filter(None, forbidden):
        text = surface.lower()
        before, after = (f"(?<!{WORD})" if text[0].isalnum() or text[0] == "_" else ""), (f"(?!{WORD})" if text[-1].isalnum() or text[-1] == "_" else "")
        quoted = "".join(c if c.isalnum() else "\\" + c for c in text)
        inserted = inserted | (low.contains(text) if re.search("[㐀-鿿]", text) else low.rlike(before + quoted + after))
    return (F.when(prefix.isNull() | (F.col("relation") != relation) | (F.col("language") != language), "relation_or_language_changed")
            .when(~prefix.endswith("\n") | (F.length(prefix) > PREFIX_MOST), "invalid_delimiter_or_length")
            .when(marked | prefix.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), "control_token")
            .when(~prefix.contains(protected or ""), "protected_relation_changed")
            .when(inserted, "answer_surface_inserted"))


def words_of(prefix: Column, language: Column) -> Column:
    """Different words of a wording; single characters where the language is Chinese."""
    low = F.lower(prefix)
    return F.array_distinct(F.when(language.startswith("zh"), F.regexp_extract_all(low, F.lit(f"({WORD})"))).otherwise(F.regexp_extract_all(low, F.lit(f"({WORD}+)"))))


def word_distance(a: Column, b: Column) -> Column:
    """1 - Jaccard of two sets of words."""
    return 1 - F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def lexical_diversity(wordings: DataFrame, keys: Sequence[str], prefix: str = "prefix", language: str = "language") -> DataFrame:
    """(keys, wordings, lexical_diversity): mean word distance of all pairs of a set of wordings; NULL for one.

    A set is an instrument's few wordings; the pairs are made inside its row.
    """
    sets = wordings.groupBy(*keys).agg(F.collect_list(words_of(F.col(prefix), F.col(language))).alias("_w"))
    later = F.transform("_w", lambda a, i: F.transform(F.slice("_w", i + 2, F.size("_w")), lambda b: word_distance(a, b)))
    pairs = F.flatten(later)
    mean = F.try_divide(F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v), F.size(pairs))
    return sets.select(*keys, F.size("_w").alias("wordings"), mean.alias("lexical_diversity"))


def packed_cells(scores: DataFrame, labels: DataFrame, ids: Sequence[str], value: str = "value") -> DataFrame:
    """(sample_id, anchor_id, label, v): one score for each wording, NULL where it has none.

    A label without cell, a cell without label, a repeated cell or a label that is not 0 or 1 stops the job.
    """
    own = [F.max(F.when(F.col("bridge_id") == b, F.col(value).cast("double"))).alias(f"_v{i}") for i, b in enumerate(ids)]
    twice = F.greatest(F.lit(0), *[F.count_if(F.col("bridge_id") == b) for b in ids]) > 1
    wide = scores.filter(F.col("bridge_id").isin(list(ids))).groupBy("sample_id", "anchor_id").agg(*own, twice.alias("_twice"))
    both = wide.join(labels.select("sample_id", "anchor_id", F.col("label").cast("int").alias("label")), ["sample_id", "anchor_id"], "full_outer")
    bad = F.coalesce(F.col("_twice"), F.lit(True)) | ~F.coalesce(F.col("label").isin(0, 1), F.lit(False))
    return both.select("sample_id", "anchor_id", refused_if(bad, "Every cell needs one score a wording and one label of 0 or 1", F.col("label")).alias("label"),
                       F.array(*[f"_v{i}" for i in range(len(ids))]).alias("v"))


def invalid_wordings(cells: DataFrame, ids: Sequence[str]) -> set[str]:
    """Wordings with a score missing or not finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    counts = cells.agg(*[F.count_if(bad(F.col("v")[i])).alias(str(i)) for i in range(len(ids))]).first()
    return {b for b, n in zip(ids, counts) if n}


def pair_statistics(cells: DataFrame) -> DataFrame:
    """(anchor_id, b, c, rho, cov, flat) for wordings b <= c: rank agreement, covariance, and whether one is constant."""
    long = cells.select("sample_id", "anchor_id", F.posexplode("v").alias("b", "x"))
    ranked = long.join(mid_ranks(long, ["anchor_id", "b"], "x", "r"), ["anchor_id", "b", "x"])
    rows = ranked.groupBy("sample_id", "anchor_id").agg(F.array_sort(F.collect_list(F.struct("b", "x", "r"))).alias("c"))
    pair = F.flatten(F.transform("c", lambda p: F.transform(F.filter("c", lambda q: q["b"] >= p["b"]), lambda q: F.struct(
        p["b"].alias("b"), q["b"].alias("c"), p["x"].alias("x"), q["x"].alias("y"), p["r"].alias("r"), q["r"].alias("s")))))
    each = rows.select("anchor_id", F.inline(pair))
    flat = (F.min("x") == F.max("x")) | (F.min("y") == F.max("y"))
    return each.groupBy("anchor_id", "b", "c").agg(pearson(F.col("r"), F.col("s")).alias("rho"), F.covar_samp("x", "y").alias("cov"), flat.alias("flat"))


def subset_measures(cells: DataFrame, pairs: DataFrame, wordings: Sequence[Bridge], subsets: Sequence[tuple[int, ...]], search: Search = Search(),
                    every: bool = False) -> DataFrame:
    """One row a subset (numbers into `wordings`): validity, reliability, alpha, lexical diversity, objective.

    validity: mean over concepts of the average precision of the mean score; reliability: median over
    concepts of the mean rank agreement of its pairs, moved to 0..1; alpha: median over concepts. A subset
    with a constant wording is undefined (objective NULL), as is alpha without variance of the sum. With
    `every`, the other objectives stand beside it, each under its name after an underscore.
    """
    spark, k = cells.sparkSession, len(subsets[0])
    chosen = literal_rows([{"i": i, "m": list(m)} for i, m in enumerate(subsets)], "i int, m array<int>")
    each = cells.select("anchor_id", "label", "v", F.inline(chosen))
    mean = F.aggregate(F.transform("m", lambda p: F.get("v", p)), F.lit(0.0), lambda s, x: s + x) / k
    ap = metrics.average_precision(each.select("i", "anchor_id", "label", mean.alias("score")), ["i", "anchor_id"])
    validity = ap.groupBy("i").agg(F.avg("ap").alias("validity"))
    members = spark.createDataFrame([(i, b, c) for i, m in enumerate(subsets) for n, b in enumerate(m) for c in m[n:]], "i int, b int, c int")
    across = F.col("b") != F.col("c")
    per = members.join(pairs, ["b", "c"]).groupBy("i", "anchor_id").agg(
        F.avg(F.when(across, F.col("rho"))).alias("rho"), F.max("flat").alias("flat"), F.sum(F.when(~across, F.col("cov"))).alias("items"),
        F.sum(F.when(across, 2 * F.col("cov")).otherwise(F.col("cov"))).alias("whole"))
    alpha = F.when(F.col("whole") > 0, k / (k - 1) * (1 - F.col("items") / F.col("whole")))
    agreed = per.groupBy("i").agg(F.percentile("rho", F.lit(0.5)).alias("_rho"), F.max("flat").alias("flat"), F.percentile(alpha, F.lit(0.5)).alias("alpha"), F.count_if(alpha.isNull()).alias("_no_alpha"))
    named = literal_rows([{"i": i, "bridge_id": wordings[b].id, "prefix": wordings[b].prefix, "language": wordings[b].language} for i, m in enumerate(subsets) for b in m],
                         "i int, bridge_id string, prefix string, language string")
    texts = spark.range(1).select(F.inline(named))
    words = lexical_diversity(texts, ["i"]).select("i", "lexical_diversity")
    names = texts.groupBy("i").agg(F.array_sort(F.collect_list("bridge_id")).alias("bridges"))
    out = validity.join(agreed, "i").join(words, "i").join(names, "i")
    reliability, w = (1 + F.col("_rho")) / 2, search.validity_weight
    alpha_all = F.when(F.col("_no_alpha") == 0, F.col("alpha"))
    aims = {"reference_guided": w * F.col("validity") + (1 - w) * reliability, "validity": F.col("validity"), "reliability": reliability, "alpha": alpha_all, "random": F.lit(0.0)}
    each = [F.when(~F.col("flat"), aims[mode]).alias(f"_{mode}") for mode in MODES] if every else []
    return out.select("bridges", "validity", F.when(~F.col("flat"), reliability).alias("reliability"), alpha_all.alias("alpha"), "lexical_diversity",
                      F.when(~F.col("flat"), aims[search.objective]).alias("objective"), *each)


def best_subset(measures: DataFrame, search: Search) -> dict | None:
    """The defined subset with the highest objective, then diversity, then the first ids; by digest if random."""
    tie = digest(search.seed, F.concat_ws(",", "bridges")) if search.objective == "random" else F.lit("")
    order = [F.desc(F.round("objective", DIGITS)), tie, F.desc(F.round("lexical_diversity", DIGITS)), "bridges"]
    row = measures.filter("objective is not null").orderBy(*order).first()
    return row.asDict() if row else None


def select_bridge_subset(scores: DataFrame, labels: DataFrame, generations: Sequence[Sequence[Bridge]], search: Search = Search(), value: str = "value",
                         groups: DataFrame | None = None, reference_groups: DataFrame | None = None) -> Selected:
    """The best subset of the first generation, then of what is selected and each next generation.

    scores: (sample_id, anchor_id, bridge_id, value) of training rows; labels: (sample_id, anchor_id,
    label). A first wording that breaks a rule stops the search; a later one, a repeated id or prefix, and
    one with a score missing or not finite is left out and named in the trace. A row whose `split` is not
    train, or a training group that the reference has too, stops it.
    """
    return select_bridge_subsets(scores, labels, generations, [search], value, groups, reference_groups)[0]


def select_bridge_subsets(scores: DataFrame, labels: DataFrame, generations: Sequence[Sequence[Bridge]], searches: Sequence[Search], value: str = "value",
                          groups: DataFrame | None = None, reference_groups: DataFrame | None = None) -> list[Selected]:
    """The same for several objectives of one search: cells, pairs and the measures of a subset are worked out once."""
    search = searches[0]
    if len({replace(s, objective=search.objective) for s in searches}) != 1:
        raise Refused("Searches that are done together differ in their objective only.")
    for df in (scores, labels):
        if "split" in df.columns:
            refuse_rows(df.filter("split is null or split <> 'train'").select("split"), "Selection takes training rows only")
    if groups is not None and reference_groups is not None:
        refuse_rows(groups.select("group_id").join(reference_groups.select("group_id"), "group_id", "left_semi"), "Reference and selection groups overlap")
    seeds = list(generations[0]) if generations else []
    if not seeds or len(seeds) > search.most:
        raise Refused("The first wordings are none or more than the budget.")
    relation, language = seeds[0].relation, seeds[0].language
    if len({b.id for b in seeds}) < len(seeds) or len({b.prefix for b in seeds}) < len(seeds):
        raise Refused("First wordings need ids and prefixes of their own.")
    offered = [(g, b) for g, own in enumerate([seeds, *generations[1:search.rounds + 1]]) for b in (own if g == 0 else own[:search.offspring])]
    spark = scores.sparkSession
    listed = literal_rows([{"n": n, "prefix": b.prefix, "relation": b.relation, "language": b.language} for n, (_, b) in enumerate(offered)], "n int, prefix string, relation string, language string")
    reasons = {r.n: r.why for r in spark.range(1).select(F.inline(listed)).select("n", rejection(relation, language, search.protected, search.forbidden).alias("why")).collect()}
    trace, accepted, ids, prefixes = [], [], set(), set()
    for n, (g, b) in enumerate(offered):
        why = reasons[n] or ("duplicate" if b.id in ids or b.prefix in prefixes else None)
        if why and g == 0:
            raise Refused(f"First wording {b.id}: {why}")
        if why:
            trace.append({"generation": g, "bridge_id": b.id, "rejected": why})
        elif len(ids) < search.most:
            ids.add(b.id)
            prefixes.add(b.prefix)
            accepted.append((g, b))
    usable = written(eligible_anchors(labels, search.min_positive, search.min_negative), "eligible")
    eligible = sorted(r.anchor_id for r in usable.filter("eligible").select("anchor_id").collect())
    if not eligible:
        return [Selected("no_eligible_anchors", [b.id for b in seeds[:search.subset_size]], trace=list(trace)) for _ in searches]
    names = [b.id for _, b in accepted]
    keep = F.broadcast(usable.filter("eligible").select("anchor_id"))
    cells = written(packed_cells(scores, labels, names, value).join(keep, "anchor_id", "left_semi"), "cells")
    invalid = invalid_wordings(cells, names)
    trace += [{"generation": g, "bridge_id": b.id, "rejected": "invalid_scores"} for g, b in accepted if b.id in invalid]
    place = {b.id: n for n, b in enumerate(b for _, b in accepted)}
    every = [b for _, b in accepted]
    good = [n for n, b in enumerate(every) if b.id not in invalid]
    slim = cells.withColumn("v", F.transform("v", lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)))
    pairs = written(pair_statistics(slim.withColumn("v", F.transform("v", lambda x: F.coalesce(x, F.lit(0.0))))), "pairs")
    held: dict[tuple, DataFrame] = {}

    def measured(subsets: tuple[tuple[int, ...], ...], search: Search) -> DataFrame:
        if subsets not in held:
            held[subsets] = written(subset_measures(slim, pairs, every, subsets, search, every=True), "measures")
        return held[subsets].withColumn("objective", F.col(f"_{search.objective}")).drop(*[f"_{m}" for m in MODES])

    def searched(search: Search, trace: list[dict]) -> Selected:
        chosen, measures = None, {}
        for g in range(search.rounds + 1):
            pool = sorted({n for n in good if accepted[n][0] == g} | {place[b] for b in (chosen or [])}, key=lambda n: every[n].id)
            if g and not any(accepted[n][0] == g for n in good):
                continue
            subsets = tuple(tuple(sorted(m)) for m in combinations(pool, search.subset_size))
            found = best_subset(measured(subsets, search), search) if subsets else None
            if found is None and g == 0:
                status = "undefined_reliability" if len(pool) >= search.subset_size else "insufficient_valid_bridges"
                return Selected(status, [every[n].id for n in good[:search.subset_size]], trace=trace, eligible=eligible)
            if found:
                chosen, measures = found.pop("bridges"), found
            trace.append({"generation": g, "selected": chosen, **measures})
        return Selected("ok", chosen, measures, trace, eligible)

    return [searched(s, list(trace)) for s in searches]
