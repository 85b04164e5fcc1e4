"""Scorers: the table-fitted query-likelihood model, vector cosines, pair scorers and user callbacks."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptframe.functions import vectors
from conceptframe.functions.text import tokens
from conceptframe.operators.checks import refuse_rows, same_keys, small_rows
from conceptframe.operators.grid import Instrument, finish_scores, grid, literal_rows
from conceptframe.schema import BOUNDARY, BUDGET, MEDIA, OK, Refused

END = "</s>"


def surface_tokens(text: str) -> list[str]:
    """Driver-side twin of `tokens`, for the instrument's own short strings."""
    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


@dataclass(frozen=True)
class LanguageModel:
    """Dirichlet-smoothed unigram model (query likelihood): background counts of the needed terms."""

    total: int
    distinct: int
    counts: dict[str, int]
    mu: float = 2000.0

    @property
    def revision(self) -> str:
        """Identity of the fitted model: smoothing and background counts."""
        fitted = json.dumps([self.total, self.distinct, self.mu, sorted(self.counts.items())])
        return f"dirichlet-{self.mu:g}-{hashlib.sha256(fitted.encode()).hexdigest()[:12]}"

    def background(self, term: str) -> float:
        return (self.counts.get(term, 0) + 1) / (self.total + self.distinct)


def vocabulary(instrument: Instrument) -> list[str]:
    words = [t for a in instrument.anchors for t in surface_tokens(a.surface)]
    return sorted(set(words))


def fit_language_model(train: DataFrame, instrument: Instrument, text: str = "text", mu: float = 2000.0) -> LanguageModel:
    """Term counts of the training material.

    One pass: tokens are counted map-side, then one row comes back that holds two totals and the
    counts of the instrument's own vocabulary.
    """
    vocab = vocabulary(instrument)
    terms = (train.select(F.explode(tokens(F.col(text))).alias("term"))
             .groupBy("term").agg(F.count("*").alias("n")))
    row = terms.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct"),
        F.collect_list(F.when(F.col("term").isin(vocab), F.struct("term", "n"))).alias("counts")).first()
    return LanguageModel(int(row["total"]), int(row["distinct"]), {r["term"]: int(r["n"]) for r in row["counts"]}, mu)


def query_likelihood(samples: DataFrame, instrument: Instrument, model: LanguageModel, *, text: str = "text",
                     keep: Sequence[str] = (), media_missing: Column | None = None,
                     token_details: bool = False, own: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """Score table of `samples` (sample_id, text, ...): sum of log P(token | material + bridge).

    With `only`, a table of different sample_ids, no others are scored; counts meet it, texts do not travel. With `own`, a column of anchor ids, a material meets only those. A score depends on its own anchor only, so adding anchors never moves the others. The whole
    computation is a narrow map: term counts are taken per material, before the expansion, and the
    instrument enters as literals.
    """
    vocab = vocabulary(instrument)
    at = {v: i + 1 for i, v in enumerate(vocab)}
    unusable = F.col(text).isNull()
    hits = F.filter("_tokens", lambda t: t.isin(vocab))
    # Two references keep `_hits` a column of its own; with one, its filter over all tokens would be
    # moved into the loop over the vocabulary and run once for every term.
    counts = F.when(F.size("_hits") == 0, F.array_repeat(F.lit(0), len(vocab))).otherwise(
        F.transform(F.lit(vocab), lambda v: F.size(F.filter("_hits", lambda h: h == v))))
    carried = [k for k in keep if k != "sample_id"]
    listed = [own] if own and own not in carried else []
    # Everything that needs the text happens here, once per material and before the expansion.
    base = (samples.select("sample_id", *carried, *listed, F.coalesce(tokens(F.col(text)), F.array()).alias("_tokens"),
                           unusable.alias("_unusable"),
                           *([media_missing.alias("_missing")] if media_missing is not None else []))
            .withColumn("_hits", hits)
            .withColumn("_len", F.size("_tokens")).withColumn("_tf", counts).drop("_tokens", "_hits"))
    if only is not None:  # no semi join, which would be moved below the counts
        base = base.join(only, "sample_id")
    bridges = []
    for b in instrument.bridges:
        words = surface_tokens(b.prefix)
        bridges.append({"bridge_id": b.id, "bridge_prefix": b.prefix, "relation": b.relation, "_blen": len(words),
                        "_btf": [words.count(v) for v in vocab]})
    anchors = [{"anchor_id": a.id, "anchor_surface": a.surface,
                "_terms": [{"i": at[t], "prior": model.mu * model.background(t)} for t in surface_tokens(a.surface)]}
               for a in instrument.anchors]
    cells = (base
             .select("*", F.inline(literal_rows(bridges, "bridge_id string, bridge_prefix string, relation string, _blen int, _btf array<int>")))
             .select("*", F.inline(literal_rows(anchors, "anchor_id string, anchor_surface string, _terms array<struct<i:int,prior:double>>"))))
    if own:
        cells = cells.filter(F.array_contains(own, F.col("anchor_id")))
    length = F.col("_len") + F.col("_blen") + F.lit(model.mu)
    logps = F.transform("_terms", lambda t: F.log(
        (F.element_at("_tf", t["i"]) + F.element_at("_btf", t["i"]) + t["prior"]) / length))
    if instrument.event == "turn_terminated":
        logps = F.concat(logps, F.array(F.log(F.lit(model.mu / (model.total + model.distinct)) / length)))
    limits, n_anchor = instrument.budgets, F.size("_terms")
    over = F.lit(False)
    for size, most in ((F.col("_len"), limits.text_tokens), (n_anchor, limits.anchor_tokens),
                       (F.col("_len") + F.col("_blen") + n_anchor, limits.total_tokens)):
        over = over if most is None else over | (size > most)
    status = F.when(F.col("_unusable") | (n_anchor < 1), BOUNDARY).when(over, BUDGET).otherwise(OK)
    if media_missing is not None:
        status = F.when(F.col("_missing"), MEDIA).otherwise(status)
    scored = (cells
              .withColumn("token_logps", logps)
              .withColumn("raw_logp", F.aggregate("token_logps", F.lit(0.0), lambda s, v: s + v))
              .withColumn("token_count", F.size("token_logps"))
              .withColumn("status", status))
    return finish_scores(scored, replace(instrument, model_revision=model.revision), [*carried, *(["token_logps"] if token_details else [])])


ScoreBatch = Callable[[pd.DataFrame], pd.DataFrame]


def scored_by(samples: DataFrame, instrument: Instrument, make_scorer: Callable[[], ScoreBatch], *,
              text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Plug-in scorer over Arrow batches.

    `make_scorer` is called once per partition (so a model is loaded once) and returns a function from
    a frame (sample_id, text, bridge_prefix, anchor_id, anchor_surface, event) to a frame with raw_logp,
    token_count and status in the same row order.
    """
    cells = (grid(samples.select("sample_id", text, *[k for k in keep if k not in ("sample_id", text)]), instrument)
             .withColumn("event", F.lit(instrument.event)))
    schema = T.StructType([*cells.schema.fields, T.StructField("raw_logp", T.DoubleType()),
                           T.StructField("token_count", T.IntegerType()), T.StructField("status", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            result = scorer(batch)
            if len(result) != len(batch):
                raise ValueError("The scorer returned another number of cells than it was given.")
            yield pd.concat([batch.reset_index(drop=True),
                             result[["raw_logp", "token_count", "status"]].reset_index(drop=True)], axis=1)

    return finish_scores(cells.mapInPandas(run, schema), instrument, keep)


def encoded_by(df: DataFrame, column: str, make_encoder: Callable[[], Callable[[pd.Series], list]],
               output: str = "vector") -> DataFrame:
    """Plug-in encoder: texts to vectors, iterator form so that the encoder is built once per task."""
    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for batch in batches:
            yield pd.Series(list(encoder(batch)))

    return df.withColumn(output, encode(F.col(column)))


def cosine_scores(vectors_df: DataFrame, anchors: Sequence[tuple[str, Sequence[float]]], vector: str = "vector") -> DataFrame:
    """Rows against a configured set of anchor vectors: a literal expansion, no join."""
    widths = {len(v) for _, v in anchors}
    if len(widths) != 1 or not anchors:
        raise Refused("Anchor vectors must share one dimension.")
    if any(sum(x * x for x in v) == 0 for _, v in anchors):
        raise Refused("Zero anchor vector.")
    width = widths.pop()
    table = F.array(*[F.struct(F.lit(i).alias("anchor_id"), F.lit([float(x) for x in v]).alias("_a")) for i, v in anchors])
    checked = F.when(F.size(vector) != width, F.raise_error(F.lit("Dimensions differ")).cast("double")).otherwise(
        vectors.dot(F.col(vector), F.col("_a")) / (vectors.norm(F.col(vector)) * vectors.norm(F.col("_a"))))
    return vectors_df.select("*", F.inline(table)).withColumn("score", checked).drop("_a")


def centroid_cosines(vectors_df: DataFrame, key: str, group: str, vector: str = "vector") -> DataFrame:
    """Cosine of every row to every group's mean vector.

    The means are averaged position by position (map-side), then packed to one array of groups; their
    number is the number of groups, checked before it travels to the tasks.
    """
    positions = (vectors_df.select(group, F.posexplode(vector).alias("i", "v"))
                 .groupBy(group, "i").agg(F.avg("v").alias("v")))
    means = positions.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("_mean"))
    rows = [(r[group], list(r["_mean"])) for r in small_rows(means, 4096)]
    table = F.array(*[F.struct(F.lit(g).alias("anchor_id"), F.lit(m).alias("_a")) for g, m in sorted(rows)])
    score = F.try_divide(vectors.dot(F.col(vector), F.col("_a")), vectors.norm(F.col(vector)) * vectors.norm(F.col("_a")))
    return vectors_df.select(key, vector, F.inline(table)).select(key, "anchor_id", score.alias("score"))


def pair_scores(pairs: DataFrame, model: LanguageModel, left: str = "text", right: str = "candidate") -> DataFrame:
    """Length-normalized overlap likelihood of a candidate text given a text, per supplied pair.

    Background is uniform over the fitted vocabulary, so the score needs nothing but the pair itself.
    """
    given, wanted = tokens(F.col(left)), tokens(F.col(right))
    smooth = F.lit(model.mu / (model.total + model.distinct))
    df = pairs.withColumn("_g", given).withColumn("_w", wanted)
    total = F.aggregate("_w", F.lit(0.0), lambda s, t: s + F.log(
        (F.size(F.filter("_g", lambda g: g == t)) + smooth) / (F.size("_g") + F.lit(model.mu))))
    return df.withColumn("score", F.try_divide(total, F.size("_w"))).drop("_g", "_w")


def fill_template(df: DataFrame, template: str, slots: dict[str, Column], mask: str = "[MASK]") -> DataFrame:
    """Placeholders replaced, then the text before and after the first mask."""
    filled = F.col(template)
    for name, value in slots.items():
        filled = F.replace(filled, F.lit("{" + name + "}"), value)
    df = df.withColumn("filled", filled)
    at = F.instr("filled", mask)
    return (df.withColumn("left", F.when(at > 0, F.expr(f"substring(filled, 1, instr(filled, '{mask}') - 1)")))
            .withColumn("right", F.when(at > 0, F.expr(f"substring(filled, instr(filled, '{mask}') + {len(mask)})"))))


def decomposition(token_rows: DataFrame, keys: Sequence[str], start: str, end: str, position: str = "position",
                  logp: str = "logp") -> DataFrame:
    """Sums of token log probabilities before, inside and after the anchor span, and the residual."""
    p, v = F.col(position), F.col(logp)
    return (token_rows.groupBy(*keys)
            .agg(F.sum(v).alias("full_logp"),
                 F.sum(F.when(p < F.col(start), v).otherwise(0.0)).alias("prefix_logp"),
                 F.sum(F.when((p >= F.col(start)) & (p < F.col(end)), v).otherwise(0.0)).alias("anchor_logp"),
                 F.sum(F.when(p >= F.col(end), v).otherwise(0.0)).alias("suffix_logp"))
            .withColumn("residual", F.abs(F.col("full_logp") - F.col("prefix_logp") - F.col("anchor_logp") - F.col("suffix_logp"))))


def sign_reversals(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(F.col(a) * F.col(b) < 0).alias("reversals"), F.count("*").alias("n"))


def check_coverage(requested: DataFrame, returned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A scorer must return exactly the requested cells."""
    refuse_rows(same_keys(requested, returned, keys), "Requested and returned cells differ")
    return returned

