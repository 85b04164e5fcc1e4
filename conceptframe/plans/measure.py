"""Queries: splits, the score grid, reference calibration, the matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptframe.functions.numeric import r9, rank_agreement
from conceptframe.operators import calibrate, grid, prepare, scorers
from conceptframe.plans import sqltext as S
from conceptframe.plans.registry import query
from conceptframe.schema import SCORE_KEYS
from conceptframe.sources import tables as T

N_BRIDGES = len(T.BRIDGES)
ANCHOR_IDS = [a.id for a in T.ANCHORS]


@query("grouped_hash_split", S.with_samples("SELECT sample_id, group_id, split FROM samples"))
def grouped_hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return T.samples(spark, sf).select("sample_id", "group_id", "split")


@query("groups_crossing_splits", S.with_samples("""
SELECT source AS group_id, count(DISTINCT split) AS n_splits, count(*) AS n_rows FROM samples
GROUP BY source HAVING count(DISTINCT split) > 1"""))
def groups_crossing_splits(spark: SparkSession, sf: str) -> DataFrame:
    s = T.samples(spark, sf).select(F.col("source").alias("group_id"), "split")
    return prepare.groups_crossing_splits(s, "group_id")


@query("score_grid", S.with_scores(f"""
SELECT sample_id, anchor_id, bridge_id, round(raw_logp, 9) AS raw_logp, token_count::INTEGER AS token_count,
  round(raw_logp / token_count, 9) AS mean_token_logp, 'ok' AS status FROM scores"""))
def score_grid(spark: SparkSession, sf: str) -> DataFrame:
    return T.scores(spark, sf, keep=()).select(
        *SCORE_KEYS, r9(F.col("raw_logp")).alias("raw_logp"), "token_count",
        r9(F.col("mean_token_logp")).alias("mean_token_logp"), "status")


@query("turn_terminated_scores", S.with_scores("""
SELECT sample_id, anchor_id, bridge_id,
  round(raw_logp + ln(2000.0::DOUBLE / (total + distinct_terms) / (len(toks) + b.n + 2000.0::DOUBLE)), 9) AS raw_logp,
  (token_count + 1)::INTEGER AS token_count
FROM scores JOIN tokd USING (sample_id) JOIN blen b USING (bridge_id), bg"""))
def turn_terminated_scores(spark: SparkSession, sf: str) -> DataFrame:
    study = grid.Instrument(T.ANCHORS, T.BRIDGES, event="turn_terminated")
    out = scorers.query_likelihood(T.samples(spark, sf), study, T.language_model(spark, sf))
    return out.select(*SCORE_KEYS, r9(F.col("raw_logp")).alias("raw_logp"), "token_count")


@query("token_details", S.with_scores("""
SELECT d.sample_id, a.anchor_id, b.bridge_id, a.term AS token,
  round(ln((coalesce(dtf.n, 0) + coalesce(bt.n, 0) + 2000.0::DOUBLE * p.p) / (len(d.toks) + b.n + 2000.0::DOUBLE)), 9) AS logp
FROM tokd d CROSS JOIN blen b CROSS JOIN aterms a JOIN pbg p ON p.term = a.term
  LEFT JOIN dtf ON dtf.sample_id = d.sample_id AND dtf.term = a.term
  LEFT JOIN bterms bt ON bt.bridge_id = b.bridge_id AND bt.term = a.term"""))
def token_details(spark: SparkSession, sf: str) -> DataFrame:
    out = scorers.query_likelihood(T.samples(spark, sf), T.STUDY, T.language_model(spark, sf), token_details=True)
    words = F.filter(F.split(F.lower("anchor_surface"), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return (out.select(*SCORE_KEYS, F.inline(F.arrays_zip(words.alias("token"), F.col("token_logps").alias("logp"))))
            .toDF(*SCORE_KEYS, "token", "logp").withColumn("logp", r9(F.col("logp"))))


BUDGET_STUDY = grid.Instrument(T.ANCHORS, T.BRIDGES, budgets=grid.Budgets(text_tokens=500, total_tokens=512))


@query("budget_statuses", S.with_scores("""
SELECT bridge_id, status, count(*) AS n, count(raw) AS n_scored FROM (
  SELECT bridge_id, CASE WHEN len(toks) > 500 OR len(toks) + b.n + token_count > 512 THEN 'BudgetExceeded' ELSE 'ok' END AS status,
    CASE WHEN status = 'ok' THEN raw_logp END AS raw
  FROM scores JOIN tokd USING (sample_id) JOIN blen b USING (bridge_id))
GROUP BY ALL"""))
def budget_statuses(spark: SparkSession, sf: str) -> DataFrame:
    out = scorers.query_likelihood(T.samples(spark, sf), BUDGET_STUDY, T.language_model(spark, sf))
    return out.groupBy("bridge_id", "status").agg(F.count("*").alias("n"), F.count("raw_logp").alias("n_scored"))


@query("missing_media_statuses", S.with_scores("""
SELECT CASE WHEN media IS NULL THEN 'MissingMedia' ELSE 'ok' END AS status, count(*) AS n,
  count(CASE WHEN media IS NOT NULL THEN raw_logp END) AS n_scored
FROM scores LEFT JOIN (SELECT DISTINCT page_id::VARCHAR AS sample_id, sha256(html) AS media FROM pages) USING (sample_id)
GROUP BY 1"""))
def missing_media_statuses(spark: SparkSession, sf: str) -> DataFrame:
    media = T.load(spark, sf, "pages").select(F.col("page_id").cast("string").alias("sample_id"), F.sha2("html", 256).alias("media"))
    base = T.samples(spark, sf).join(media, "sample_id", "left")
    out = scorers.query_likelihood(base, T.STUDY, T.language_model(spark, sf), media_missing=F.col("media").isNull())
    return out.groupBy("status").agg(F.count("*").alias("n"), F.count("raw_logp").alias("n_scored"))


CANDIDATES = """
cand AS (SELECT sample_id, anchor_id FROM samples JOIN (VALUES
  ('en','a_that'),('en','a_with'),('en','a_tion'),('fr','a_tion'),('fr','a_from'),('de','a_then'),('es','a_this')) v(lang, anchor_id) USING (lang))"""


@query("candidate_scores", S.with_scores("""
SELECT sample_id, anchor_id, bridge_id, round(raw_logp, 9) AS raw_logp FROM scores JOIN cand USING (sample_id, anchor_id)""", CANDIDATES))
def candidate_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Per-sample inventories: each document meets the concepts of its own language."""
    own = [("en", "a_that"), ("en", "a_with"), ("en", "a_tion"), ("fr", "a_tion"), ("fr", "a_from"), ("de", "a_then"), ("es", "a_this")]
    inventory = T.samples(spark, sf).select("sample_id", "lang").join(spark.createDataFrame(own, "lang string, anchor_id string"), "lang")
    lists = inventory.groupBy("sample_id").agg(F.collect_set("anchor_id").alias("own"))
    out = scorers.query_likelihood(T.samples(spark, sf).join(lists, "sample_id"), T.STUDY, T.language_model(spark, sf), own="own")
    return out.select(*SCORE_KEYS, r9(F.col("raw_logp")).alias("raw_logp"))


@query("grid_input_checks", S.with_samples("""
SELECT count(*) AS n_samples, count(DISTINCT sample_id) AS n_ids, count(DISTINCT group_id) AS n_groups,
  count(*) - count(sample_id) AS null_ids FROM samples"""))
def grid_input_checks(spark: SparkSession, sf: str) -> DataFrame:
    s = grid.check_samples(T.samples(spark, sf))
    return s.agg(F.count("*").alias("n_samples"), F.count_distinct("sample_id").alias("n_ids"),
                 F.count_distinct("group_id").alias("n_groups"), F.count_if(F.col("sample_id").isNull()).alias("null_ids"))


@query("content_keys", S.with_samples("""
SELECT count(*) AS n_cells, count(DISTINCT text) * 24 AS n_keys FROM samples, range(24)"""))
def content_keys(spark: SparkSession, sf: str) -> DataFrame:
    cells = grid.content_key(grid.grid(T.samples(spark, sf).select("sample_id", "content"), T.STUDY), T.STUDY, F.col("content"))
    return cells.agg(F.count("*").alias("n_cells"), F.count_distinct("content_key").alias("n_keys"))


@query("cache_split", S.with_scores("""
SELECT split, count(*) AS n_cells, count_if(hit) AS n_hits, round(sum(raw_logp), 6) AS sum_logp FROM (
  SELECT s.split, s.raw_logp, c.group_text IS NOT NULL AS hit FROM scores s JOIN samples d USING (sample_id)
  LEFT JOIN (SELECT DISTINCT text AS group_text FROM samples WHERE split = 'train') c ON c.group_text = d.text)
GROUP BY split"""))
def cache_split(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of training material are cached; the replay serves them and only the rest is scored."""
    model = T.language_model(spark, sf)
    stored = T.scores(spark, sf, keep=("content",), where="split = 'train'", model=model)

    def score(one: DataFrame) -> DataFrame:
        return scorers.query_likelihood(T.samples(spark, sf), T.STUDY, model, keep=("content",), only=one)

    rows = grid.replayed(T.samples(spark, sf).select("sample_id", "split", "content"), stored, T.STUDY, score)
    return rows.groupBy("split").agg(F.count("*").alias("n_cells"), F.count_if("cache_hit").alias("n_hits"),
                                     F.round(F.sum("raw_logp"), 6).alias("sum_logp"))


@query("fit_reference", S.with_scores("""
SELECT anchor_id, bridge_id, reference_n, round(log_mean_probability, 9) AS log_mean_probability,
  round(mean_logp, 9) AS mean_logp, round(std_logp, 9) AS std_logp, 'ok' AS z_status FROM ref""", S.REFERENCE))
def fit_reference(spark: SparkSession, sf: str) -> DataFrame:
    ref = calibrate.fit_reference(T.scores(spark, sf, keep=("split",), where="split = 'train'"))
    return ref.select("anchor_id", "bridge_id", "reference_n", *[r9(F.col(c)).alias(c) for c in (
        "log_mean_probability", "mean_logp", "std_logp")], "z_status")


def calibrated(spark: SparkSession, sf: str, keep=T.KEEP) -> DataFrame:
    model = T.language_model(spark, sf)
    ref = calibrate.fit_reference(T.scores(spark, sf, keep=("split",), where="split = 'train'", model=model))
    return calibrate.transform(T.scores(spark, sf, keep=keep, model=model), ref)


@query("transform_scores", S.with_scores("""
SELECT sample_id, anchor_id, bridge_id, round(reference_log_ratio, 9) AS reference_log_ratio,
  round(reference_z, 9) AS reference_z, 'ok' AS reference_z_status FROM calibrated""", S.REFERENCE))
def transform_scores(spark: SparkSession, sf: str) -> DataFrame:
    return calibrated(spark, sf, keep=()).select(
        *SCORE_KEYS, *[r9(F.col(c)).alias(c) for c in ("reference_log_ratio", "reference_z")], "reference_z_status")


@query("to_matrix", S.with_scores("SELECT sample_id, anchor_id, round(value, 9) AS value FROM matrix", S.REFERENCE, S.Z_MATRIX))
def to_matrix(spark: SparkSession, sf: str) -> DataFrame:
    m = calibrate.to_matrix(calibrated(spark, sf, keep=()), N_BRIDGES, "reference_z")
    return m.select("sample_id", "anchor_id", r9(F.col("value")).alias("value"))


@query("wide_matrix", S.with_scores("SELECT sample_id, " + ", ".join(
    f"round(max(CASE WHEN anchor_id = '{a}' THEN value END), 9) AS {a}" for a in ANCHOR_IDS) + " FROM matrix GROUP BY sample_id", S.RAW_MATRIX))
def wide_matrix(spark: SparkSession, sf: str) -> DataFrame:
    m = calibrate.to_matrix(T.scores(spark, sf, keep=()), N_BRIDGES)
    wide = calibrate.wide_matrix(m, ANCHOR_IDS)
    return wide.select("sample_id", *[r9(F.col(a)).alias(a) for a in ANCHOR_IDS])


@query("reference_z_by_source", S.with_scores("""
SELECT source, anchor_id, round(avg(value), 9) AS mean_z, count(*) AS n FROM matrix GROUP BY source, anchor_id""", S.REFERENCE, S.Z_MATRIX))
def reference_z_by_source(spark: SparkSession, sf: str) -> DataFrame:
    m = calibrate.to_matrix(calibrated(spark, sf, keep=("source",)), N_BRIDGES, "reference_z", keep=("source",))
    return m.groupBy("source", "anchor_id").agg(r9(F.avg("value")).alias("mean_z"), F.count("*").alias("n"))


@query("configuration_check", S.with_scores("""
SELECT * FROM (VALUES ('unique_keys', (SELECT count(*) FROM scores WHERE lang = 'de' AND anchor_id = 'a_with')),
  ('anchor_definition', (SELECT count(DISTINCT anchor_id) FROM scores WHERE lang = 'de' AND anchor_id = 'a_that')),
  ('bridge_definition', (SELECT count(DISTINCT bridge_id) FROM scores WHERE lang = 'es' AND bridge_id = 'b_from')),
  ('single_measurement', (SELECT count(DISTINCT lang) FROM scores WHERE lang = 'fr')),
  ('declared_coordinates', (SELECT count(DISTINCT lang) FROM scores WHERE lang IN ('de', 'es')))) v(rule, violations)"""))
def configuration_check(spark: SparkSession, sf: str) -> DataFrame:
    """Faults planted by language: repeated keys, another surface, another prefix, another revision."""
    s = T.scores(spark, sf, keep=("lang",))
    own = F.col("lang")
    bad = (s.withColumn("anchor_surface", F.when((own == "de") & (F.col("anchor_id") == "a_that"), "THAT").otherwise(F.col("anchor_surface")))
           .withColumn("bridge_prefix", F.when((own == "es") & (F.col("bridge_id") == "b_from"), "From:").otherwise(F.col("bridge_prefix")))
           .withColumn("model_revision", F.when(own == "fr", "other").otherwise(F.col("model_revision"))))
    copies = F.when((own == "de") & (F.col("anchor_id") == "a_with"), 2).otherwise(1)
    return calibrate.configuration_faults(bad.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))), T.STUDY)


BUDGET_CELLS = f"""
cells AS (SELECT s.sample_id, s.anchor_id, s.bridge_id, CASE WHEN len(toks) <= 500 AND len(toks) + b.n + token_count <= 512 THEN raw_logp END AS v
  FROM scores s JOIN tokd USING (sample_id) JOIN blen b USING (bridge_id))"""


@query("missing_policy", S.with_scores("""
SELECT anchor_id, bridge_id, count(*) AS n, round(avg(v), 9) AS mean_logp FROM cells
WHERE sample_id NOT IN (SELECT sample_id FROM cells WHERE v IS NULL) GROUP BY ALL""", BUDGET_CELLS))
def missing_policy(spark: SparkSession, sf: str) -> DataFrame:
    s = T.samples(spark, sf)
    out = scorers.query_likelihood(s, BUDGET_STUDY, T.language_model(spark, sf))
    cells = calibrate.complete_grid(out, s, BUDGET_STUDY, missing="drop_samples")
    return cells.groupBy("anchor_id", "bridge_id").agg(F.count("*").alias("n"), r9(F.avg("value")).alias("mean_logp"))


@query("grid_coverage", S.with_scores("""
SELECT (SELECT count(*) FROM samples) * 24 AS expected_cells, sum(nv)::BIGINT AS valid_cells, count_if(nv < 24) AS incomplete_samples
FROM (SELECT sample_id, count(v) AS nv FROM cells GROUP BY sample_id)""", BUDGET_CELLS))
def grid_coverage(spark: SparkSession, sf: str) -> DataFrame:
    s = T.samples(spark, sf)
    return calibrate.grid_coverage(scorers.query_likelihood(s, BUDGET_STUDY, T.language_model(spark, sf)), s, BUDGET_STUDY)


@query("reference_leaks", S.with_samples("SELECT split, count(*) AS n FROM samples WHERE split NOT IN ('train','training','external') GROUP BY split"))
def reference_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return calibrate.leaking_reference_rows(T.samples(spark, sf)).groupBy("split").agg(F.count("*").alias("n"))


@query("reference_source", S.with_scores("""
SELECT s.bridge_id, count(*) AS n, round(avg(raw_logp), 9) AS mean_logp FROM scores s
WHERE s.sample_id IN (SELECT sample_id FROM samples WHERE split = 'train' AND lang = 'en') GROUP BY s.bridge_id"""))
def reference_source(spark: SparkSession, sf: str) -> DataFrame:
    """Reference rows chosen by an id table: English training material."""
    ids = T.samples(spark, sf).filter("split = 'train' and lang = 'en'").select("sample_id")
    ref = scorers.query_likelihood(prepare.subset_by_ids(T.samples(spark, sf), ids), T.STUDY, T.language_model(spark, sf))
    return ref.groupBy("bridge_id").agg(F.count("*").alias("n"), r9(F.avg("raw_logp")).alias("mean_logp"))


@query("reference_disjointness", S.with_samples("""
SELECT 'source' AS kind, source AS identity FROM samples WHERE split = 'train' INTERSECT SELECT 'source', source FROM samples WHERE split <> 'train'"""))
def reference_disjointness(spark: SparkSession, sf: str) -> DataFrame:
    """Sources (not duplicate groups) do cross the splits, and the audit lists them."""
    s = T.samples(spark, sf)
    return calibrate.overlapping_reference(s.filter("split = 'train'"), s.filter("split <> 'train'"), ["source"])


@query("variant_rank_agreement", S.with_scores("""
SELECT sample_id, CASE WHEN min(ra) < max(ra) AND min(rb) < max(rb) THEN round(corr(ra, rb), 9) + 0.0::DOUBLE END AS spearman FROM rk GROUP BY sample_id""",
    S.REFERENCE, """
cal AS (SELECT sample_id, anchor_id, avg(raw_logp) AS a, avg(reference_z) AS b FROM calibrated GROUP BY ALL)""", """
rk AS (SELECT sample_id, rank() OVER (PARTITION BY sample_id ORDER BY a) + (count(*) OVER (PARTITION BY sample_id, a) - 1) / 2.0::DOUBLE AS ra,
  rank() OVER (PARTITION BY sample_id ORDER BY b) + (count(*) OVER (PARTITION BY sample_id, b) - 1) / 2.0::DOUBLE AS rb FROM cal)"""))
def variant_rank_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Per sample: rank agreement of two variants over the concepts, inside one row of an array per sample."""
    cal = calibrated(spark, sf, keep=())
    per = cal.groupBy("sample_id", "anchor_id").agg(F.avg("raw_logp").alias("a"), F.avg("reference_z").alias("b"))
    rows = per.groupBy("sample_id").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    return rows.select("sample_id", (r9(rank_agreement("a", "b")) + 0.0).alias("spearman"))
