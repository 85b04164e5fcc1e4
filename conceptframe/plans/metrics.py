"""Queries: alignment, ranking metrics, agreement, reliability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptframe.functions.numeric import r9
from conceptframe.operators import metrics
from conceptframe.plans import sqltext as S
from conceptframe.plans.registry import query
from conceptframe.sources import tables as T

# Concept columns of a labelled document: scores rounded, so that ties occur, and two gold labels.
GOLD_SQL = """
docs AS (SELECT l.doc_id::VARCHAR AS sample_id, l.quality, l.toxic, round(ln(d.n_chars + 1), 1) AS s_quality,
  (length(d.text) - length(replace(d.text, 'is', ''))) / 2.0::DOUBLE AS s_toxic FROM labels l JOIN documents d USING (doc_id)),
cells AS (SELECT sample_id, 'quality' AS anchor_id, s_quality AS score, quality AS label FROM docs
  UNION ALL SELECT sample_id, 'toxic', s_toxic, toxic FROM docs)"""

AP_SQL = """
tied AS (SELECT {k}, score, sum(label)::DOUBLE AS y, count(*)::DOUBLE AS n FROM {t} GROUP BY ALL),
run AS (SELECT *, sum(y) OVER w AS cy, sum(n) OVER w AS cn FROM tied WINDOW w AS (PARTITION BY {k} ORDER BY score DESC)),
ap AS (SELECT {k}, CASE WHEN sum(y) > 0 THEN sum(y * cy / cn) / sum(y) END AS ap, sum(y)::BIGINT AS positives, sum(n)::BIGINT AS n_rows FROM run GROUP BY {k})"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    docs = T.load(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("sample_id"), F.round(F.log(F.col("n_chars") + 1), 1).alias("quality"),
        ((F.length("text") - F.length(F.replace("text", F.lit("is"), F.lit("")))) / 2.0).alias("toxic"))
    ids = T.load(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("sample_id"))
    return metrics.melt(docs.join(ids, "sample_id", "left_semi"), "sample_id", ["quality", "toxic"], "anchor_id", "score")


def gold(spark: SparkSession, sf: str) -> DataFrame:
    wide = T.load(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("sample_id"), "quality", "toxic")
    return metrics.melt(wide, "sample_id", ["quality", "toxic"], "anchor_id", "label")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.align(predictions(spark, sf), gold(spark, sf), ["sample_id", "anchor_id"])


@query("align_predictions", f"WITH {GOLD_SQL} SELECT sample_id, anchor_id, score, label FROM cells")
def align_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf)


@query("average_precision", f"WITH {GOLD_SQL}, {AP_SQL.format(k='anchor_id', t='cells')} SELECT anchor_id, round(ap, 9) AS ap, positives, n_rows FROM ap")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.average_precision(cells(spark, sf), ["anchor_id"]).select("anchor_id", r9(F.col("ap")).alias("ap"), "positives", F.col("rows").alias("n_rows"))


@query("multilabel_ap", f"""WITH {GOLD_SQL}, {AP_SQL.format(k='anchor_id', t='cells')},
one AS (SELECT 1 AS k, score, label FROM cells),
mt AS (SELECT score, sum(label)::DOUBLE AS y, count(*)::DOUBLE AS n FROM one GROUP BY score),
mr AS (SELECT *, sum(y) OVER w AS cy, sum(n) OVER w AS cn FROM mt WINDOW w AS (ORDER BY score DESC))
SELECT (SELECT round(avg(ap), 9) FROM ap) AS macro_ap, (SELECT count(ap) FROM ap) AS anchors, round(sum(y * cy / cn) / sum(y), 9) AS micro_ap, sum(n)::BIGINT AS n_cells FROM mr""")
def multilabel_ap(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.evaluate_multilabel(cells(spark, sf))
    return out.select(r9(F.col("macro_ap")).alias("macro_ap"), "anchors", r9(F.col("micro_ap")).alias("micro_ap"), F.col("rows").alias("n_cells"))


# Candidates: a customer's orders; relevant are urgent ones; scores rounded to thousands tie.
CAND_SQL = """
cand AS (SELECT o_custkey AS sample_id, o_orderkey AS position, round(o_totalprice / 50000)::DOUBLE AS score, (o_orderpriority LIKE '1%')::INTEGER AS label FROM orders)"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    o = T.load(spark, sf, "orders")
    scores = o.select(F.col("o_custkey").alias("sample_id"), F.col("o_orderkey").alias("position"), F.round(F.col("o_totalprice") / 50000).alias("score"))
    relevant = o.select(F.col("o_custkey").alias("sample_id"), F.col("o_orderkey").alias("position"), F.col("o_orderpriority").startswith("1").cast("int").alias("label"))
    return metrics.align(scores, relevant, ["sample_id", "position"])


@query("candidate_join", f"WITH {CAND_SQL} SELECT * FROM cand")
def candidate_join(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf)


@query("candidate_ap_mrr", f"""WITH {CAND_SQL}, {AP_SQL.format(k='sample_id', t='cand')},
rk AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, position) AS r FROM cand),
rr AS (SELECT sample_id, 1.0::DOUBLE / min(r) AS rr FROM rk WHERE label = 1 GROUP BY sample_id)
SELECT ap.sample_id, CASE WHEN positives > 0 AND positives < n_rows THEN round(ap, 9) END AS ap, CASE WHEN positives > 0 AND positives < n_rows THEN round(rr, 9) END AS rr,
  CASE WHEN positives = 0 THEN 'no_relevant' WHEN positives = n_rows THEN 'no_contrast' END AS excluded FROM ap LEFT JOIN rr USING (sample_id)""")
def candidate_ap_mrr(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.evaluate_candidates(candidates(spark, sf))
    return out.select("sample_id", r9(F.col("ap")).alias("ap"), r9(F.col("rr")).alias("rr"), "excluded")


@query("retrieval_at_k", f"""WITH {CAND_SQL},
rk AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, position) AS r, sum(label) OVER (PARTITION BY sample_id) AS total FROM cand)
SELECT sample_id, max(CASE WHEN r <= 1 THEN label ELSE 0 END) AS success_1, round(sum(CASE WHEN r <= 1 THEN label ELSE 0 END) / total, 9) AS recall_1,
  max(CASE WHEN r <= 5 THEN label ELSE 0 END) AS success_5, round(sum(CASE WHEN r <= 5 THEN label ELSE 0 END) / total, 9) AS recall_5
FROM rk WHERE total > 0 GROUP BY sample_id, total""")
def retrieval_at_k(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.retrieval_metrics(candidates(spark, sf), "sample_id", "position", (1, 5))
    return out.select("sample_id", "success_1", r9(F.col("recall_1")).alias("recall_1"), "success_5", r9(F.col("recall_5")).alias("recall_5"))


RANK_SQL = """(rank() OVER (PARTITION BY {k} ORDER BY {c}) + (count(*) OVER (PARTITION BY {k}, {c}) - 1) / 2.0::DOUBLE)"""


@query("spearman", f"""
WITH r AS (SELECT l_returnflag, {RANK_SQL.format(k='l_returnflag', c='l_quantity')} AS a, {RANK_SQL.format(k='l_returnflag', c='l_discount')} AS b FROM lineitem)
SELECT l_returnflag, round(corr(a, b), 9) AS spearman, count(*) AS n FROM r GROUP BY l_returnflag""")
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.spearman(T.load(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount")
    return out.select("l_returnflag", r9(F.col("spearman")).alias("spearman"), "n")


@query("pearson", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 9) AS pearson, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def pearson(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.pearson_by(T.load(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", r9(F.col("pearson")).alias("pearson"), "n")


@query("mse_gain", """
SELECT l_returnflag, round(avg((l_discount - l_tax) ** 2), 12) AS mse, round(avg((l_discount - 0.05::DOUBLE) ** 2), 12) AS constant_mse,
  round(1 - avg((l_discount - l_tax) ** 2) / avg((l_discount - 0.05::DOUBLE) ** 2), 9) AS reduction FROM lineitem GROUP BY l_returnflag""")
def mse_gain(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.squared_errors(T.load(spark, sf, "lineitem"), ["l_returnflag"], "l_discount", "l_tax", F.lit(0.05))
    return out.select("l_returnflag", F.round("mse", 12).alias("mse"), F.round("constant_mse", 12).alias("constant_mse"), r9(F.col("reduction")).alias("reduction"))


@query("alpha", """
WITH c AS (SELECT label, vec_id, i, embedding[i]::DOUBLE AS v FROM (SELECT *, unnest(range(1, 9)) AS i FROM embeddings)),
t AS (SELECT label, vec_id, sum(v) AS s FROM c GROUP BY ALL), whole AS (SELECT label, var_samp(s) AS vt FROM t GROUP BY label),
items AS (SELECT label, sum(v) AS vi FROM (SELECT label, i, var_samp(v) AS v FROM c GROUP BY ALL) GROUP BY label)
SELECT label, round(8.0::DOUBLE / 7.0::DOUBLE * (1 - vi / vt), 9) AS alpha, 'ok' AS status FROM whole JOIN items USING (label)""")
def alpha(spark: SparkSession, sf: str) -> DataFrame:
    """The first eight dimensions as eight wordings of one scale, per cluster label."""
    wide = T.vectors(spark, sf).select("sample_id", "label", F.posexplode(F.slice("vector", 1, 8)).alias("item", "value"))
    return metrics.cronbach_alpha(wide, ["label"], "item", "sample_id").select("label", r9(F.col("alpha")).alias("alpha"), "status")


@query("bh_fdr", """
WITH p AS (SELECT c_nationkey AS family, c_custkey AS id, CASE WHEN c_acctbal < 0 THEN NULL ELSE round(c_acctbal / 10000.0::DOUBLE, 2) END AS p FROM customer),
r AS (SELECT *, count(p) OVER (PARTITION BY family) AS m, CASE WHEN p IS NOT NULL THEN count(p) OVER (PARTITION BY family ORDER BY p) END AS i FROM p)
SELECT family, id, CASE WHEN p IS NOT NULL THEN round(least(1.0::DOUBLE, min(p * m / i) OVER (PARTITION BY family ORDER BY p DESC NULLS FIRST RANGE UNBOUNDED PRECEDING)), 9) END AS q FROM r""")
def bh_fdr(spark: SparkSession, sf: str) -> DataFrame:
    p = T.load(spark, sf, "customer").select(F.col("c_nationkey").alias("family"), F.col("c_custkey").alias("id"),
                                             F.when(F.col("c_acctbal") >= 0, F.round(F.col("c_acctbal") / 10000.0, 2)).alias("p"))
    return metrics.bh_fdr(p, ["family"]).select("family", "id", r9(F.col("q")).alias("q"))


@query("group_z", """
WITH s AS (SELECT l_shipmode, avg(l_quantity) AS m, stddev_samp(l_quantity) AS sd FROM (SELECT l_linestatus AS l_shipmode, l_quantity FROM lineitem) GROUP BY ALL),
v AS (SELECT l_linestatus AS l_shipmode, l_suppkey, avg(l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_shipmode AS l_linestatus, l_suppkey, round((v - m) / sd, 9) AS z, n FROM v JOIN s USING (l_shipmode)""")
def group_z(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.group_z(T.load(spark, sf, "lineitem"), ["l_linestatus"], "l_suppkey", "l_quantity")
    return out.select("l_linestatus", "l_suppkey", r9(F.col("z")).alias("z"), "n")


@query("paired_log_ratio", """
WITH c AS (SELECT user_id, sum(CASE WHEN event_type = 'click' THEN 1.0::DOUBLE END) AS a, sum(CASE WHEN event_type = 'view' THEN 1.0::DOUBLE END) AS b FROM events GROUP BY user_id)
SELECT user_id, round(ln(a) - ln(b), 9) AS log_ratio, CASE WHEN a IS NULL OR b IS NULL THEN 'unpaired' END AS reason FROM c""")
def paired_log_ratio(spark: SparkSession, sf: str) -> DataFrame:
    e = T.load(spark, sf, "events").select("user_id", "event_type", F.lit(1.0).alias("n"))
    out = metrics.paired_log_ratio(e, ["user_id"], "event_type", "click", "view", "n")
    return out.select("user_id", r9(F.col("log_ratio")).alias("log_ratio"), "reason")


@query("contrasts", """
SELECT vec_id::VARCHAR AS sample_id, unnest(['first', 'second']) AS dimension,
  unnest([round(embedding[1]::DOUBLE - embedding[2]::DOUBLE, 9), round(embedding[3]::DOUBLE - embedding[4]::DOUBLE, 9)]) AS contrast FROM embeddings""")
def contrasts(spark: SparkSession, sf: str) -> DataFrame:
    signs = spark.createDataFrame([("first", 0, 1.0), ("first", 1, -1.0), ("second", 2, 1.0), ("second", 3, -1.0)], "dimension string, anchor_id int, sign double")
    out = metrics.signed_contrasts(T.vector_cells(spark, sf), signs, ["sample_id"], "anchor_id")
    return out.select("sample_id", "dimension", r9(F.col("contrast")).alias("contrast"))


@query("interaction", """
SELECT o_custkey, round(sum(CASE o_orderpriority[1] WHEN '1' THEN o_totalprice END) - sum(CASE o_orderpriority[1] WHEN '2' THEN o_totalprice END)
  - sum(CASE o_orderpriority[1] WHEN '3' THEN o_totalprice END) + sum(CASE WHEN o_orderpriority[1] > '3' THEN o_totalprice END), 4) AS interaction FROM orders GROUP BY o_custkey""")
def interaction(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.substring("o_orderpriority", 1, 1)
    rows = T.load(spark, sf, "orders").select("o_custkey", F.when(kind == "1", "both").when(kind == "2", "a").when(kind == "3", "b").otherwise("neither").alias("c"), F.col("o_totalprice").alias("value"))
    return metrics.interaction_scores(rows, ["o_custkey"], "c").select("o_custkey", F.round("interaction", 4).alias("interaction"))


@query("judged_pairs", """
SELECT l_returnflag AS target, least(l_partkey, l_suppkey) AS "first", greatest(l_partkey, l_suppkey) AS "second", round(avg(r), 9) AS rating, count(*) AS n
FROM (SELECT *, (l_quantity::BIGINT % 5) AS r FROM lineitem) WHERE r <> 0 GROUP BY ALL""")
def judged_pairs(spark: SparkSession, sf: str) -> DataFrame:
    j = T.load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("target"), "l_partkey", "l_suppkey", (F.col("l_quantity").cast("bigint") % 5).alias("judgment"))
    out = metrics.judged_pairs(j, "target", "l_partkey", "l_suppkey")
    return out.select("target", "first", "second", r9(F.col("rating")).alias("rating"), "n")


@query("ari", """
WITH c AS (SELECT lang, source, count(*)::DOUBLE AS n FROM documents GROUP BY ALL), x AS (SELECT sum(n * (n - 1) / 2) AS x, sum(n) AS t FROM c),
a AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT sum(n) AS n FROM c GROUP BY lang)), b AS (SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT sum(n) AS n FROM c GROUP BY source))
SELECT round((x - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)), 9) AS ari, t::BIGINT AS n_rows FROM x, a, b""")
def ari(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.adjusted_rand(T.load(spark, sf, "documents"), "lang", "source").select(r9(F.col("ari")).alias("ari"), F.col("rows").alias("n_rows"))


@query("group_difference", """
SELECT i - 1 AS dimension, round(avg(v) FILTER (WHERE label = 0), 9) AS mean_a, round(avg(v) FILTER (WHERE label = 1), 9) AS mean_b,
  round(avg(v) FILTER (WHERE label = 0) - avg(v) FILTER (WHERE label = 1), 9) AS difference
FROM (SELECT label, i, embedding[i]::DOUBLE AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)) GROUP BY i""")
def group_difference(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.group_difference(T.vector_cells(spark, sf), "anchor_id", "label", 0, 1)
    return out.select(F.col("anchor_id").cast("bigint").alias("dimension"), *[r9(F.col(c)).alias(c) for c in ("mean_a", "mean_b", "difference")])


@query("many_to_one", "SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def many_to_one(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.load(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return metrics.many_to_one(rows, T.load(spark, sf, "nation"), "n_nationkey", "n_name").select("c_custkey", "n_name")


@query("pair_endpoints", """
SELECT p.doc_id AS "left", p.doc_id + 1 AS "right", p.lang FROM documents p JOIN documents q ON q.doc_id = p.doc_id + 1 WHERE p.lang = q.lang""")
def pair_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    d = T.load(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), "lang")
    known = d.select((F.col("sample_id") - 1).alias("left"))
    pairs = d.select(F.col("sample_id").alias("left"), (F.col("sample_id") + 1).alias("right"), "lang").join(known, "left", "left_semi")
    return metrics.pair_endpoints(pairs, d, "lang").select("left", "right", "lang")


@query("bridge_reliability", S.with_scores(f"""
SELECT anchor_id, "first", "second", CASE WHEN min(ra) < max(ra) AND min(rb) < max(rb) THEN round(corr(ra, rb), 9) END AS spearman, count(*) AS n FROM r GROUP BY ALL""", f"""
p AS (SELECT x.anchor_id, x.bridge_id AS "first", y.bridge_id AS "second", round(x.raw_logp, 9) AS a, round(y.raw_logp, 9) AS b
  FROM scores x JOIN scores y ON x.sample_id = y.sample_id AND x.anchor_id = y.anchor_id AND x.bridge_id < y.bridge_id)""", f"""
r AS (SELECT anchor_id, "first", "second", {RANK_SQL.format(k='anchor_id, "first", "second"', c='a')} AS ra, {RANK_SQL.format(k='anchor_id, "first", "second"', c='b')} AS rb FROM p)"""))
def bridge_reliability(spark: SparkSession, sf: str) -> DataFrame:
    scores = T.scores(spark, sf, keep=()).withColumn("raw_logp", r9(F.col("raw_logp")))
    out = metrics.bridge_reliability(scores)
    return out.select("anchor_id", "first", "second", r9(F.col("spearman")).alias("spearman"), "n")


@query("template_radii", S.with_scores("""
SELECT sample_id, round(max(d), 8) AS radius FROM (SELECT sample_id, bridge_id, sqrt(sum((raw_logp - m) ** 2)) AS d
  FROM (SELECT *, avg(raw_logp) OVER (PARTITION BY sample_id, anchor_id) AS m FROM scores) GROUP BY ALL) GROUP BY sample_id"""))
def template_radii(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.template_radii(T.scores(spark, sf, keep=())).select("sample_id", F.round("radius", 8).alias("radius"))


@query("token_count_summary", S.with_scores("SELECT anchor_id, bridge_id, min(token_count)::INTEGER AS least, max(token_count)::INTEGER AS most, avg(token_count) AS mean FROM scores GROUP BY ALL"))
def token_count_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.token_count_summary(T.scores(spark, sf, keep=()))


@query("coverage_ledger", """
WITH f AS (SELECT conv_id, count(*) AS found FROM conversations GROUP BY conv_id), e AS (SELECT conv_id, max(turn) + 1 AS expected FROM conversations GROUP BY conv_id)
SELECT conv_id, found, expected, found = expected AS complete FROM f JOIN e USING (conv_id)""")
def coverage_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of each conversation against its highest turn number."""
    c = T.load(spark, sf, "conversations")
    return metrics.coverage_ledger(c, c.groupBy("conv_id").agg((F.max("turn") + 1).alias("expected")), ["conv_id"])


@query("cost_ledger", """
SELECT status, count(*) AS jobs, round(sum(hours), 6) AS hours FROM (SELECT user_id, arg_max(event_type, event_id) AS status, max(value) AS hours FROM events GROUP BY user_id) GROUP BY status""")
def cost_ledger(spark: SparkSession, sf: str) -> DataFrame:
    e = T.load(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("status"), F.col("value").alias("hours"))
    return metrics.cost_ledger(e, "user_id", "status", "event_id", ["hours"]).select("status", "jobs", F.round("hours", 6).alias("hours"))
