"""Queries: uncertainty over targets, draws of edges' sources, feature tables, ranking in two stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptframe.functions.hashing import digest, fraction52
from conceptframe.functions.numeric import r9
from conceptframe.operators import features, targets
from conceptframe.operators.resample import REPLICATES
from conceptframe.plans import sqltext as S
from conceptframe.plans.geometry import LONG
from conceptframe.plans.registry import query
from conceptframe.sources import tables as T

# Suppliers as targets: a metric, another one, and the criterion.
MEASURED = "SELECT l_suppkey, avg(l_extendedprice / l_quantity) AS a, avg(l_discount) AS b, avg(l_quantity) AS y FROM lineitem GROUP BY l_suppkey"
DRAWN = f"""g AS (SELECT *, row_number() OVER (ORDER BY sha256(l_suppkey::VARCHAR)) - 1 AS k, count(*) OVER () AS n FROM ({MEASURED})),
d AS (SELECT r, ('0x' || substr({S.digest("'42'", 'r', 'pick')}, 1, 15))::BIGINT % n AS k FROM range({REPLICATES}) AS t(r), (SELECT any_value(n) AS n, unnest(range(any_value(n))) AS pick FROM g)),
x AS (SELECT r, a, b, y FROM d JOIN g USING (k) UNION ALL SELECT -1, a, b, y FROM g)"""
ENDS = ("estimate", "lower", "upper")


def _rank(c: str) -> str:
    return f"rank() OVER (PARTITION BY r ORDER BY {c}) + (count(*) OVER (PARTITION BY r, {c}) - 1) / 2.0::DOUBLE AS {c}"


def _interval(value: str, source: str) -> str:
    return f"""SELECT round(max(CASE WHEN r < 0 THEN v END), 9) AS estimate, round(quantile_cont(CASE WHEN r >= 0 THEN v END, 0.025), 9) AS lower,
  round(quantile_cont(CASE WHEN r >= 0 THEN v END, 0.975), 9) AS upper, count(CASE WHEN r >= 0 THEN v END) AS valid, 'ok' AS status FROM (SELECT r, {value} AS v FROM {source} GROUP BY r)"""


def measured(spark: SparkSession, sf: str) -> DataFrame:
    return T.load(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("a"), F.avg("l_discount").alias("b"), F.avg("l_quantity").alias("y"))


def shown(out: DataFrame) -> DataFrame:
    return out.select(*[r9(F.col(c)).alias(c) for c in ENDS], "valid", "status")


@query("target_pearson", f"WITH {DRAWN} {_interval('corr(a, y)', 'x')}")
def target_pearson(spark: SparkSession, sf: str) -> DataFrame:
    return shown(targets.target_bootstrap(measured(spark, sf), "l_suppkey", "a", "y"))


@query("target_spearman", f"WITH {DRAWN}, k AS (SELECT r, {_rank('a')}, {_rank('y')} FROM x) {_interval('corr(a, y)', 'k')}")
def target_spearman(spark: SparkSession, sf: str) -> DataFrame:
    return shown(targets.target_bootstrap(measured(spark, sf), "l_suppkey", "a", "y", "spearman"))


@query("target_difference", f"WITH {DRAWN} {_interval('corr(a, y) - corr(b, y)', 'x')}")
def target_difference(spark: SparkSession, sf: str) -> DataFrame:
    return shown(targets.target_difference(measured(spark, sf), "l_suppkey", "a", "b", "y"))


@query("endpoint_counts", f"""WITH u AS (SELECT DISTINCT (vec_id % 24)::VARCHAR AS u, vec_id % 2 AS p FROM embeddings),
n AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY sha256(u)) - 1 AS k, count(*) OVER (PARTITION BY p) AS n FROM u),
d AS (SELECT DISTINCT p, r, ('0x' || substr({S.digest('42 + p', 'r', 'pick')}, 1, 15))::BIGINT % n AS k FROM (SELECT DISTINCT p, n FROM n), range({REPLICATES}) AS t(r), range(n) AS q(pick)),
h AS (SELECT u, r FROM d JOIN n USING (p, k)),
pairs AS (SELECT x.u AS ua, y.u AS ub, count(*) AS together FROM h x JOIN h y USING (r) GROUP BY ALL)
SELECT a.vec_id AS a, b.vec_id AS b, coalesce(together, 0) AS together, coalesce(together, 0) / {REPLICATES} AS frequency
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 7 LEFT JOIN pairs ON ua = (a.vec_id % 24)::VARCHAR AND ub = (b.vec_id % 24)::VARCHAR""")
def endpoint_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between vectors seven apart."""
    v = T.load(spark, sf, "embeddings").select("vec_id")
    source = lambda c: (F.col(c) % 24).cast("string")
    edges = v.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 7).alias("b")).join(v.select(F.col("vec_id").alias("b")), "b")
    units = v.select(source("vec_id").alias("u"), (F.col("vec_id") % 2).alias("p"))
    out = targets.endpoint_counts(units, edges.select("a", "b", source("a").alias("ua"), source("b").alias("ub")), "u", "p", "ua", "ub")
    return out.select("a", "b", "together", "frequency")


@query("assemble_features", f"""WITH c AS (SELECT vec_id::VARCHAR AS sample_id, i, v FROM ({LONG}))
SELECT 'original' AS method, sample_id, list(v ORDER BY i) AS features, false AS direct FROM c GROUP BY sample_id
UNION ALL SELECT 'scores', sample_id, list(-v ORDER BY i DESC), true FROM c GROUP BY sample_id""")
def assemble_features(spark: SparkSession, sf: str) -> DataFrame:
    """Two methods from four shards; the second has its columns in reverse."""
    cells = T.vector_cells(spark, sf).select("sample_id", F.concat(F.lit("c"), F.lpad(F.col("anchor_id").cast("string"), 4, "0")).alias("column_id"), "anchor_id", "value")
    shards = [cells.filter(half).select(F.lit(m).alias("method"), "sample_id", "column_id", (F.col("value") * sign).alias("value"))
              for m, sign in (("original", 1.0), ("scores", -1.0)) for half in ("anchor_id % 2 = 0", "anchor_id % 2 = 1")]
    names = [r.column_id for r in cells.select("column_id").distinct().orderBy("column_id").collect()]  # one row a column
    return features.assemble_features(shards, T.vectors(spark, sf), {"original": names, "scores": names[::-1]}, direct=["scores"])


FIRST = "SELECT o_custkey AS query, o_orderkey AS candidate, round((o_totalprice % 1000) / 500 - 1, 6) AS score FROM orders"


@query("two_stage_priority", f"""WITH f AS ({FIRST}), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) <= 5 AS selected FROM f),
p AS (SELECT *, CASE WHEN selected THEN round({S.fraction52(S.digest("'42'", 'query', 'candidate'))}, 9) END AS probability FROM r)
SELECT query, candidate, score, selected, probability, round(CASE WHEN selected THEN 2 + probability ELSE score END, 9) AS priority FROM p""")
def two_stage_priority(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer, ranked by their price's last digits; the five best are judged again."""
    o = T.load(spark, sf, "orders")
    first = o.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("candidate"), F.round((F.col("o_totalprice") % 1000) / 500 - 1, 6).alias("score"))
    judged = features.best_of_each(first, "query", "candidate", "score", 5).withColumn("probability", r9(fraction52(digest(42, F.col("query"), F.col("candidate")))))
    return features.two_stage_priority(first, judged, 5).withColumn("priority", r9(F.col("priority")))
