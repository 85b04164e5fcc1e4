"""Queries: change of targets between two periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptframe.functions.numeric import r9
from conceptframe.operators import shift
from conceptframe.operators.resample import REPLICATES
from conceptframe.plans import sqltext as S
from conceptframe.plans.registry import query
from conceptframe.sources import tables as T

# The clusters as targets, the last digits of the number as periods, sources and genres.
SOURCES, GENRES = 24, 3
ROWS = f"SELECT label::VARCHAR AS target, (vec_id % 2)::VARCHAR AS period, (vec_id % {SOURCES})::VARCHAR AS unit, (vec_id % {GENRES})::VARCHAR AS genre, embedding::DOUBLE[] AS v FROM embeddings"


def usages(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("sample_id").cast("bigint")
    return T.vectors(spark, sf).select(F.col("label").cast("string").alias("target"), (number % 2).cast("string").alias("period"), (number % SOURCES).cast("string").alias("unit"),
                                       (number % GENRES).cast("string").alias("genre"), "vector")


@query("energy_distance", f"""WITH x AS ({ROWS}),
m AS (SELECT a.target, a.period AS p, b.period AS q, avg(list_distance(a.v, b.v)) AS d FROM x a JOIN x b USING (target) GROUP BY ALL)
SELECT target, (SELECT count(*) FROM x WHERE x.target = m.target AND period = '0') AS n_0, (SELECT count(*) FROM x WHERE x.target = m.target AND period = '1') AS n_1,
  round(sum(CASE WHEN p = q THEN -d ELSE d END), 9) AS energy_distance FROM m GROUP BY target""")
def energy_distance(spark: SparkSession, sf: str) -> DataFrame:
    out = shift.energy_distance(usages(spark, sf), "target", F.col("period") == "1", "vector")
    return out.select("target", "n_0", "n_1", r9(F.col("energy_distance")).alias("energy_distance"))


def number(*parts: str) -> str:
    return f"('0x' || substr({S.digest(*parts)}, 1, 15))::BIGINT"


def _sql(stratum: str, halves: int) -> str:
    return f"""WITH x AS ({ROWS}),
c AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY period, unit) - 1 AS cell, row_number() OVER (PARTITION BY target, period ORDER BY unit) - 1 AS k,
  count(*) OVER (PARTITION BY target, period) AS m FROM (SELECT target, period, unit, {stratum} AS g, count(*) AS n FROM x GROUP BY ALL)),
z AS (SELECT DISTINCT target, period, m FROM c),
d AS MATERIALIZED (SELECT a.target, ca.cell AS a, cb.cell AS b, sum(list_distance(a.v, b.v)) AS s FROM x a JOIN x b USING (target)
  JOIN c ca ON ca.target = a.target AND ca.period = a.period AND ca.unit = a.unit JOIN c cb ON cb.target = b.target AND cb.period = b.period AND cb.unit = b.unit GROUP BY ALL),
picks AS (SELECT target, period, r, {number("'42'", "'boot'", "target", "period", "r", "pick")} % m AS k FROM z, range({REPLICATES}) AS t(r), range(m) AS u(pick)),
boot AS (SELECT 'boot' AS kind, target, r, cell, c.period AS side, count(*)::DOUBLE AS w, any_value(n) AS n FROM picks JOIN c USING (target, period, k) GROUP BY target, r, cell, c.period),
perm AS (SELECT 'perm' AS kind, target, r, cell, CASE WHEN row_number() OVER (PARTITION BY target, r, g ORDER BY {S.digest("'42'", "'perm'", "target", "r", "unit")}) <= f THEN '0' ELSE '1' END AS side, 1.0::DOUBLE AS w, n
  FROM (SELECT *, count_if(period = '0') OVER (PARTITION BY target, g) AS f FROM c), range({REPLICATES}) AS t(r)),
half AS (SELECT 'half' || period AS kind, target, r, cell, CASE WHEN row_number() OVER (PARTITION BY target, period, r ORDER BY {S.digest("'42'", "'half'", "target", "period", "r", "unit")}) <= m // 2 THEN '0' ELSE '1' END AS side,
  1.0::DOUBLE AS w, n FROM c, range({halves}) AS t(r) WHERE m >= 2),
w AS (SELECT kind, target, r, cell, (CASE side WHEN '0' THEN 1 ELSE -1 END) * w / sum(w * n) OVER (PARTITION BY kind, target, r, side) AS w FROM (
  SELECT 'point' AS kind, target, 0 AS r, cell, period AS side, 1.0::DOUBLE AS w, n FROM c UNION ALL SELECT * FROM boot UNION ALL SELECT * FROM perm UNION ALL SELECT * FROM half)),
q AS MATERIALIZED (SELECT kind, target, r, greatest(-sum(e.w * f.w * s), 0) AS energy FROM w e JOIN w f USING (kind, target, r) JOIN d USING (target) WHERE d.a = e.cell AND d.b = f.cell GROUP BY ALL),
i AS (SELECT target, unnest(range(1, len(v) + 1)) AS i, v, period, unit FROM x),
sums AS (SELECT target, cell, i, sum(v[i]) AS v FROM i JOIN c USING (target, period, unit) GROUP BY ALL),
cen AS (SELECT kind, target, r, sqrt(sum(e * e)) AS centroid FROM (SELECT kind, target, r, i, sum(w * v) AS e FROM w JOIN sums USING (target, cell) WHERE kind IN ('point', 'boot') GROUP BY ALL) GROUP BY ALL),
p AS (SELECT target, any_value(energy) AS e FROM q WHERE kind = 'point' GROUP BY target),
pv AS (SELECT target, (1 + count_if(energy >= e - 1e-12::DOUBLE)) / (1 + count(*)) AS p FROM q JOIN p USING (target) WHERE kind = 'perm' GROUP BY target),
qv AS (SELECT a.target, any_value(a.p) AS p, least(1, min(b.p * (SELECT count(*) FROM pv) / (SELECT count(*) FROM pv x WHERE x.p <= b.p))) AS q FROM pv a JOIN pv b ON b.p >= a.p GROUP BY a.target)
SELECT target, any_value(n_units_0) AS n_units_0, any_value(n_units_1) AS n_units_1, round(any_value(e), 9) AS energy_distance, round(any_value(centroid), 9) AS centroid_distance,
  round(any_value(p), 9) AS p, round(any_value(q), 9) AS q, any_value(el) AS energy_ci_lower, any_value(eu) AS energy_ci_upper, any_value(cl) AS centroid_ci_lower, any_value(cu) AS centroid_ci_upper,
  any_value(h) AS within_period_energy
FROM p JOIN qv USING (target) JOIN (SELECT target, centroid FROM cen WHERE kind = 'point') USING (target)
  JOIN (SELECT target, count_if(period = '0') AS n_units_0, count_if(period = '1') AS n_units_1 FROM c GROUP BY target) USING (target)
  JOIN (SELECT target, round(quantile_cont(energy, 0.025), 9) AS el, round(quantile_cont(energy, 0.975), 9) AS eu FROM q WHERE kind = 'boot' GROUP BY target) USING (target)
  JOIN (SELECT target, round(quantile_cont(centroid, 0.025), 9) AS cl, round(quantile_cont(centroid, 0.975), 9) AS cu FROM cen WHERE kind = 'boot' GROUP BY target) USING (target)
  LEFT JOIN (SELECT target, round(avg(energy), 9) AS h FROM q WHERE kind LIKE 'half%' GROUP BY target) USING (target)
GROUP BY target"""


def shown(out: DataFrame) -> DataFrame:
    exact = ["energy_distance", "centroid_distance", "p", "q", "energy_ci_lower", "energy_ci_upper", "centroid_ci_lower", "centroid_ci_upper", "within_period_energy"]
    return out.select("target", "n_units_0", "n_units_1", *[r9(F.col(c)).alias(c) for c in exact])


@query("semantic_shift", _sql("''", 0))
def semantic_shift(spark: SparkSession, sf: str) -> DataFrame:
    return shown(shift.semantic_shift(usages(spark, sf), "target", "period", "unit", "vector"))


@query("source_shift", _sql("genre", shift.HALVES))
def source_shift(spark: SparkSession, sf: str) -> DataFrame:
    """Periods dealt anew inside genres; two genres of three have sources of both periods."""
    return shown(shift.source_shift(usages(spark, sf), "target", "period", "unit", "vector", "genre"))
