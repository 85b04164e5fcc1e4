"""Queries: choice of wordings, uncertainty and controls of networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptframe.functions.numeric import r9
from conceptframe.operators import selection, uncertainty
from conceptframe.operators.grid import Bridge
from conceptframe.operators.resample import REPLICATES
from conceptframe.plans import sqltext as S
from conceptframe.plans.geometry import LONG
from conceptframe.plans.registry import query
from conceptframe.sources import tables as T

# Fixed study: eight wordings of eight concepts; the coordinates of a vector are their scores.
WORDINGS = tuple(Bridge(f"w{i}", text) for i, text in enumerate((
    "Content associated with the idea of:\n", "This passage is associated with:\n", "A reader would think of:\n", "The text brings to mind:\n",
    "Words associated with this passage are:\n", "This is about:\n", "The idea behind the text is:\n", "What a reader takes from this is:\n")))
N = len(WORDINGS)


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return T.vector_cells(spark, sf).select("sample_id", F.concat(F.lit("c"), F.col("anchor_id") % N).alias("anchor_id"), F.concat(F.lit("w"), F.expr(f"anchor_id div {N}")).alias("bridge_id"), "value")


def concepts(spark: SparkSession, sf: str) -> DataFrame:
    """A concept applies to the cluster of its number."""
    v = T.vectors(spark, sf)
    return v.select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(N - 1))).alias("j"), F.col("label").alias("_l")).select(
        "sample_id", F.concat(F.lit("c"), "j").alias("anchor_id"), (F.col("_l") == F.col("j")).cast("int").alias("label"))


@query("eligible_anchors", """
WITH l AS (SELECT unnest(['quality', 'toxic', 'both']) AS anchor_id, unnest([quality, toxic, quality * toxic]) AS label FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)
SELECT anchor_id, sum(label)::BIGINT AS positives, count(*) - sum(label)::BIGINT AS negatives, sum(label) >= 5 AND count(*) - sum(label) >= 5 AS eligible FROM l GROUP BY anchor_id""")
def eligible_anchors(spark: SparkSession, sf: str) -> DataFrame:
    both = T.load(spark, sf, "labels").filter("quality is not null and toxic is not null")
    pairs = F.array(*[F.struct(F.lit(n).alias("anchor_id"), c.alias("label")) for n, c in (("quality", F.col("quality")), ("toxic", F.col("toxic")), ("both", F.col("quality") * F.col("toxic")))])
    return selection.eligible_anchors(both.select(F.inline(pairs)))


FORBIDDEN = ("red", "blue steel", "铁")
EDGE = r"(^|[^\p{L}\p{N}_])"
END = r"($|[^\p{L}\p{N}_])"


@query("bridge_rules", f"""
WITH w AS (SELECT p_partkey, p_name || ' is associated with' || CASE WHEN p_size % 7 = 0 THEN ':' WHEN p_size % 7 = 1 THEN ' <|end|>:' || chr(10) WHEN p_size % 7 = 2 THEN repeat(' it', p_size * 10) || ':' || chr(10) ELSE ':' || chr(10) END AS prefix,
  CASE WHEN p_size % 11 = 0 THEN 'supports' ELSE 'associated_with' END AS relation, p_size FROM part)
SELECT p_partkey, CASE WHEN relation <> 'associated_with' THEN 'relation_or_language_changed' WHEN right(prefix, 1) <> chr(10) OR length(prefix) > 512 THEN 'invalid_delimiter_or_length'
  WHEN contains(lower(prefix), '<|') THEN 'control_token' WHEN NOT contains(prefix, 'associated with') THEN 'protected_relation_changed'
  WHEN regexp_matches(lower(prefix), '{EDGE}red{END}') OR regexp_matches(lower(prefix), '{EDGE}blue steel{END}') OR contains(prefix, '铁') THEN 'answer_surface_inserted' END AS rejected FROM w""")
def bridge_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Part names as candidate wordings, some cut, marked, too long or of another relation."""
    size = F.col("p_size") % 7
    tail = F.when(size == 0, ":").when(size == 1, " <|end|>:\n").when(size == 2, F.concat(F.repeat(F.lit(" it"), F.col("p_size") * 10), F.lit(":\n"))).otherwise(":\n")
    w = T.load(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(" is associated with"), tail).alias("prefix"),
                                         F.when(F.col("p_size") % 11 == 0, "supports").otherwise("associated_with").alias("relation"), F.lit("en").alias("language"))
    return w.select("p_partkey", selection.rejection("associated_with", "en", "associated with", FORBIDDEN).alias("rejected"))


@query("lexical_diversity", r"""
WITH w AS (SELECT n_regionkey, n_nationkey, list_distinct(regexp_extract_all(lower(n_name || ' of ' || r_name), '[\p{L}\p{N}_]+')) AS w FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT a.n_regionkey, (SELECT count(*) FROM nation n WHERE n.n_regionkey = a.n_regionkey)::INTEGER AS wordings,
  round(avg(1 - len(list_intersect(a.w, b.w)) / greatest(1, len(list_distinct(a.w || b.w)))), 9) AS lexical_diversity
FROM w a JOIN w b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey GROUP BY a.n_regionkey""")
def lexical_diversity(spark: SparkSession, sf: str) -> DataFrame:
    w = T.load(spark, sf, "nation").join(F.broadcast(T.load(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    w = w.select("n_regionkey", F.concat("n_name", F.lit(" of "), "r_name").alias("prefix"), F.lit("en").alias("language"))
    return selection.lexical_diversity(w, ["n_regionkey"]).withColumn("lexical_diversity", r9(F.col("lexical_diversity")))


MEASURES = f"""
c AS (SELECT vec_id, label, i % {N} AS j, i // {N} AS b, v FROM ({LONG})),
e AS (SELECT j, count_if(label = j) AS p, count(*) AS n FROM (SELECT DISTINCT vec_id, label, j FROM c) GROUP BY j HAVING p >= 5 AND n - p >= 5),
sets AS (SELECT row_number() OVER () AS i, x, y, z FROM (SELECT x, y, z FROM range({N}) AS a(x), range({N}) AS b(y), range({N}) AS c(z) WHERE x < y AND y < z)),
wide AS (SELECT vec_id, j, any_value(label) = j AS hit, list(v ORDER BY b) AS v FROM c SEMI JOIN e USING (j) GROUP BY vec_id, j),
s AS (SELECT i, j, hit, (v[x + 1] + v[y + 1] + v[z + 1]) / 3 AS s FROM wide, sets),
run AS (SELECT i, j, hit, sum(hit::INT) OVER w AS cy, count(*) OVER w AS cn FROM s WINDOW w AS (PARTITION BY i, j ORDER BY s DESC RANGE UNBOUNDED PRECEDING)),
ap AS (SELECT i, j, sum(CASE WHEN hit THEN cy / cn END) / count_if(hit) AS ap FROM run GROUP BY i, j),
validity AS (SELECT i, avg(ap) AS validity FROM ap GROUP BY i),
ranks AS (SELECT vec_id, j, b, v, rank() OVER (PARTITION BY j, b ORDER BY v) + (count(*) OVER (PARTITION BY j, b, v) - 1) / 2.0::DOUBLE AS r FROM c SEMI JOIN e USING (j)),
pairs AS (SELECT p.j, p.b, q.b AS c, corr(p.r, q.r) AS rho, covar_samp(p.v, q.v) AS cov FROM ranks p JOIN ranks q ON p.vec_id = q.vec_id AND p.j = q.j AND p.b <= q.b GROUP BY ALL),
inside AS (SELECT i, b, c FROM (SELECT i, unnest([x, x, y]) AS b, unnest([y, z, z]) AS c FROM sets) UNION ALL SELECT i, unnest([x, y, z]) AS b, unnest([x, y, z]) AS c FROM sets),
per AS (SELECT i, j, avg(rho) FILTER (WHERE b <> c) AS rho, 1.5::DOUBLE * (1 - sum(cov) FILTER (WHERE b = c) / sum(CASE WHEN b = c THEN cov ELSE 2 * cov END)) AS alpha FROM inside JOIN pairs USING (b, c) GROUP BY i, j),
agreed AS (SELECT i, (1 + quantile_cont(rho, 0.5)) / 2 AS reliability, quantile_cont(alpha, 0.5) AS alpha FROM per GROUP BY i),
texts(b, w) AS (VALUES {', '.join(f"({i}, list_distinct(regexp_extract_all(lower({S.text_literal(b.prefix)}), '[a-z]+')))" for i, b in enumerate(WORDINGS))}),
words AS (SELECT i, avg(1 - len(list_intersect(p.w, q.w)) / greatest(1, len(list_distinct(p.w || q.w)))) AS lexical_diversity
  FROM inside JOIN texts p USING (b) JOIN texts q ON q.b = inside.c WHERE inside.b <> inside.c GROUP BY i),
m AS (SELECT 'w' || x || ',w' || y || ',w' || z AS bridges, validity, reliability, alpha, lexical_diversity FROM sets JOIN validity USING (i) JOIN agreed USING (i) JOIN words USING (i))"""
ROUNDED = ["validity", "reliability", "alpha", "lexical_diversity"]


@query("subset_measures", f"WITH {MEASURES} SELECT bridges, {', '.join(f'round({c}, 9) AS {c}' for c in ROUNDED)}, round(0.8::DOUBLE * validity + 0.2::DOUBLE * reliability, 9) AS objective FROM m")
def subset_measures(spark: SparkSession, sf: str) -> DataFrame:
    """All subsets of three of the eight wordings."""
    from itertools import combinations
    eligible = selection.eligible_anchors(concepts(spark, sf)).filter("eligible")
    packed = selection.packed_cells(cells(spark, sf), concepts(spark, sf), [b.id for b in WORDINGS]).join(F.broadcast(eligible.select("anchor_id")), "anchor_id", "left_semi")
    held = selection.written(packed, "cells")
    out = selection.subset_measures(held, selection.pair_statistics(held), WORDINGS, list(combinations(range(N), 3)))
    return out.select(F.concat_ws(",", "bridges").alias("bridges"), *[r9(F.col(c)).alias(c) for c in [*ROUNDED, "objective"]])


AIMS = {"reference_guided": "0.8::DOUBLE * validity + 0.2::DOUBLE * reliability", "validity": "validity", "reliability": "reliability", "alpha": "alpha", "random": "0.0::DOUBLE"}


def _best(mode: str, aim: str) -> str:
    tie = S.digest("'42'", "bridges") + "," if mode == "random" else ""
    return f"""SELECT * FROM (SELECT '{mode}' AS mode, 'ok' AS status, bridges, {', '.join(f'round({c}, 9) AS {c}' for c in ROUNDED)}, round({aim}, 9) AS objective FROM m
  ORDER BY round({aim}, 12) DESC, {tie} round(m.lexical_diversity, 12) DESC, bridges LIMIT 1)"""


@query("select_bridge_subset", f"WITH {MEASURES} " + " UNION ALL ".join(_best(*a) for a in AIMS.items()))
def select_bridge_subset(spark: SparkSession, sf: str) -> DataFrame:
    """The chosen subset under each objective."""
    found = []
    scores, labels = selection.written(cells(spark, sf), "scores"), selection.written(concepts(spark, sf), "labels")
    searches = [selection.Search(mode, rounds=0) for mode in selection.MODES]
    for mode, one in zip(selection.MODES, selection.select_bridge_subsets(scores, labels, [WORDINGS], searches)):
        found.append((mode, one.status, ",".join(one.bridges), *[one.measures[c] for c in [*ROUNDED, "objective"]]))
    out = spark.createDataFrame(found, "mode string, status string, bridges string, " + ", ".join(f"{c} double" for c in [*ROUNDED, "objective"]))
    return out.select("mode", "status", "bridges", *[r9(F.col(c)).alias(c) for c in [*ROUNDED, "objective"]])


# --- networks ----------------------------------------------------------------------------------

GROUPS = 20
#: Every draw of whole groups: moments of each pair of columns, then its correlations in both networks.
DRAWN = f"""
c AS (SELECT vec_id, vec_id % {GROUPS} AS g, i, v, v * v AS u FROM ({LONG})),
n AS (SELECT g, row_number() OVER (ORDER BY sha256(g::VARCHAR)) - 1 AS k FROM (SELECT DISTINCT g FROM c)),
d AS (SELECT r, ('0x' || substr({S.digest("'42'", 'r', 'pick')}, 1, 15))::BIGINT % (SELECT count(*) FROM n) AS k FROM range({REPLICATES}) AS t(r), range((SELECT count(*) FROM n)) AS u(pick)),
w AS (SELECT r, g, count(*) AS w FROM d JOIN n USING (k) GROUP BY ALL UNION ALL SELECT -1, g, 1 FROM n),
z AS (SELECT vec_id, g, i, v - avg(v) OVER (PARTITION BY i) AS v, u - avg(u) OVER (PARTITION BY i) AS u FROM c),
one AS (SELECT r, i, sum(w * n) AS n, sum(w * v) AS v, sum(w * vv) AS vv, sum(w * u) AS u, sum(w * uu) AS uu
  FROM w JOIN (SELECT g, i, count(*) AS n, sum(v) AS v, sum(v * v) AS vv, sum(u) AS u, sum(u * u) AS uu FROM z GROUP BY ALL) USING (g) GROUP BY r, i),
two AS (SELECT r, i, j, sum(w * v) AS v, sum(w * u) AS u FROM w JOIN (SELECT x.g, x.i, y.i AS j, sum(x.v * y.v) AS v, sum(x.u * y.u) AS u FROM z x JOIN z y ON x.vec_id = y.vec_id AND x.i < y.i GROUP BY ALL) USING (g) GROUP BY r, i, j),
e AS MATERIALIZED (SELECT two.r, two.i AS a, two.j AS b, (two.v - x.v * y.v / x.n) / sqrt((x.vv - x.v * x.v / x.n) * (y.vv - y.v * y.v / y.n)) AS p,
  (two.u - x.u * y.u / x.n) / sqrt((x.uu - x.u * x.u / x.n) * (y.uu - y.u * y.u / y.n)) AS q FROM two JOIN one x ON x.r = two.r AND x.i = two.i JOIN one y ON y.r = two.r AND y.i = two.j)"""


def _edge_result(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = T.vectors(spark, sf).select((F.col("sample_id").cast("bigint") % GROUPS).alias("g"), "vector", F.transform("vector", lambda x: x * x).alias("squares"))
    return uncertainty.edge_bootstrap(v, "g", "vector", "squares")


@query("edge_bootstrap", f"""WITH {DRAWN},
t AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY abs(p) DESC, a, b) <= 20 AND p <> 0 AS top FROM e)
SELECT a::INTEGER AS a, b::INTEGER AS b, round(max(CASE WHEN r < 0 THEN p END), 9) AS weight, round(quantile_cont(CASE WHEN r >= 0 THEN p END, 0.025), 9) AS ci_lower,
  round(quantile_cont(CASE WHEN r >= 0 THEN p END, 0.975), 9) AS ci_upper, round(count_if(r >= 0 AND top) / count_if(r >= 0), 9) AS top_frequency FROM t GROUP BY a, b""")
def edge_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    edges, _ = _edge_result(spark, sf)
    return edges.select("a", "b", *[r9(F.col(c)).alias(c) for c in ("weight", "ci_lower", "ci_upper", "top_frequency")])


@query("edge_bootstrap_summary", f"""WITH {DRAWN},
k AS (SELECT r, rank() OVER (PARTITION BY r ORDER BY p) + (count(*) OVER (PARTITION BY r, p) - 1) / 2.0::DOUBLE AS p, rank() OVER (PARTITION BY r ORDER BY q) + (count(*) OVER (PARTITION BY r, q) - 1) / 2.0::DOUBLE AS q FROM e),
s AS (SELECT r, corr(p, q) AS rho FROM k GROUP BY r)
SELECT round(max(CASE WHEN r < 0 THEN rho END), 9) AS edge_weight_spearman, round(quantile_cont(CASE WHEN r >= 0 THEN rho END, 0.025), 9) AS ci_lower,
  round(quantile_cont(CASE WHEN r >= 0 THEN rho END, 0.975), 9) AS ci_upper, count_if(r >= 0) AS valid, 0::BIGINT AS invalid FROM s""")
def edge_bootstrap_summary(spark: SparkSession, sf: str) -> DataFrame:
    _, summary = _edge_result(spark, sf)
    return summary.select(*[r9(F.col(c)).alias(c) for c in ("edge_weight_spearman", "ci_lower", "ci_upper")], "valid", F.col("invalid").cast("bigint").alias("invalid"))


def _moved(who: str) -> str:
    """Rows in digest order, and where each value goes."""
    return f"""c AS (SELECT vec_id::VARCHAR AS sample_id, i, v FROM ({LONG})),
n AS (SELECT sample_id, row_number() OVER (ORDER BY sha256(sample_id)) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT sample_id FROM c)),
f AS (SELECT i, n, ('0x' || substr({S.digest("'42'", "'factor'", who)}, 1, 15))::BIGINT % {1 << uncertainty.FACTOR_BITS} + 1 AS f, ('0x' || substr({S.digest("'42'", "'shift'", who)}, 1, 15))::BIGINT % n AS s
  FROM (SELECT DISTINCT i FROM c), (SELECT any_value(n) AS n FROM n)),
g AS (SELECT i, n, list_filter(range(f, f + 1000), lambda x: gcd(x, n) = 1)[1] AS f, s FROM f),
moved AS (SELECT g.i, (g.f * n.p + s) % g.n AS p, v FROM c JOIN n USING (sample_id) JOIN g USING (i))"""


@query("column_null", f"WITH {_moved('i')} SELECT sample_id, list(v ORDER BY i) AS vector FROM moved JOIN n USING (p) GROUP BY sample_id")
def column_null(spark: SparkSession, sf: str) -> DataFrame:
    return uncertainty.column_null(T.vectors(spark, sf), "sample_id", "vector")


@query("common_row_check", f"""WITH {_moved("'0'")},
o AS (SELECT x.i, y.i AS j, corr(x.v, y.v) AS w FROM c x JOIN c y ON x.sample_id = y.sample_id AND x.i < y.i GROUP BY ALL),
m AS (SELECT x.i, y.i AS j, corr(x.v, y.v) AS w FROM moved x JOIN moved y ON x.p = y.p AND x.i < y.i GROUP BY ALL)
SELECT count(*) AS edges, max(abs(o.w - m.w)) <= 1e-12::DOUBLE AS ok FROM o FULL JOIN m USING (i, j)""")
def common_row_check(spark: SparkSession, sf: str) -> DataFrame:
    return uncertainty.common_row_check(T.vectors(spark, sf), "sample_id", "vector").select("edges", "ok")
