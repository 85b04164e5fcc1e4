"""Mixing sources to target weights by a temperature.

A source's share of all tokens, raised to an exponent and normalised, is its weight. Exponent 1 keeps
the shares, 0 makes all sources equal. The exponent is bisected on a grid of 1/1024: it is the largest
one whose weights reach the target entropy (a share of the entropy of equal weights); then, if some
source would be repeated more often than `most_repeats`, the smallest larger one that keeps to that
limit. Budget: all tokens, or the number given, cut to `most_repeats` times all tokens.

A source's quota of tokens is met by permutations of its blocks of about `BLOCK_ROWS` documents: as
many whole passes as fit, then one pass that ends at the quota: blocks in the order of their digests,
and of the block that the quota cuts, documents in the order of theirs. Nothing is drawn at random:
digests of seed, pass, block and document decide, so results don't depend on partitions.

Tokens of a document: runs of `[^\\x20\\x09-\\x0D]`, and one for the document itself, so that empty ones
count. A null source is a source of its own. Rows equal in id, source and text are one unit and
come and go together. An empty table gives no rows. Other columns are not read, but stay in `mixed`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conceptframe.llm.shared import documents, kept

NAME = "op6_temperature_mix"
TARGET, MOST_REPEATS, SEED = 0.98, 4.0, "mix-1"
GRID, SECTION, BLOCK_ROWS = 1024, 32, 64
SLACK = 0.001  # of a token: a quota that is a whole number but for rounding stays that number
WORD = r"[^\x20\x09-\x0D]+"

SQL = r"""
WITH units AS (SELECT doc_id, source, md5(coalesce(text, '')) AS tie, sum(1 + len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS tokens
  FROM documents GROUP BY ALL),
sources AS (SELECT source, sum(tokens)::BIGINT AS tokens, count(*) AS n FROM units GROUP BY source),
total AS (SELECT sum(tokens)::BIGINT AS t, count(*) AS k FROM sources),
shares AS (SELECT source, tokens, n, ln(tokens::DOUBLE / t::DOUBLE) AS lp, t, k FROM sources, total),
sums AS (SELECT g, g / 1024.0::DOUBLE AS a, sum(exp(g / 1024.0::DOUBLE * lp)) AS z, sum(exp(g / 1024.0::DOUBLE * lp) * lp) AS zl, max(exp(g / 1024.0::DOUBLE * lp) * t / tokens) AS top, max(k) AS k
  FROM shares, range(0, 1025) AS r(g) GROUP BY g),
by_entropy AS (SELECT max(g) AS g FROM sums WHERE g = 0 OR ln(z) - a * zl / z >= 0.98::DOUBLE * ln(k::DOUBLE)),
chosen AS (SELECT coalesce(min(g) FILTER (WHERE top / z <= 4.0::DOUBLE), 1024) AS g FROM sums WHERE g >= (SELECT g FROM by_entropy)),
quotas AS (SELECT source, s.tokens, s.n, floor(s.t * exp(c.g / 1024.0::DOUBLE * lp) / z + 0.001::DOUBLE)::BIGINT AS quota, ceil(s.n / 64.0)::BIGINT AS blocks
  FROM shares s, chosen c JOIN sums ON sums.g = c.g),
placed AS (SELECT u.doc_id, u.source, u.tie, u.tokens, quota // q.tokens AS passes, quota % q.tokens AS rest,
  (('0x' || substr(md5('mix-1' || '|' || coalesce(u.doc_id::VARCHAR, '') || '|' || tie), 1, 15))::BIGINT % blocks) AS block
  FROM units u JOIN quotas q ON u.source IS NOT DISTINCT FROM q.source),
blocks AS (SELECT source, block, passes, rest, sum(tokens) AS tokens, md5('mix-1' || '|block|' || coalesce(source, '') || '|' || passes || '|' || block) AS h FROM placed GROUP BY source, block, passes, rest),
ordered AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY h, block) - tokens AS before FROM blocks),
docs AS (SELECT p.*, o.before, o.tokens AS block_tokens, sum(p.tokens) OVER (PARTITION BY p.source, p.block
  ORDER BY md5('mix-1' || '|doc|' || p.passes || '|' || coalesce(p.doc_id::VARCHAR, '') || '|' || tie), p.doc_id, tie) AS upto
  FROM placed p JOIN ordered o ON p.source IS NOT DISTINCT FROM o.source AND p.block = o.block),
copies AS (SELECT *, passes + CASE WHEN before + block_tokens <= rest OR (before < rest AND before + upto <= rest) THEN 1 ELSE 0 END AS copies FROM docs)
SELECT doc_id, source, tokens AS n_tokens, block, unnest(range(0, copies))::INTEGER AS pass FROM copies WHERE copies > 0"""


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint") + 1


def _digest(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _sums(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent: sum of powers, sum of powers times log share, largest power / share."""
    power = [F.exp(F.lit(a) * F.col("lp")) for a in exponents]
    row = shares.agg(*[f for p in power for f in (F.sum(p), F.sum(p * F.col("lp")), F.max(p * F.col("t") / F.col("tokens")))]).first()
    return [tuple(row[3 * i:3 * i + 3]) for i in range(len(exponents))]


def exponent(shares: DataFrame, count: int, target: float, most_repeats: float, budget_share: float = 1.0) -> tuple[float, float]:
    """The exponent and the sum of powers under it; two passes over the source table for each limit."""
    def search(low: int, high: int, holds) -> int:
        """Largest grid point from low to high where `holds`, which is true up to some point; else low."""
        while high - low > 0:
            step = max(1, -(-(high - low) // SECTION))
            points = sorted({*range(low + step, high, step), high})
            good = [p for p, s in zip(points, _sums(shares, [p / GRID for p in points])) if holds(p / GRID, *s)]
            low = max(good, default=low)
            high = min(high, low + step - 1)
        return low

    grid = search(0, GRID, lambda a, z, zl, top: math.log(z) - a * zl / z >= target * math.log(count))
    if not _within(*_sums(shares, [grid / GRID])[0], budget_share, most_repeats):
        # repeats fall as the exponent rises to 1
        over = search(grid, GRID, lambda a, z, zl, top: not _within(z, zl, top, budget_share, most_repeats))
        grid = min(GRID, over + 1)
    return grid / GRID, _sums(shares, [grid / GRID])[0][0]


def _within(z: float, zl: float, top: float, budget_share: float, most: float) -> bool:
    return budget_share * top / z <= most


def temperature_mix(docs: DataFrame, target: float = TARGET, most_repeats: float = MOST_REPEATS, budget: int | None = None,
                    seed: str = SEED, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """doc_id, source, tie (digest of the text), n_tokens, block and copies of each unit that is taken."""
    text = F.col(text_column).cast("string")
    units = kept(docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), F.md5(F.coalesce(text, F.lit(""))).alias("tie"),
                             tokens_of(text).alias("tokens")).groupBy("doc_id", "source", "tie").agg(F.sum("tokens").alias("tokens")), "units")
    sources = kept(units.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "sources")
    total, count = sources.agg(F.sum("tokens"), F.count("*")).first()
    if not count:
        return units.select("doc_id", "source", "tie", F.col("tokens").alias("n_tokens"), F.lit(0).cast("bigint").alias("block"), F.lit(0).alias("copies"))
    wanted = min(budget if budget is not None else total, int(most_repeats * total))
    shares = sources.withColumn("t", F.lit(total).cast("bigint")).withColumn("lp", F.log(F.col("tokens").cast("double") / F.lit(float(total))))
    a, z = exponent(shares, count, target, most_repeats, wanted / total)
    quotas = shares.select(
        "source", F.floor(F.lit(wanted) * F.exp(F.lit(a) * F.col("lp")) / F.lit(z) + F.lit(SLACK)).cast("bigint").alias("quota"), F.col("tokens").alias("of"),
        F.ceil(F.col("n") / BLOCK_ROWS).cast("bigint").alias("blocks")).select(
        "source", "blocks", F.expr("quota div of").alias("passes"), (F.col("quota") % F.col("of")).alias("rest"))
    number = F.conv(F.substring(_digest(seed, _text("doc_id"), F.col("tie")), 1, 15), 16, 10).cast("bigint")
    placed = units.alias("u").join(quotas.alias("q"), F.col("u.source").eqNullSafe(F.col("q.source"))).select(
        "u.*", "passes", "rest", F.pmod(number, "blocks").alias("block"))
    placed = kept(placed, "placed")
    blocks = placed.groupBy("source", "block", "passes", "rest").agg(F.sum("tokens").alias("block_tokens")).withColumn(
        "h", _digest(seed, "block", _text("source"), F.col("passes").cast("string"), F.col("block").cast("string")))
    # running sums over a source's blocks in digest order: inside leading digits, then over those
    inside = Window.partitionBy("source", "lead").orderBy("h", "block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("source").orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("lead", F.substring("h", 1, 3))
    leads = blocks.groupBy("source", "lead").agg(F.sum("block_tokens").alias("s")).select(
        F.col("source").alias("s_"), F.col("lead").alias("l_"), F.coalesce(F.sum("s").over(across), F.lit(0)).alias("earlier"))
    ranked = blocks.withColumn("inside", F.coalesce(F.sum("block_tokens").over(inside), F.lit(0))).join(
        leads, F.col("source").eqNullSafe(F.col("s_")) & (F.col("lead") == F.col("l_"))).select(
        F.col("source").alias("s_"), F.col("block").alias("b_"), "block_tokens", (F.col("inside") + F.col("earlier")).alias("before"))
    order = Window.partitionBy("source", "block").orderBy(
        _digest(seed, "doc", F.col("passes").cast("string"), _text("doc_id"), F.col("tie")), "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumn("upto", F.sum("tokens").over(order)).join(
        ranked, F.col("source").eqNullSafe(F.col("s_")) & (F.col("block") == F.col("b_")))
    last = (F.col("before") + F.col("block_tokens") <= F.col("rest")) | ((F.col("before") < F.col("rest")) & (F.col("before") + F.col("upto") <= F.col("rest")))
    return rows.select("doc_id", "source", "tie", F.col("tokens").alias("n_tokens"), "block",
                       (F.col("passes") + F.when(last, 1).otherwise(0)).cast("int").alias("copies")).filter("copies > 0")


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    doc, text, source = (names[c] for c in (id_column, text_column, source_column))
    plan = temperature_mix(docs, id_column=id_column, text_column=text_column, source_column=source_column, **options)
    tie = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))
    both = rows.join(plan, F.col(doc).eqNullSafe(F.col("doc_id")) & F.col(source).eqNullSafe(F.col("source")) & (tie == F.col("tie")))
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(n).alias(c) for c, n in names.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = temperature_mix(documents(spark, sf_dir))
    return plan.select("doc_id", "source", "n_tokens", "block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("pass"))
