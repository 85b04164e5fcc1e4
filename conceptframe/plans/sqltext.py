"""SQL fragments shared by the independent forms of the queries."""

from __future__ import annotations

from conceptframe.sources.tables import ANCHORS, BRIDGES

SPACES = r"\p{Z}\t\n\x0B\f\r\x1c-\x1f\x{85}"
WS = r"[\p{Z}\t\n\x0B\f\r\x1c-\x1f\x{85}]+"
TOKEN = r"[^\p{L}\p{N}]+"


def text_literal(s: str) -> str:
    parts = [f"'{p.replace(chr(39), chr(39) * 2)}'" for p in s.split("\n")]
    return "(" + "||chr(10)||".join(parts) + ")"


def group_of(text: str) -> str:
    return f"sha256(trim(regexp_replace(lower({text}), '{WS}', ' ', 'g')))"


def fraction64(hexes: str) -> str:
    return f"(('0x'||substr({hexes},1,16))::UBIGINT)::DOUBLE/18446744073709551616.0::DOUBLE"


def fraction52(hexes: str) -> str:
    return f"(('0x'||substr({hexes},1,13))::BIGINT)::DOUBLE/4503599627370496.0::DOUBLE"


def digest(*parts: str) -> str:
    return "sha256(" + "||chr(0)||".join(f"({p})::VARCHAR" for p in parts) + ")"


def toks(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '{TOKEN}'), lambda x: x <> '')"


SAMPLES = f"""
docs AS (SELECT doc_id::VARCHAR AS sample_id, text, lang, source, {group_of('text')} AS group_id FROM documents),
samples AS (SELECT sample_id, text, lang, source, group_id,
  CASE WHEN f < 0.6::DOUBLE THEN 'train' WHEN f < 0.8::DOUBLE THEN 'dev' ELSE 'test' END AS split
  FROM (SELECT *, {fraction64(digest("'42'", "group_id"))} AS f FROM docs))"""

INSTRUMENT = f"""
anchors(anchor_id, anchor_surface, pos) AS (VALUES {', '.join(f"('{a.id}', '{a.surface}', {i})" for i, a in enumerate(ANCHORS))}),
bridges(bridge_id, bridge_prefix, relation) AS (VALUES {', '.join(f"('{b.id}', {text_literal(b.prefix)}, '{b.relation}')" for b in BRIDGES)}),
aterms AS (SELECT anchor_id, unnest({toks('anchor_surface')}) AS term FROM anchors),
bterms AS (SELECT bridge_id, term, count(*) AS n FROM (SELECT bridge_id, unnest({toks('bridge_prefix')}) AS term FROM bridges) GROUP BY ALL),
blen AS (SELECT bridge_id, len({toks('bridge_prefix')}) AS n FROM bridges)"""

BACKGROUND = f"""
tokd AS (SELECT sample_id, split, lang, source, group_id, {toks('text')} AS toks FROM samples),
tterms AS (SELECT term, count(*) AS n FROM (SELECT unnest(toks) AS term FROM tokd WHERE split = 'train') GROUP BY term),
bg AS (SELECT sum(n)::DOUBLE AS total, count(*)::DOUBLE AS distinct_terms FROM tterms),
terms AS (SELECT DISTINCT term FROM aterms),
pbg AS (SELECT t.term, (coalesce(x.n, 0) + 1)::DOUBLE / (total + distinct_terms) AS p FROM terms t LEFT JOIN tterms x USING (term), bg)"""

# scores: sample_id, split, lang, source, group_id, anchor_id, bridge_id, raw_logp, token_count
SCORES = SAMPLES + "," + INSTRUMENT + "," + BACKGROUND + """,
dtf AS (SELECT sample_id, term, count(*) AS n FROM (SELECT sample_id, unnest(toks) AS term FROM tokd) JOIN terms USING (term) GROUP BY ALL),
scores AS (SELECT d.sample_id, d.split, d.lang, d.source, d.group_id, a.anchor_id, b.bridge_id,
  sum(ln((coalesce(dtf.n, 0) + coalesce(bt.n, 0) + 2000.0::DOUBLE * p.p) / (len(d.toks) + b.n + 2000.0::DOUBLE))) AS raw_logp,
  count(*) AS token_count
  FROM tokd d CROSS JOIN blen b CROSS JOIN aterms a JOIN pbg p ON p.term = a.term
  LEFT JOIN dtf ON dtf.sample_id = d.sample_id AND dtf.term = a.term
  LEFT JOIN bterms bt ON bt.bridge_id = b.bridge_id AND bt.term = a.term
  GROUP BY ALL)"""

REFERENCE = """
ref AS (SELECT anchor_id, bridge_id, count(*) AS reference_n, pk + ln(avg(exp(raw_logp - pk))) AS log_mean_probability,
  avg(raw_logp) AS mean_logp, stddev_samp(raw_logp) AS std_logp
  FROM (SELECT *, max(raw_logp) OVER (PARTITION BY anchor_id, bridge_id) AS pk FROM scores WHERE split = 'train')
  GROUP BY anchor_id, bridge_id, pk),
calibrated AS (SELECT s.*, raw_logp - log_mean_probability AS reference_log_ratio, (raw_logp - mean_logp) / std_logp AS reference_z
  FROM scores s JOIN ref USING (anchor_id, bridge_id))"""

RAW_MATRIX = """
matrix AS (SELECT sample_id, split, lang, source, group_id, anchor_id, avg(raw_logp) AS value FROM scores GROUP BY ALL)"""

Z_MATRIX = """
matrix AS (SELECT sample_id, split, lang, source, group_id, anchor_id, avg(reference_z) AS value FROM calibrated GROUP BY ALL)"""


def with_scores(body: str, *extra: str) -> str:
    return "WITH " + ",".join([SCORES, *extra]) + "\n" + body


def with_samples(body: str, *extra: str) -> str:
    """Body over the samples; a body that starts with a comma brings further CTEs of its own."""
    return "WITH " + ",".join([SAMPLES, *extra]) + "\n" + body.lstrip()


def r9(expr: str, name: str) -> str:
    return f"round({expr}, 9) AS {name}"
