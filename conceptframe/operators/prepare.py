"""Preparation of materials: splits, samples by digest, roles, spans, eligibility, variants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptframe.functions.hashing import digest, fraction64
from conceptframe.functions.text import normalized_group
from conceptframe.operators.checks import at_least, refused_if
from conceptframe.operators.grid import Anchor, Bridge
from conceptframe.operators.ordering import hash_positions, running_sums, value_bucket
from conceptframe.schema import SPLIT_ALIASES

TARGET_OPEN, TARGET_CLOSE = "<target>", "</target>"


# --- text and identity -------------------------------------------------------------------------

def compose_text(fields: Mapping[str, Column]) -> Column:
    """Labelled lines: "Label: value", one per field, NULL fields left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{label}: "), v.cast("string"))) for label, v in fields.items()]
    return F.concat_ws("\n", *lines)


def document_group(identifier: Column, text: Column) -> Column:
    """Id prefix when the last two underscore fields are digits, else the normalized text."""
    prefix = F.regexp_extract(identifier, r"^(.*)_[0-9]+_[0-9]+$", 1)
    return F.when(prefix != "", prefix).otherwise(normalized_group(text))


def sampling_unit(identifier: Column) -> Column:
    """Document part of "name.txt-position-token"; NULL where the id has no such form."""
    return F.nullif(F.regexp_extract(identifier, r"^(.+\.txt)-[0-9]+-[0-9]+$", 1), F.lit(""))


def is_safe_relative_path(path: Column) -> Column:
    """Inside the root after every "." and ".." is followed; a path may go down and up again."""
    step = F.aggregate(F.split(path, "/"), F.struct(F.lit(0).alias("depth"), F.lit(True).alias("inside")), lambda s, p: F.struct(
        (s["depth"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("depth"),
        (s["inside"] & ((p != "..") | (s["depth"] > 0))).alias("inside")))
    return (~path.startswith("/")) & (path != "") & step["inside"]


def unit_key(group_id: Column, sample_id: Column) -> Column:
    """Sampling unit in separate namespaces, so a fallback id cannot collide with a group id."""
    return F.coalesce(F.concat(F.lit("g:"), group_id), F.concat(F.lit("s:"), sample_id))


# --- splits ------------------------------------------------------------------------------------

def hash_role(key: Column, shares: Mapping[str, float], seed: int = 42) -> Column:
    """Role by cumulative share of the digest fraction; the last role takes the rest."""
    f, edge, out = fraction64(digest(seed, key)), 0.0, None
    names = list(shares)
    for name in names[:-1]:
        edge += shares[name]
        out = F.when(f < edge, name) if out is None else out.when(f < edge, name)
    return out.otherwise(names[-1]) if out is not None else F.lit(names[-1])


def grouped_hash_split(df: DataFrame, id_col: str, group_col: str, seed: int = 42,
                       shares: Mapping[str, float] | None = None) -> DataFrame:
    """Order-free split; all rows of a group land together. Narrow: no shuffle."""
    return df.withColumn("split", hash_role(F.coalesce(F.col(group_col), F.col(id_col)),
                                            shares or {"train": 0.6, "dev": 0.2, "test": 0.2}, seed))


def map_official_splits(df: DataFrame, official: DataFrame, key: str, split: str = "official_split") -> DataFrame:
    """Alias-mapped splits that cover every id exactly; anything else stops the job."""
    aliases = F.create_map(*[F.lit(x) for kv in SPLIT_ALIASES.items() for x in kv])
    named = official.select(key, F.try_element_at(aliases, F.lower(split)).alias("split"))
    named = named.filter(F.coalesce(F.col("split") != "external", F.lit(True))).groupBy(key).agg(
        F.count("*").alias("_named"), F.first("split").alias("split"))
    joined = df.withColumn("_here", F.lit(1)).join(named, key, "full_outer")
    bad = F.col("_here").isNull() | F.col("_named").isNull() | (F.col("_named") > 1) | F.col("split").isNull()
    return joined.select(*df.columns, refused_if(bad, "Splits do not cover the ids exactly", F.col("split")).alias("split"))


def groups_crossing_splits(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    # Count per (group, split) first: a hot group is combined map-side instead of shuffled row by row.
    per = df.groupBy(group, split).agg(F.count("*").alias("_n"))
    return (per.groupBy(group).agg(F.count("*").alias("n_splits"), F.sum("_n").alias("n_rows")).filter("n_splits > 1"))


def pairs_crossing_splits(pairs: DataFrame, samples: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    ids = samples.select("sample_id", "split")
    both = (pairs.join(ids.withColumnsRenamed({"sample_id": left, "split": "left_split"}), left, "left")
            .join(ids.withColumnsRenamed({"sample_id": right, "split": "right_split"}), right, "left"))
    unknown = F.col("left_split").isNull() | F.col("right_split").isNull()
    return both.filter(unknown | (F.col("left_split") != F.col("right_split"))).withColumn(
        "left_split", refused_if(unknown, "A pair names an unknown sample", F.col("left_split")))


def subset_by_ids(df: DataFrame, ids: DataFrame, key: str = "sample_id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


# --- ratings and options -----------------------------------------------------------------------

def aggregate_ratings(ratings: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """All-one rows dropped, items with more than one rating kept, means to two digits (half to even)."""
    all_one = F.lit(True)
    for v in values:
        all_one = all_one & (F.col(v) == 1)
    agg = ratings.filter(~all_one).groupBy(key).agg(F.count("*").alias("n_ratings"), *[F.avg(v).alias(v) for v in values])
    return agg.filter("n_ratings > 1").select(key, "n_ratings", *[
        (F.rint(F.col(v) * 100) / F.lit(100.0)).alias(v) for v in values])


def explode_options(df: DataFrame, options: str, answer: str, keep: Sequence[str] = ("sample_id",)) -> DataFrame:
    """ "A. text" entries to (letter, surface, relevant); surfaces are cut at the first colon."""
    starts = F.exists(options, lambda o: F.startswith(o, F.concat(F.col(answer), F.lit(". "))))
    checked = refused_if(~F.coalesce(starts, F.lit(False)), "No option has the answer's letter", F.col(answer))
    rows = df.select(*keep, checked.alias(answer), F.posexplode(options).alias("position", "option"))
    letter = F.regexp_extract("option", r"^([A-Z]+)\. ", 1)
    surface = F.trim(F.split(F.regexp_replace("option", r"^[A-Z]+\. ", ""), ":", 2)[0])
    return rows.select(*keep, "position", letter.alias("letter"), surface.alias("surface"),
                       (letter == F.col(answer)).cast("int").alias("relevant"))


def duplicate_surfaces(candidates: DataFrame, key: str = "sample_id") -> DataFrame:
    """Case-insensitive duplicates inside one candidate list."""
    return (candidates.groupBy(key, F.lower("surface").alias("surface"))
            .agg(F.count("*").alias("n")).filter("n > 1"))


def blind_candidates(candidates: DataFrame, key: str = "sample_id") -> DataFrame:
    """Candidate id = first 16 hex of the surface digest; the id's order is the blind order.

    Lists are a sample's own candidates; a surface that a sample has twice is refused. The relevance stays.
    """
    one = candidates.groupBy(key, "surface").agg(F.count("*").alias("_n"), F.max("relevant").alias("relevant"))
    one = one.select(key, "surface", "relevant", refused_if(F.col("_n") > 1, "A sample has a candidate twice", F.sha2("surface", 256)).alias("_h"))
    ranked = hash_positions(one, "_h", "blind_position", [key], digits=1)
    return ranked.select(key, "surface", F.substring("_h", 1, 16).alias("anchor_id"), "blind_position", "relevant")


def explode_captions(df: DataFrame, clip: str, captions: str) -> DataFrame:
    """Clip id parsed from the right into (source, start, end); each caption becomes a sample of its clip."""
    form = r"^(.*)_([0-9.]+)_([0-9.]+)$"
    return (df.select(F.col(clip).alias("pair_id"), F.regexp_extract(clip, form, 1).alias("source"),
                      F.regexp_extract(clip, form, 2).cast("double").alias("clip_start"),
                      F.regexp_extract(clip, form, 3).cast("double").alias("clip_end"),
                      F.posexplode(captions).alias("position", "caption"))
            .withColumn("sample_id", F.concat_ws(":", "pair_id", F.col("position").cast("string"))))


# --- spans -------------------------------------------------------------------------------------

# Unicode white space, as Java and RE2 both read it inside a class.
SPACE = r"\p{Z}\t\n\x0B\f\r\x1c-\x1f\x{85}"


def token_span(text: Column, index: Column) -> Column:
    """[start, end) of a whitespace-separated token (index from 0); NULL beyond the last token."""
    chunks = F.regexp_extract_all(text, F.lit(rf"([{SPACE}]*[^{SPACE}]+)"), 1)
    chunk = F.get(chunks, index)
    size = F.length(F.regexp_replace(chunk, rf"^[{SPACE}]+", ""))
    end = F.aggregate(F.slice(chunks, F.lit(1), index + 1), F.lit(0), lambda s, c: s + F.length(c))
    return F.when(chunk.isNotNull(), F.struct((end - size).alias("start"), end.alias("end")))


def char_span(span: Column) -> Column:
    """ "start:end" with one contiguous, non-empty range; NULL otherwise."""
    ok = span.rlike(r"^[0-9]+:[0-9]+$")
    start, end = F.split(span, ":")[0].try_cast("int"), F.split(span, ":")[1].try_cast("int")
    return F.when(ok & (start < end), F.struct(start.alias("start"), end.alias("end")))


def mark_target(df: DataFrame, text: str, start: str, end: str) -> DataFrame:
    """Literal markers around the occurrence; the raw text is kept and the span moves by the opening marker.

    Texts that already hold a marker cannot be marked without ambiguity: `collision` is true.
    """
    t, s, e = F.col(text), F.col(start), F.col(end)
    marked = F.concat(F.substring(t, F.lit(1), s), F.lit(TARGET_OPEN), F.substring(t, s + 1, e - s),
                      F.lit(TARGET_CLOSE), F.substring(t, e + 1, F.length(t)))
    collision = t.contains(TARGET_OPEN) | t.contains(TARGET_CLOSE)
    return (df.withColumn("collision", collision)
            .withColumn("marked_text", F.when(~collision, marked))
            .withColumn("marked_start", F.when(~collision, s + len(TARGET_OPEN)))
            .withColumn("marked_end", F.when(~collision, e + len(TARGET_OPEN))))


def unmark_target(marked: Column) -> Column:
    return F.replace(F.replace(marked, F.lit(TARGET_OPEN), F.lit("")), F.lit(TARGET_CLOSE), F.lit(""))


# --- selection by digest -----------------------------------------------------------------------

def rank_terms(terms: DataFrame, pair: str, term: str, n: int = 128, different: bool = False) -> DataFrame:
    """Concept bank: one vote per pair, ordered by votes then term.

    Where the rows are `different` already, votes are counted map-side and only terms travel.
    """
    rows = terms.select(pair, term)
    votes = (rows if different else rows.distinct()).groupBy(term).agg(F.count("*").alias("votes"))
    return at_least(votes.orderBy(F.desc("votes"), term).limit(n), n, "The bank has too few terms")


def quota_sample(df: DataFrame, n: int, splits: Sequence[str] = ("train", "dev"), *, id_col: str = "sample_id",
                 group: str = "group_id", split: str = "split", seed: int = 42) -> DataFrame:
    """Per split the first `n` groups in digest order, one row each; later splits skip groups already used.

    The first row of a group is a map-side minimum, so a group of any size costs one row in the shuffle.
    """
    hashed = df.select(id_col, F.coalesce(group, id_col).alias(group), split).withColumn("_h", digest(seed, F.col(id_col)))
    heads = (hashed.filter(F.col(split).isin(*splits)).groupBy(split, group)
             .agg(F.min(F.struct("_h", id_col)).alias("_m")).select(split, group, "_m._h", f"_m.{id_col}"))
    picked = None
    for name in splits:
        pool = heads.filter(F.col(split) == name)
        if picked is not None:
            pool = pool.join(picked.select(group), group, "left_anti")
        part = at_least(pool.orderBy("_h").limit(n).select(id_col, group, split), n, f"Too few groups in split {name}")
        picked = part if picked is None else picked.unionByName(part)
    return picked


def fill_roles(df: DataFrame, quotas: Sequence[tuple[str, int]], rest: str, *, group: str = "group_id",
               protected: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Whole groups in digest order fill one role after the other until it holds at least its quota.

    Works on one row per group; the running totals are bucketed by digest prefix. The end of a role is a
    scalar (an aggregate over the group sizes), the next role counts from there.
    """
    if protected is not None:
        df = df.join(protected.select(group).distinct(), group, "left_anti")
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).withColumn("_h", digest(seed, F.col(group)))
    run = running_sums(sizes, [], F.substring("_h", 1, 2), [F.col("_h")], {"_cum": F.col("n")})
    role, start, ends = None, F.lit(0), run
    for name, quota in quotas:
        inside = (F.col("_cum") - F.col("n") - start) < quota
        role = F.when(inside, name) if role is None else role.when(inside, name)
        start = ends.filter(inside).agg(F.coalesce(F.max("_cum"), F.lit(0))).scalar()
    return run.select(group, "n", role.otherwise(rest).alias("role"))


def round_robin(df: DataFrame, cells: Sequence[str], n: int, *, id_col: str = "sample_id", seed: int = 42) -> DataFrame:
    """Cells in turn give their next row in digest order until `n` rows are taken."""
    hashed = df.select(id_col, *cells).withColumn("_h", digest(seed, F.col(id_col)))
    ranked = hash_positions(hashed, "_h", "round", cells).filter(F.col("round") <= n)
    taken = ranked.orderBy("round", *cells).limit(n).select(id_col, *cells, F.col("round").cast("bigint").alias("round"))
    return at_least(taken, n, "Too few rows for the sample")


def first_by_hash(df: DataFrame, n: int, *, id_col: str = "sample_id", seed: int = 42) -> DataFrame:
    return df.withColumn("_h", digest(seed, F.col(id_col))).orderBy("_h").limit(n).drop("_h")


def first_per_parent(df: DataFrame, parent: str, *, id_col: str = "sample_id", seed: int = 42) -> DataFrame:
    return df.groupBy(parent).agg(F.min_by(id_col, digest(seed, F.col(id_col))).alias(id_col))


def first_available(df: DataFrame, n: int, available: Column, id_col: str) -> DataFrame:
    return df.filter(available).orderBy(id_col).limit(n)


def fixed_shards(df: DataFrame, order: str, size: int) -> DataFrame:
    """Order-preserving shards of `size` rows; `order` is a unique number."""
    keyed = df.withColumn("_o", F.col(order))
    run = running_sums(keyed, [], value_bucket(keyed, "_o"), [F.col("_o")], {"_pos": F.lit(1).cast("bigint")})
    return run.withColumn("shard", F.floor((F.col("_pos") - 1) / size)).drop("_o", "_pos")


def shard_manifest(shards: DataFrame, order: str) -> DataFrame:
    return shards.groupBy("shard").agg(F.count("*").alias("n"), F.min(order).alias("first_id"), F.max(order).alias("last_id"))


# --- duplicates and donors ---------------------------------------------------------------------

def canonical_duplicates(df: DataFrame, name: str, content: str, split: str = "split", seed: int = 42) -> DataFrame:
    """Equal content takes the smallest name as its group; split recomputed; `changed` marks moved rows."""
    hashed = df.withColumn("_d", F.sha2(F.col(content), 256))
    heads = hashed.groupBy("_d").agg(F.min(name).alias("canonical"))
    out = hashed.join(heads, "_d").drop("_d").withColumnRenamed(split, "old_split")
    out = grouped_hash_split(out, name, "canonical", seed)
    return out.withColumn("changed", F.col("old_split") != F.col("split"))


def repeated_texts(df: DataFrame, text: str) -> DataFrame:
    """Number of values that occur more than once, and the rows they cover."""
    counts = df.groupBy(F.sha2(text, 256).alias("_d")).agg(F.count("*").alias("n")).filter("n > 1")
    return counts.agg(F.count("*").alias("repeated_values"), F.coalesce(F.sum("n"), F.lit(0)).alias("covered_rows"))


def donor_swap(df: DataFrame, *, id_col: str = "sample_id", group: str = "group_id", split: str = "split",
               seed: int = 42) -> DataFrame:
    """On the digest-ordered ring of a split, the next row of another group becomes the donor.

    Rows get bucketed positions; runs of one group are numbered from their heads, and the donor is the
    head of the next run. Everything is an equi-join on (split, number): no ring passes through one task.
    """
    hashed = df.select(id_col, F.coalesce(group, id_col).alias(group), split).withColumn("_h", digest(seed, F.col(id_col)))
    pos = hash_positions(hashed, "_h", "_pos", [split])
    previous = pos.select(split, (F.col("_pos") + 1).alias("_pos"), F.col(group).alias("_before"))
    heads = (pos.join(previous, [split, "_pos"], "left")
             .withColumn("_head", F.when(F.col("_before").isNull() | (F.col("_before") != F.col(group)), 1).otherwise(0)))
    runs = running_sums(heads, [split], F.substring("_h", 1, 2), [F.col("_h")], {"_run": F.col("_head").cast("bigint")})
    first = runs.filter("_head = 1").select(split, "_run", F.col(id_col).alias("donor_id"), F.col(group).alias("_dgroup"))
    after = first.select(split, (F.col("_run") - 1).alias("_run"), F.col("donor_id").alias("_next"))
    start = first.filter("_run <= 2").groupBy(split).agg(
        F.max(F.when(F.col("_run") == 1, F.col("donor_id"))).alias("_d1"),
        F.max(F.when(F.col("_run") == 1, F.col("_dgroup"))).alias("_g1"),
        F.max(F.when(F.col("_run") == 2, F.col("donor_id"))).alias("_d2"))
    wrap = F.when(F.col("_g1") != F.col(group), F.col("_d1")).otherwise(F.col("_d2"))
    return (runs.join(after, [split, "_run"], "left").join(start, split, "left")
            .select(id_col, group, split, F.coalesce("_next", wrap).alias("donor_id")))


def ablate_parts(df: DataFrame, condition: str, donors: DataFrame | None = None, *, parts: str = "parts") -> DataFrame:
    """Input conditions: full, text, image, empty, or swapped (the donor's image with the own text)."""
    own_text = F.filter(parts, lambda p: p["type"] == "text")
    if condition == "full":
        return df
    if condition == "text":
        return df.withColumn(parts, own_text)
    if condition == "image":
        return df.withColumn(parts, F.filter(parts, lambda p: p["type"] != "text"))
    if condition == "empty":
        kind = df.schema[parts].dataType.elementType
        nothing = F.struct(*[(F.lit("text") if f.name == "type" else F.lit("") if f.name == "text" else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
        return df.withColumn(parts, F.array(nothing))
    if condition != "swapped" or donors is None:
        raise ValueError(f"Unknown condition {condition!r} or donors missing.")
    media = df.select(F.col("sample_id").alias("donor_id"), F.col("split").alias("_dsplit"), F.col("group_id").alias("_dgroup"),
                      F.filter(parts, lambda p: p["type"] != "text").alias("_dparts"))
    joined = df.join(donors.select("sample_id", "donor_id"), "sample_id", "left").join(media, "donor_id", "left")
    bad = F.col("_dsplit").isNull() | (F.col("_dsplit") != F.col("split")) | (F.col("_dgroup") == F.col("group_id"))
    joined = joined.withColumn("donor_id", refused_if(bad, "Donor must share the split and not the group", F.col("donor_id")))
    # media parts are replaced where they stand, the n-th by the donor's n-th
    before = F.transform(parts, lambda p, i: F.size(F.filter(F.slice(F.col(parts), F.lit(1), i), lambda q: q["type"] != "text")))
    lacks = F.size(F.filter(parts, lambda p: p["type"] != "text")) > F.size("_dparts")
    swapped = F.transform(F.arrays_zip(F.col(parts).alias("own"), before.alias("n")), lambda z: F.when(
        z["own"]["type"] == "text", z["own"]).otherwise(F.get(F.col("_dparts"), z["n"])))
    return joined.withColumn(parts, refused_if(lacks | (F.size(F.filter(parts, lambda p: p["type"] != "text")) == 0), "Sample or donor has no media to swap", swapped)).drop("_dsplit", "_dgroup", "_dparts")


# --- eligibility and validation ----------------------------------------------------------------

def with_reasons(df: DataFrame, reasons: Mapping[str, Column]) -> DataFrame:
    """Exclusion reasons as an array; an empty array means retained."""
    flags = F.array(*[F.when(bad, F.lit(name)) for name, bad in reasons.items()])
    return df.withColumn("reasons", F.array_compact(flags)).withColumn("retained", F.size("reasons") == 0)


def reason_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def sample_faults(parts: str = "parts", target: str = "target") -> dict[str, Column]:
    """Shape rules of a sample as reason columns."""
    def any_part(rule):
        return F.coalesce(F.exists(parts, lambda p: F.coalesce(rule(p), F.lit(True))), F.lit(False))

    t = F.col(target)
    inside = F.get(F.col(parts), t["part_index"])
    return {
        "no_parts": F.coalesce(F.size(parts) < 1, F.lit(True)),
        "text_part": any_part(lambda p: (p["type"] == "text") & (p["text"].isNull() | p["path"].isNotNull())),
        "media_part": any_part(lambda p: (p["type"] != "text") & (p["path"].isNull() | (p["path"] == "") | p["text"].isNotNull())),
        "clip_bounds": any_part(lambda p: (p["clip_start"].isNotNull() | p["clip_end"].isNotNull())
                                & ((p["type"] != "video") | F.coalesce(p["clip_start"] >= p["clip_end"], F.lit(False))
                                   | F.coalesce(p["clip_start"] < 0, F.lit(False)) | F.coalesce(p["clip_end"] <= 0, F.lit(False)))),
        "target_span": t.isNotNull() & F.coalesce(
            (inside["type"] != "text") | (t["start"] < 0) | (t["end"] <= t["start"]) | (t["end"] > F.length(inside["text"]))
            | (F.trim(t["lemma"]) == ""), F.lit(True)),
    }


def bundle_faults(samples: DataFrame, official: DataFrame, candidates: DataFrame) -> DataFrame:
    """(rule, violations): duplicate ids, contradicting splits, stray candidates, duplicate anchors per sample."""
    def count(df: DataFrame, rule: str) -> DataFrame:
        return df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")

    dup = samples.groupBy("sample_id").count().filter("count > 1")
    conflict = (samples.select("sample_id", "split").join(official.select("sample_id", F.col("split").alias("_o")), "sample_id")
                .filter("split <> _o"))
    stray = candidates.join(samples.select("sample_id").distinct(), "sample_id", "left_anti")
    twice = candidates.groupBy("sample_id", "anchor_id").count().filter("count > 1")
    return (count(dup, "duplicate_ids").unionByName(count(conflict, "split_conflict"))
            .unionByName(count(stray, "stray_candidates")).unionByName(count(twice, "duplicate_anchors")))


def merge_inventories(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Union in which the same id must carry the same row."""
    union = tables[0]
    for t in tables[1:]:
        union = union.unionByName(t)
    others = [c for c in union.columns if c != key]
    row = F.struct(*others)
    rows = union.groupBy(key).agg(F.min(row).alias("_a"), F.max(row).alias("_b"))
    return rows.select(key, refused_if(~F.col("_a").eqNullSafe(F.col("_b")), "One id with different rows", F.col("_a")).alias("_a")).select(key, *[F.col(f"_a.{c}") for c in others])


def wrong_child_counts(children: DataFrame, parent: str, k: int) -> DataFrame:
    return children.groupBy(parent).agg(F.count("*").alias("n")).filter(F.col("n") != k)


def repair_filenames(names: DataFrame, listing: DataFrame, name: str = "name", listed: str = "file") -> DataFrame:
    """The exact name first, the right-trimmed name, exactly as listed, second; anything else is refused."""
    files = listing.select(F.col(listed).alias("_f")).distinct()
    out = (names.join(files, F.col(name) == F.col("_f"), "left")
           .join(files.withColumnRenamed("_f", "_tf"), F.rtrim(F.col(name)) == F.col("_tf"), "left"))
    matched = F.coalesce("_f", "_tf")
    return out.select(*names.columns, refused_if(matched.isNull(), "No file for a name", matched).alias("matched"),
                      (F.col("_f").isNull() & F.col("_tf").isNotNull()).alias("corrected"))


# --- instrument variants -----------------------------------------------------------------------

def variant_surfaces(spark, anchors: Sequence[Anchor], bank: DataFrame | None = None, aliases: Mapping[str, str] | None = None,
                     phrase: str = "", nested: Sequence[int] = ()) -> DataFrame:
    """(variant, anchor_id, surface): base, aliases, phrase prefix, duplicates plus unrelated, nested prefixes of one bank.

    `bank` (term, votes) is already a limited list; it stays a table.
    """
    base = spark.createDataFrame([(a.id, a.surface) for a in anchors], "anchor_id string, surface string")
    out = base.select(F.lit("base").alias("variant"), "*")
    if aliases:
        table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        out = out.unionByName(base.select(F.lit("aliases").alias("variant"), "anchor_id", F.coalesce(F.try_element_at(table, F.col("anchor_id")), "surface").alias("surface")))
    if phrase:
        out = out.unionByName(base.select(F.lit("phrase").alias("variant"), "anchor_id", F.concat(F.lit(phrase), "surface").alias("surface")))
    if bank is not None:
        ranked = bank.withColumn("_r", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("votes"), "term")))
        named = ranked.select("_r", F.concat(F.lit("t_"), "term").alias("anchor_id"), F.col("term").alias("surface"))
        extended = base.unionByName(base.withColumn("anchor_id", F.concat(F.lit("dup_"), "anchor_id"))).unionByName(named.drop("_r"))
        out = out.unionByName(extended.select(F.lit("extended").alias("variant"), "*"))
        for n in nested:
            out = out.unionByName(named.filter(F.col("_r") <= n).select(F.lit(f"nested_{n}").alias("variant"), "anchor_id", "surface"))
    return out


def bridge_variants(bridges: Sequence[Bridge], prefix: str) -> tuple[Bridge, ...]:
    return tuple(Bridge(f"{b.id}_v", prefix + b.prefix, b.relation, b.language) for b in bridges)
