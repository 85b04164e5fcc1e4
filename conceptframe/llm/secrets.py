"""Secret scan: candidate strings by pattern, false positives removed by a random forest.

All of it is DataFrame functions and the DataFrame-based forest of Spark ML: nothing leaves the JVM.

A candidate is a run of at least `LEAST` characters of `[A-Za-z0-9+/_=-]` with a digit in it, inside a
word (white space apart), and, whatever its length and characters, what is assigned inside a word (after
`=` or `:`, up to a quote or the next name) and a word after an assignment or up to two words after a
keyword; quotes around and stops behind are left off. What stands before the candidate in its word is the
path, the words around are the neighbours. Features of a candidate:
  length; transitions between small letters, capitals, digits and marks, for each length; shares of
  digits and capitals; different characters for each length; dictionary coverage: the share of
  characters in common words of the corpus (those of 4 letters and more that occur most often, counted
  over all documents); path: an assignment, a slash, an at sign, a dot, a keyword in it; neighbours: a
  keyword before, an assignment before, a quote, whether the words on both sides are plain ones.

Findings are labelled by a table (doc_id, value, label) where there is one. Without one, the surest
are labelled by form alone: keys of a fixed format and long hexadecimal values are secrets; values of
digits only, or such that common words cover half of, or parts of an address, are not, unless a keyword
assigns them. What defines these labels (`FORM`) is then no feature. The forest learns from at most
`TRAIN` labelled findings, for each label those with the smallest digests, up to half, and judges all.

Nulls: a null or empty text has no candidates; null ids keep their findings; repeated rows have
theirs each. An empty table, or one without candidates, gives no rows; labels of one kind only give
that label's probability to all. Other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptframe.llm.shared import documents, kept

NAME = "op5_secret_scan"
SQL = None  # a forest is no SQL; tests hold candidates and features against Python, and accuracy on held-out findings
LEAST, DICTIONARY, TRAIN = 14, 400, 20_000
TREES, DEPTH, SEED = 40, 8, 7
SPACE = r"[\x20\x09-\x0D]+"
RUN = r"[A-Za-z0-9+/_=-]{%d,}" % LEAST
#: What is assigned in a word: mark, opening quotes, value; `://` assigns nothing.
ASSIGNED = r"(?:=|:(?!//))[\"'`(\[{<]*([^\"'`(\[{<=:][^\"'`]*?)(?=[\"'`]|[?&,;][\w.-]{1,64}[=:]|$)"
OPENED, STOPS = r"^[\"'`(\[{<]+", r"(?<![\"'`)\]}>.,;:])[\"'`)\]}>.,;:]+$"
KEYWORDS = "(?i)(pass(word|wd)?|pwd|secret|token|api[_-]?key|key|auth|credential)"
NAMES = KEYWORDS + r"[\w-]*+\W*$"  # a keyword whose value is still to come
#: Fixed formats of access keys.
FORMATS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})$"
FEATURES = ["length", "transitions", "digits", "capitals", "different", "covered", "assigned", "slashed", "addressed", "dotted",
            "keyword_path", "keyword_before", "assigned_before", "quoted", "plain_before", "plain_after", "hexadecimal"]
FORM = {"length", "digits", "covered", "addressed", "hexadecimal"}


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, word (its number), path, value and both neighbours of every candidate."""
    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("text")).filter(
        F.col("text").rlike(RUN) | F.col("text").rlike("[=:]") | F.col("text").rlike(KEYWORDS))
    # each word beside its neighbours: shifted arrays, as a look into the array for each word would be
    # evaluated on the whole text again wherever the optimizer pushes it down
    words, empty = F.split("text", SPACE), F.array(F.lit(""))
    zipped = F.arrays_zip(F.concat(words, empty, empty), F.concat(empty, words, empty), F.concat(empty, empty, words), F.concat(F.slice(words, F.lit(2), F.size(words)), empty, empty, empty))
    at = F.transform(zipped, lambda x, i: F.struct(i.alias("word"), x["0"].alias("own"), x["1"].alias("before"), x["2"].alias("earlier"), x["3"].alias("after")))

    def near(x: Column) -> Column:
        return x["before"].rlike("[=:]$") | x["before"].rlike(NAMES) | x["earlier"].rlike(NAMES)

    def told(x: Column) -> Column:
        return x["own"].rlike(r"[\p{L}\p{N}]") & (x["own"].rlike(ASSIGNED) | near(x))

    few = F.filter(at, lambda x: ((F.length(x["own"]) >= LEAST) & x["own"].rlike(RUN) & x["own"].rlike("[0-9]")) | told(x))
    hits = rows.select("doc_id", few.alias("few"))
    # a word longer than the longest secret may hold many runs: each is a candidate
    one = hits.select("doc_id", F.explode("few").alias("x")).select("doc_id", "x.*", near(F.col("x")).alias("near"))
    own, none = F.col("own"), F.array().cast("array<string>")
    # an assignment inside the run belongs to the path
    name = r"^([A-Za-z_-]*=)"
    runs = F.transform(F.regexp_extract_all(own, F.lit(f"({RUN})"), F.lit(1)), lambda v: F.regexp_replace(v, name, ""))
    good = lambda v: (F.length(v) >= LEAST) & v.rlike("[0-9]")
    given = F.concat(F.regexp_extract_all(own, F.lit(ASSIGNED), F.lit(1)), F.when(F.col("near"), F.array(
        F.when(own.rlike(OPENED), F.regexp_extract(F.regexp_replace(own, OPENED, ""), "^[^\"'`]*", 0)).otherwise(own))).otherwise(none))
    given = F.filter(F.transform(given, lambda v: F.regexp_replace(v, STOPS, "")), lambda v: v.rlike(r"[\p{L}\p{N}]"))
    both = one.withColumn("runs", runs).withColumn("given", F.array_except(given, F.filter("runs", good)))
    split = both.select("doc_id", "word", "own", "before", "earlier", "after", F.size("runs").alias("n"), F.posexplode(F.concat("runs", "given")).alias("run", "value"))
    split = split.filter((F.col("run") >= F.col("n")) | good(F.col("value")))
    plain = F.expr("substring(own, 1, locate(value, own) - 1)")
    quoted = F.concat(F.lit(r"^(.*?(?:=|:(?!//))[\"'`(\[{<]*)\Q"), F.replace("value", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    lead = F.call_function("regexp_extract", F.col("own"), quoted, F.lit(1))
    return split.select("doc_id", "word", "run", F.when((F.col("run") >= F.col("n")) & (lead != ""), lead).otherwise(plain).alias("path"),
                        "value", "before", "earlier", "after")


def dictionary(docs: DataFrame, text_column: str = "text", most: int = DICTIONARY) -> list[str]:
    """The most frequent words of 4 letters and more, counted over all documents."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_column).cast("string")), F.lit(r"(?<![a-z])([a-z]{4,12})(?![a-z])"), F.lit(1))).alias("w"))
    return [r.w for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(most).collect()]


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def described(found: DataFrame, words: list[str]) -> DataFrame:
    """Candidates with their features."""
    v, n = F.col("value"), F.length("value").cast("double")
    kinds = ("[a-z]", "[A-Z]", "[0-9]", "[+/_=-]")
    change = "|".join(f"(?<={a})(?={b})" for a in kinds for b in kinds if a != b)
    covered = F.lit(0.0)
    if words:
        left = F.regexp_replace(F.lower(v), "(" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")", "")
        covered = 1 - F.length(left) / n
    plain = r"^[\"'(]?\p{L}+[.,;:!?\"')]*$"
    return found.select(
        "doc_id", "word", "run", "path", "value", n.alias("length"), (F.regexp_count(v, F.lit(change)) / n).alias("transitions"),
        (F.regexp_count(v, F.lit("[0-9]")) / n).alias("digits"), (F.regexp_count(v, F.lit("[A-Z]")) / n).alias("capitals"),
        (F.size(F.array_distinct(F.split(v, ""))) / n).alias("different"), covered.alias("covered"),
        _flag(F.col("path").rlike(r"[=:]\W*$")).alias("assigned"), _flag(F.col("path").contains("/")).alias("slashed"),
        _flag(F.col("path").contains("@")).alias("addressed"), _flag(F.col("path").rlike(r"\.\w+$|\w\.$")).alias("dotted"),
        _flag(F.col("path").rlike(KEYWORDS)).alias("keyword_path"),
        _flag(F.col("before").rlike(KEYWORDS) | F.col("earlier").rlike(KEYWORDS)).alias("keyword_before"),
        _flag(F.col("before").rlike("^[=:]+$") | F.col("before").rlike("[=:]$")).alias("assigned_before"),
        _flag(F.col("path").rlike("[\"'`]$")).alias("quoted"), _flag(F.col("before").rlike(plain)).alias("plain_before"),
        _flag(F.col("after").rlike(plain)).alias("plain_after"), _flag(v.rlike("^[0-9a-fA-F]+$") & v.rlike("[a-fA-F]")).alias("hexadecimal"))


def sure_labels(rows: DataFrame) -> DataFrame:
    """Label 1 or 0 for findings whose form alone decides, null for the others."""
    secret = F.col("value").rlike(FORMATS) | ((F.col("hexadecimal") == 1) & (F.col("length") >= 32))
    harmless = F.col("value").rlike("^[0-9_-]+$") | (F.col("covered") >= 0.5) | (F.col("addressed") == 1)
    named = ((F.col("keyword_path") == 1) & (F.col("assigned") == 1)) | ((F.col("keyword_before") == 1) & (F.col("assigned_before") == 1))
    return rows.withColumn("label", F.when(secret, 1.0).when(harmless & ~named, 0.0))


def secret_scan(docs: DataFrame, labelled: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text",
                train: int = TRAIN, threshold: float = 0.5) -> DataFrame:
    """doc_id, word, run, path, value, features, label (where known), probability and secret (0 or 1)."""
    rows = described(candidates(docs, id_column, text_column), dictionary(docs, text_column))
    if labelled is None:
        rows = sure_labels(rows)
    else:
        known = labelled.filter("label is not null").groupBy(F.col("doc_id").alias("_id"), F.col("value").alias("_value")).agg(F.max("label").cast("double").alias("label"))
        rows = rows.join(known, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("value") == F.col("_value")), "left").drop("_id", "_value")
    learned = [f for f in FEATURES if labelled is not None or f not in FORM]
    vectors = VectorAssembler(inputCols=learned, outputCol="features").transform(kept(rows, "findings"))
    digest = F.sha2(F.concat_ws("|", "value", "doc_id", "word", "run"), 256)
    known = vectors.filter("label is not null").select("label", "features", digest.alias("h"))
    # each label has its own share: the rarer one is never crowded out
    sample = kept(known.filter("label > 0").orderBy("h").limit(train // 2).unionByName(
        known.filter("label <= 0").orderBy("h").limit(train - train // 2)).drop("h"), "labelled")
    kinds = [r.label for r in sample.select("label").distinct().collect()]
    if len(kinds) < 2:
        judged = vectors.withColumn("probability", F.lit(float(kinds[0]) if kinds else 0.0))
    else:
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features")
        judged = forest.fit(sample).transform(vectors).withColumn("probability", vector_to_array("probability")[1])
    return judged.select("doc_id", "word", "run", "path", "value", *FEATURES, "label", "probability", (F.col("probability") >= threshold).cast("int").alias("secret"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(documents(spark, sf_dir))
    return found.select("doc_id", "word", "run", "path", "value", "length", "covered", "probability", "secret")
