"""The given tables in the shapes of the data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptframe.functions.text import normalized_group
from conceptframe.operators.grid import Anchor, Bridge, Instrument
from conceptframe.operators.prepare import grouped_hash_split
from conceptframe.schema import Refused
from conceptframe.operators.scorers import LanguageModel, fit_language_model, query_likelihood

# Fixed study: concepts and wordings named by the researcher.
ANCHORS = (
    Anchor("a_that", "that"), Anchor("a_with", "with"), Anchor("a_this", "this"), Anchor("a_from", "from"),
    Anchor("a_tion", "tion"), Anchor("a_then", "then"), Anchor("a_anea", "anea"), Anchor("a_pair", "with this"),
)
BRIDGES = (
    Bridge("b_about", "This text is about:\n"),
    Bridge("b_mention", "The passage mentions:\n"),
    Bridge("b_from", "Words taken from this passage:\n"),
)
STUDY = Instrument(ANCHORS, BRIDGES)


# Column types of the given tables.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    wanted = {f.strip().split(" ")[0] for f in SCHEMAS[name].split(", ")}
    if lacking := sorted(wanted - set(spark.read.parquet(path).columns)):
        raise Refused(f"{name} lacks columns {lacking}")
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as materials, with the group of near-trivial copies and the hash split."""
    docs = load(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("sample_id"), "text", "lang", "source",
        normalized_group(F.col("text")).alias("group_id"), F.sha2("text", 256).alias("content"))
    return grouped_hash_split(docs, "sample_id", "group_id")


def language_model(spark: SparkSession, sf_dir: str) -> LanguageModel:
    """Background model of the study, fitted on the training split; a job fits it once and hands it on."""
    return fit_language_model(samples(spark, sf_dir).filter("split = 'train'"), STUDY)


KEEP = ("split", "lang", "source", "group_id")


def scores(spark: SparkSession, sf_dir: str, keep=KEEP, where: Column | str | None = None,
           model: LanguageModel | None = None) -> DataFrame:
    """The study's score table over all documents, carrying the columns an analysis needs."""
    base = samples(spark, sf_dir)
    if where is not None:
        base = base.filter(where)
    return query_likelihood(base, STUDY, model or language_model(spark, sf_dir), keep=keep)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as double vectors keyed by a string id."""
    return load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("sample_id"), F.col("label").cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"))


def vector_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a long matrix: dimension = coordinate."""
    return vectors(spark, sf_dir).select("sample_id", "label", F.posexplode("vector").alias("anchor_id", "value"))
