"""Shards by a Feistel permutation of global row numbers.

Rows are numbered in the order of doc_id (size and checksum decide between equal ids). A balanced
Feistel network permutes the numbers below the next power of four; a number that lands beyond the
last row walks its cycle until it is back inside, so the permutation is one of exactly the rows. The
permuted number p gives shard p mod n and slot p div n: both are computable from the row number
alone, shard sizes differ by one row at most, and a seed gives the same shuffle anywhere.

The law that holds is `rows`; grown_shard is null, since one more shard moves rows everywhere.

Only id, size, checksum and row number are shuffled. Nulls: a null text has size 1 and checksum 0;
null ids come first. Repeated rows get numbers of their own. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conceptframe.llm.shared import documents, kept, spread

NAME = "op1_feistel_shards"
SQL = None  # DuckDB has no crc32; tests recompute everything row by row
SHARDS, SEED, ROUNDS = 8, 20_24, 6
U64 = np.uint64


def _round(half: np.ndarray, key: int, bits: int) -> np.ndarray:
    x = (half + U64(key)) * U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return (x ^ (x >> U64(29))) & U64((1 << bits) - 1)


def half_bits(total: int) -> int:
    return max(1, -(-max(total - 1, 1).bit_length() // 2))


def permuted(numbers: np.ndarray, total: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """Image (or original) of row numbers under the permutation of 0 .. total - 1."""
    bits = half_bits(total)
    keys = [((seed + 1) * 0x2545F4914F6CDD1D + r * 0x9E3779B97F4A7C15) % (1 << 64) for r in range(ROUNDS)]
    mask = U64((1 << bits) - 1)
    out = numbers.astype(U64)
    walk = np.arange(len(out))
    while len(walk):
        x = out[walk]
        left, right = x >> U64(bits), x & mask
        for key in (reversed(keys) if inverse else keys):
            if inverse:
                left, right = right ^ _round(left, key, bits), left
            else:
                left, right = right, left ^ _round(right, key, bits)
        out[walk] = (left << U64(bits)) | right
        walk = walk[out[walk] >= total]
    return out.astype(np.int64)


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Rows with their global position in `order`, without a window over the whole table.

    Range partitions are sorted and written once; their sizes, one row for each partition, give the
    offsets.
    """
    place = F.monotonically_increasing_id()
    salted = rows.withColumn("_salt", place)  # equal keys may be split between partitions
    parts = salted.repartitionByRange(spread(rows.sparkSession), *order, "_salt").sortWithinPartitions(*order, "_salt")
    held = kept(parts.drop("_salt").withColumn("_place", place), "numbered")
    held = held.withColumn("_part", F.shiftright("_place", 33)).withColumn("_place", F.col("_place").bitwiseAND((1 << 33) - 1))
    sizes = held.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return held.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def feistel_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and row_number."""
    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
                       F.coalesce(F.crc32(text), F.lit(0)).cast("bigint").alias("text_crc32"))
    table = numbered(rows, ["doc_id", "size", "text_crc32"], "row_number")
    total = docs.count()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = permuted(batch.column("row_number").to_numpy(), total, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((place % shards).astype(np.int32)), pa.array(place // shards)],
                                             [*batch.schema.names, "shard", "slot"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    placed = table.select("doc_id", "size", "text_crc32", "row_number").mapInArrow(
        work, f"doc_id {kind}, size bigint, text_crc32 bigint, row_number bigint, shard int, slot bigint")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards(documents(spark, sf_dir))
