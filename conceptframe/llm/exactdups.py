"""Exact duplicates by two passes over a Bloom filter of text hashes.

Pass one counts, in the cells of a blocked Bloom filter, how often they are hit: none, once, more. A
hash that comes twice finds all its cells hit more than once, so every repeated text passes; a text
that comes once does so only by chance (about one in four hundred). Pass two tests every row: rows that
cannot be repeated go straight through, and only the others are shuffled to be grouped by the SHA-256
of their normalised text, which decides. The filter never changes a result.

The filter lies in segments of `SEGMENT` cells; a task sends each segment its hashes, packed and at
most twice each, and a segment's cells are counted where it is gathered. A filter of more than
`FILTER_BYTES` is never sent: the hashes are then dealt into ranges that take one pass each over their
own rows (a written table, sorted by hash in its parts, so that a pass reads its range).

Texts are equal when identical after deleting every space, tab, line feed, vertical tab, form feed and
carriage return. Of equal texts the row with the most code points in its original text stays, then the
one with the smallest id. Nulls: a null text counts as empty; a row without id stays only where no row
with an id and the same text length is in its group. Repeated rows: one of them stays. An empty table
gives no rows. Other columns are carried along or not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptframe.llm.buffers import mix
from conceptframe.llm.hotkeys import joined_to_groups
from conceptframe.llm.shared import documents, kept, spread

NAME = "op12_bloom_exact_dedup"
SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM g"""
SPACES = " \t\n\x0b\x0c\r"
SEGMENT = 1 << 20  # cells; one bit each when sent
CELLS_A_ROW, HASHES = 16, 4
FILTER_BYTES = 64 << 20
GATHER = 1 << 20  # hashes that a task holds before it sends them
U64 = np.uint64


def cells_of(hashes: np.ndarray) -> np.ndarray:
    """Cells of each hash inside its segment: hashes x `HASHES`."""
    steps = np.arange(1, HASHES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
    return (mix(hashes[:, None] + steps[None, :]) % U64(SEGMENT)).astype(np.int64)


def segments_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    return (mix(hashes) % U64(segments)).astype(np.int64)


def _packed(hashes: np.ndarray, segments: int) -> pa.RecordBatch:
    """Rows (segment, hashes); a hash goes along twice at most."""
    own, counts = np.unique(hashes, return_counts=True)
    own = np.concatenate([own, own[counts > 1]])
    where = segments_of(own, segments)
    order = np.argsort(where, kind="stable")
    own, where = own[order], where[order]
    heads = np.flatnonzero(np.diff(where, prepend=-1))
    parts = [x.tobytes() for x in np.split(own, heads[1:])] if len(own) else []
    return pa.RecordBatch.from_arrays([pa.array(where[heads], pa.int32()), pa.array(parts, pa.binary())], ["segment", "hashes"])


def repeated_cells(rows: DataFrame, column: str, segments: int) -> DataFrame:
    """(segment, bits): which cells are hit more than once by the hashes of a bigint column."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().astype(U64))
            size += batch.num_rows
            if size >= GATHER:
                yield _packed(np.concatenate(held), segments)
                held, size = [], 0
        if size:
            yield _packed(np.concatenate(held), segments)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cells = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(cells > 1).tobytes()], pa.binary())], ["segment", "bits"])
        for batch in batches:
            for segment, hashes in zip(batch.column(0).to_pylist(), batch.column(1)):
                if segment != now:
                    if now is not None:
                        yield done()
                    now, cells = segment, np.zeros(SEGMENT, np.uint8)
                hits = np.bincount(cells_of(np.frombuffer(hashes.as_buffer(), U64)).ravel(), minlength=SEGMENT)
                cells = np.minimum(cells + np.minimum(hits, 2), 2).astype(np.uint8)
        if now is not None:
            yield done()

    sent = rows.select(column).mapInArrow(send, "segment int, hashes binary")
    return sent.repartition(min(segments, spread(rows.sparkSession)), "segment").sortWithinPartitions("segment").mapInArrow(count, "segment int, bits binary")


def tested(rows: DataFrame, column: str, segments: int) -> DataFrame:
    """Rows with `_maybe`: whether the hash can come more than once."""
    bits = {r.segment: bytes(r.bits) for r in repeated_cells(rows, column, segments).toLocalIterator()}
    sent = rows.sparkSession.sparkContext.broadcast(bits)
    at = rows.columns.index(column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {s: np.frombuffer(b, np.uint8) for s, b in sent.value.items()}
        for batch in batches:
            hashes = batch.column(at).to_numpy().astype(U64)
            where, cells = segments_of(hashes, segments), cells_of(hashes)
            maybe = np.zeros(len(hashes), bool)
            for s in np.unique(where).tolist():
                own = np.flatnonzero(where == s)
                c = cells[own]
                maybe[own] = ((planes[s][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1).all(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], [*batch.schema.names, "_maybe"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(work, f"{types}, _maybe boolean")


def filtered(rows: DataFrame, column: str, most: int = FILTER_BYTES) -> DataFrame:
    """`tested` over a written table, in as many ranges of hashes as keep each filter below `most` bytes."""
    count = rows.count()
    passes = max(1, -(-count * CELLS_A_ROW // (8 * most)))
    segments = max(1, -(-count * CELLS_A_ROW // (passes * SEGMENT)))
    edges = [-(1 << 63) + (1 << 64) * i // passes for i in range(passes + 1)]
    out = None
    for low, high in zip(edges[:-1], edges[1:]):
        own = rows if passes == 1 else rows.filter((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high - 1)))
        part = kept(tested(own, column, segments), "bloom")
        out = part if out is None else out.unionByName(part)
    return out


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = (), most: int = FILTER_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row; `carry` takes columns along as carry_<name>."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.length(text).alias("_size"), F.sha2(F.translate(text, SPACES, ""), 256).alias("text_sha256"),
                       *[F.col(c).alias(f"carry_{c}") for c in carry])
    rows = rows.withColumns({"_hash": F.xxhash64("text_sha256"), "_row": F.monotonically_increasing_id()}).sortWithinPartitions("_hash")
    all_rows = filtered(kept(rows, "hashed"), "_hash", most)
    maybe = all_rows.filter("_maybe")
    order = F.struct(-F.col("_size"), F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    groups = kept(maybe.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(order).alias("_first")).select(
        "text_sha256", "group_size", F.col("_first.id").alias("keep_id"), F.col("_first.row").alias("_keep_row")), "groups")
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", *[f"carry_{c}" for c in carry]]
    shuffled = joined_to_groups(maybe, groups, "text_sha256", "group_size").withColumn("kept", F.col("_row") == F.col("_keep_row")).select(*out)
    through = all_rows.filter("not _maybe").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("bigint"), "kept": F.lit(True)}).select(*out)
    return through.unionByName(shuffled)


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    numbered = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    found = exact_groups(numbered, names[id_column], names[text_column], carry=tuple(names.values()))
    return found.filter("kept").select(*[F.col(f"carry_{n}").alias(c) for c, n in names.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))
