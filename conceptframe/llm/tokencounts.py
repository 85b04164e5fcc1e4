"""Token counts of whole texts without their ids.

Each text is cut into pieces that no pre-token crosses. A task gathers whole documents into groups and
keeps, for each document, which distinct pieces it has and how often. The distinct pieces of a group
travel to buckets of their hashes; there each distinct piece of the corpus is counted once by the
public tokenizer, and the counts travel back to the groups, where a document's count is the sum of
frequency times count. Pieces go sorted and compressed, frequencies as compressed bytes; a piece of
all documents travels once a group, and no list of ids is kept.

A bucket's table of counts is emptied at a fixed size (`Vocabulary`); what comes again after that is
counted again, so give more shuffle partitions rather than more memory. Documents with white space
beyond ASCII or a special string of the tokenizer, where the cut isn't safe, are counted whole in the
task that reads them. A group ends at `GROUP_BYTES` of text or `GROUP_PAIRS` frequencies; one document
that is longer is a group of its own.

Nulls: a null text counts as empty (0 bytes, 0 tokens). Null or repeated ids: one row out for each
row in. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptframe.llm.buffers import Vocabulary, blocks, range_hashes
from conceptframe.llm.shared import documents, kept, spread
from conceptframe.llm.tokenizing import counted, odd_rows, piece_starts

NAME = "op9_token_counts"
SQL = None  # a tokenizer is no SQL; tests hold it against the library itself
TOKENIZER, LIMIT = "byte_bpe_50k.json", 512
GROUP_BYTES, GROUP_PAIRS = 24 << 20, 3_000_000
#: Groups that one task joins to their counts.
GROUPS_A_TASK = 8
PACKED = ("sizes", "whole", "each", "places", "times")


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 to 2^32 - 1, lowest bytes first, compressed."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def restored(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class Group:
    """Documents of one group: how often each has which piece, and the distinct pieces."""

    def __init__(self, name: str, buckets: int):
        self.name, self.buckets = name, buckets
        self.clear()

    def clear(self) -> None:
        self.numbers = Vocabulary(self.note, most=1 << 62)  # the group's end bounds it
        self.pieces, self.fresh = [], []
        self.ids, self.sizes, self.whole, self.each, self.owned, self.times = [], [], [], [], [], []
        self.bytes, self.held = 0, 0

    def note(self, pieces: list[bytes]) -> np.ndarray:
        self.pieces += pieces
        return np.arange(len(self.pieces) - len(pieces), len(self.pieces))

    def add(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        rows = len(offsets) - 1
        whole = np.zeros(rows, np.int64)
        odd = odd_rows(self.name, data, offsets)
        if len(odd):
            raw = data.tobytes()
            whole[odd] = counted(self.name, [raw[offsets[r]:offsets[r + 1]].decode() for r in odd.tolist()])
        starts = piece_starts(data, offsets)
        starts = starts[starts < len(data)]
        ends = np.append(starts[1:], len(data))
        row = np.searchsorted(offsets, starts, "right") - 1
        safe = ~np.isin(row, odd)
        starts, ends, row = starts[safe], ends[safe], row[safe]
        keys, first, inverse = np.unique(range_hashes(data, starts, ends), return_index=True, return_inverse=True)
        before = len(self.pieces)
        numbers = self.numbers(data, starts[first], ends[first], keys)
        self.fresh.append(keys[numbers >= before])  # in the order of `note`
        width = max(len(keys), 1)
        pair, times = np.unique(row * width + inverse, return_counts=True)
        self.each.append(np.bincount(pair // width, minlength=rows))
        self.owned.append(numbers[pair % width].astype(np.uint32))
        self.times.append(times.astype(np.uint32))
        self.ids.append(ids)
        self.sizes.append(np.diff(offsets))
        self.whole.append(whole)
        self.bytes += len(data)
        self.held += len(pair)

    def rows(self) -> Iterator[dict[str, pa.Array]]:
        """The packed documents, and the pieces of each bucket in byte order."""
        pieces = self.pieces
        bucket = (np.concatenate(self.fresh) % np.uint64(self.buckets)).astype(np.int64)
        ends = np.cumsum(np.bincount(bucket, minlength=self.buckets))
        by_bucket = np.argsort(bucket, kind="stable").tolist()
        order, found, texts, lengths = [], [], [], []
        for b, (start, end) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist())):
            if end > start:
                own = sorted(by_bucket[start:end], key=pieces.__getitem__)
                order += own
                found.append(b)
                texts.append(zstandard.compress(b"".join(map(pieces.__getitem__, own)), 3))
                lengths.append(squeezed(np.fromiter((len(pieces[i]) for i in own), np.int64, len(own))))
        place = np.empty(len(pieces), np.int64)
        place[order] = np.arange(len(pieces))
        each = np.concatenate(self.each)
        at, times = place[np.concatenate(self.owned)], np.concatenate(self.times)
        document = np.repeat(np.arange(len(each)), each)
        kept_order = np.lexsort((at, document))
        at, times = at[kept_order], times[kept_order]
        steps = np.diff(at, prepend=0)
        firsts = (np.cumsum(each) - each)[each > 0]
        steps[firsts] = at[firsts]  # each document's places ascend from its first
        ids = pa.concat_arrays(self.ids)
        packed = (np.concatenate(self.sizes), np.concatenate(self.whole), each, steps, times)
        yield {"ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
               **{name: pa.array([squeezed(value)], pa.binary()) for name, value in zip(PACKED, packed)}}
        if found:
            yield {"bucket": pa.array(found, pa.int32()), "texts": pa.array(texts, pa.binary()), "lengths": pa.array(lengths, pa.binary())}


def gathered(rows: DataFrame, name: str, buckets: int, group_bytes: int = GROUP_BYTES, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """Packed groups (bucket is null) and the pieces that each group sends to each bucket (ids are null)."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    binary = ("texts", "lengths", *PACKED)
    names = ["group", "ids", "bucket", *binary]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, number, types = Group(name, buckets), TaskContext.get().partitionId() << 32, {}

        def sent() -> Iterator[pa.RecordBatch]:
            for columns in group.rows():
                n = len(next(iter(columns.values())))
                columns["group"] = pa.array(np.full(n, number))
                yield pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, types[c]) for c in names], names)

        for batch, data, offsets in blocks(batches):
            types = {"ids": pa.list_(batch.column("doc_id").type), "bucket": pa.int32(), **dict.fromkeys(binary, pa.binary())}
            group.add(batch.column("doc_id"), data, offsets)
            if group.bytes >= group_bytes or group.held >= group_pairs:
                yield from sent()
                group.clear()
                number += 1
        if group.ids:
            yield from sent()

    return rows.mapInArrow(work, f"group bigint, ids array<{kind}>, bucket int, " + ", ".join(f"{c} binary" for c in binary))


def piece_counts(table: DataFrame, name: str, buckets: int) -> DataFrame:
    """group, bucket, counts: tokens of the pieces that a group sent, each distinct one counted once in its bucket."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(lambda pieces: counted(name, [p.decode() for p in pieces]))
        for batch in batches:
            counts = []
            for texts, lengths in zip(batch.column("texts").to_pylist(), batch.column("lengths").to_pylist()):
                data, ends = np.frombuffer(zstandard.decompress(texts), np.uint8), np.cumsum(restored(lengths))
                starts = np.append(0, ends[:-1])
                counts.append(squeezed(known(data, starts, ends, range_hashes(data, starts, ends))))
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("bucket"), pa.array(counts, pa.binary())], ["group", "bucket", "counts"])

    sent = table.filter("bucket is not null").select("group", "bucket", "texts", "lengths")
    return sent.repartition(buckets, "bucket").mapInArrow(work, "group bigint, bucket int, counts binary")


def token_counts(docs: DataFrame, name: str = TOKENIZER, limit: int = LIMIT, id_column: str = "doc_id",
                 text_column: str = "text", group_bytes: int = GROUP_BYTES, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """id, n_bytes, n_tokens and whether there are more tokens than `limit`."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind, buckets = rows.schema["doc_id"].dataType.simpleString(), spread(docs.sparkSession)
    table = kept(gathered(rows, name, buckets, group_bytes, group_pairs), "pieces")
    packed = table.filter("ids is not null").select("group", "ids", *PACKED)
    tasks = spread(docs.sparkSession, packed.count() // GROUPS_A_TASK)
    answers = (piece_counts(table, name, buckets).repartition(tasks, "group")
               .groupBy("group").agg(F.array_sort(F.collect_list(F.struct("bucket", "counts"))).alias("answers")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sizes, whole, each, steps, times = (restored(batch.column(c)[i].as_py()) for c in PACKED)
                own = [restored(a["counts"]) for a in batch.column("answers")[i].as_py() or []]
                counts = np.concatenate(own) if own else np.zeros(0, np.int64)
                ends = np.cumsum(each)
                begins = ends - each
                places = np.cumsum(steps)
                before = np.append(0, places)[begins]  # what earlier documents' steps add up to
                places -= np.repeat(before, each)
                sums = np.append(0, np.cumsum(counts[places] * times))
                tokens = whole + sums[ends] - sums[begins]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return (packed.repartition(tasks, "group").join(answers, "group", "left")
            .mapInArrow(work, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
