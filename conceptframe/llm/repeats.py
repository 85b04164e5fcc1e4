"""Repeated-passage removal by prefix-free parsing and suffix order.

Parse. A rolling hash over `TRIGGER` bytes slides over each text. Every string of `SPAN` bytes belongs
to the trigger with the smallest hash among those that start in its first `SPAN - CONTEXT` + 1 bytes
(the leftmost of equals), so the choice depends on the string alone: equal strings have the trigger
at the same place, wherever they stand. Strings next to each other with one trigger make a phrase:
the bytes from its first string's start to its last one's end.

Dictionary. Phrases meet by the `CONTEXT` bytes from their trigger on; equal strings always do. A
phrase whose context occurs nowhere else holds no repeated string. Equal phrases count once: all
later ones are repeated throughout, whatever their length. What is left are the first copies of
distinct phrases that share a context: the dictionary to sort.

Suffix order. For these phrases the text around the trigger is fetched. Phrases of one context are
sorted twice: by what follows the trigger (the order of the parse) and by what precedes it, read
backwards (the order of the dictionary's suffixes). Common prefix lengths of neighbours in both
orders tell the classes of equal left parts and of equal right parts at each depth; a string with d
bytes before the trigger is the pair of its left class at depth d and right class at depth SPAN - d.
The first such pair in corpus order is the original, all others are repeated.

Removal. Repeated strings go back to their documents as byte intervals, and are united there.

Triggers here are local minima of the rolling hash instead of the hashes that are 0 modulo a number:
the phrases' lengths are then bounded, and a string of 100 bytes never lacks a trigger.

Nulls: a null text is empty. Null ids come first in corpus order; rows with the same id follow one
another in the order of their texts' hashes (equal rows in any order: they hold the same bytes).
Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptframe.llm.buffers import U64, blocks, mix, range_hashes, ranges, rolling
from conceptframe.llm.shared import documents, kept, spread

NAME = "op3_repeated_passages"
SQL = None  # tests hold it against brute force over all 100-byte strings
SPAN, CONTEXT, TRIGGER = 100, 32, 12
PHRASES = 1_000_000  # in a bucket, about
TEXT_BYTES = 16 << 20  # of texts in a bucket, about
TEXT_BLOCK = 512 << 10


class Parse:
    """Phrases of one block of rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        first_d = SPAN - CONTEXT + 1  # trigger starts are 0 .. first_d - 1 bytes after a string's start
        self.trigger = self.low = self.high = self.row = np.zeros(0, np.int64)
        if n < SPAN:
            return
        key = rolling(data, TRIGGER)
        at = _leftmost_minimum(key, first_d)  # trigger of the string that starts at each byte
        size = np.diff(offsets)
        long = np.flatnonzero(size >= SPAN)
        if not len(long):
            return
        starts = ranges(offsets[:-1][long], size[long] - SPAN + 1)
        row = np.repeat(long, size[long] - SPAN + 1)
        trigger = at[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(starts)) - 1
        self.trigger, self.low, self.high, self.row = trigger[head], starts[head], starts[tail], row[head]

    def context(self, data: np.ndarray) -> np.ndarray:
        return range_hashes(data, self.trigger, self.trigger + CONTEXT)

    def phrase(self, data: np.ndarray) -> np.ndarray:
        """Hash of the whole phrase and of the trigger's place in it."""
        return mix(range_hashes(data, self.low, self.high + SPAN) + (self.trigger - self.low).astype(U64))


def _leftmost_minimum(key: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest key (leftmost of equals) in each window of `width` keys."""
    n = len(key)
    place = np.arange(n)
    best, where, reach = key, place, 1
    while reach < width:
        step = min(reach, width - reach)
        m = len(best) - step
        if m <= 0:
            break
        other, there = best[step:], where[step:]
        right = other < best[:m]
        best = np.where(right, other, best[:m])
        where = np.where(right, there, where[:m])
        reach += step
    out = np.zeros(n, np.int64)
    out[:len(where)] = where
    return out


def _columns(pack, **columns: np.ndarray) -> bytes:
    """Several arrays of one length in one value, each compressed."""
    parts = [pack.compress(np.ascontiguousarray(c).tobytes()) for c in columns.values()]
    return b"".join([np.array([len(p) for p in parts], "<i8").tobytes(), *parts])


def _arrays(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, "<i8", len(kinds))
    at = 8 * len(kinds)
    out = []
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[at:at + size]), kind))
        at += size
    return out


def _scattered(bucket: np.ndarray, buckets: int, columns: list[np.ndarray], pack) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in columns]
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(cut))
    parts = [_columns(pack, **{str(k): c[cut[b]:cut[b + 1]] for k, c in enumerate(columns)}) for b in some.tolist()]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(parts, pa.binary())], ["bucket", "part"])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    last, held = None, []
    for batch in batches:
        for k, v in zip(batch.column("bucket").to_pylist(), batch.column("part")):
            if held and k != last:
                yield last, held
                held = []
            last = k
            held.append(v.as_py())
    if held:
        yield last, held


def _joined(parts: list[bytes], kinds: tuple) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*[_arrays(p, kinds) for p in parts])]


PART = "bucket int, part binary"
#: Kinds of the columns of a phrase: context, phrase, row key, trigger, bytes from the lowest start to
#: the trigger and from the highest one.
PHRASE_KINDS = (U64, U64, "<i8", "<i4", "<i2", "<i2")


def texts_in_buckets(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, first row key, sizes and compressed texts: rows in corpus order, cut into small blocks.

    The row key is (place in corpus order); texts of one bucket are consecutive documents.
    """
    text = F.col("text")
    rows = docs.select("doc_id", "text", F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange(buckets, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, pack, number = TaskContext.get().partitionId(), zstandard.ZstdCompressor(3), 0
        for batch, data, offsets in blocks(batches, block=TEXT_BLOCK):
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([number], pa.int64()),
                 pa.array([np.diff(offsets).astype("<i4").tobytes()], pa.binary()), pa.array([pack.compress(data.tobytes())], pa.binary()),
                 pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)],
                ["bucket", "number", "sizes", "texts", "ids"])
            number += len(offsets) - 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ordered.select("doc_id", "text").mapInArrow(
        work, f"bucket int, number bigint, sizes binary, texts binary, ids array<{kind}>")


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    unpack = zstandard.ZstdDecompressor()
    for i in range(batch.num_rows):
        row = {n: batch.column(n)[i].as_py() for n in ("bucket", "number", "sizes", "texts")}
        sizes = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
        data = np.frombuffer(unpack.decompress(row["texts"]), np.uint8) if sizes.sum() else np.zeros(0, np.uint8)
        yield row | {"at": i}, data, np.concatenate([[0], np.cumsum(sizes)])


ROW_BITS = 36  # a row key: bucket of texts, then number inside it


def phrases(texts: DataFrame, buckets: int) -> DataFrame:
    """All phrases, dealt by their contexts into packed parts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, held, size = zstandard.ZstdCompressor(1), [], 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held)]
            return _scattered((columns[0] % U64(buckets)).astype(np.int64), buckets, columns, pack)

        for batch in batches:
            for row, data, offsets in _opened(batch):
                own = Parse(data, offsets)
                if not len(own.row):
                    continue
                key = (row["bucket"] << ROW_BITS) + row["number"] + own.row
                trigger = own.trigger - offsets[own.row]
                # the context's hash only has to bring phrases together: 40 bits keep it small
                held.append((own.context(data) >> U64(24), own.phrase(data), key.astype("<i8"), trigger.astype("<i4"),
                             (own.trigger - own.low).astype("<i2"), (own.trigger - own.high).astype("<i2")))
                size += len(own.row)
                if size > PHRASES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return texts.mapInArrow(work, PART)


#: Kinds of what goes back to the texts: row key, trigger, lowest and highest start before it.
BACK_KINDS = ("<i8", "<i4", "<i2", "<i2")


def dictionary(parts: DataFrame, buckets: int, text_buckets: int) -> DataFrame:
    """Decisions on phrases, dealt back to the buckets of texts.

    `live` 0: the phrase is a later copy, all its strings are repeated. 1: first copy of one of
    several phrases with this context; its strings are to be sorted. Phrases alone with their
    context are left out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(1)
        for _, packed in _by_bucket(batches):
            context, phrase, key, trigger, low, high = _joined(packed, PHRASE_KINDS)
            order = np.argsort(context, kind="stable")
            c = context[order]
            same = np.zeros(len(c), bool)
            same[1:] = c[1:] == c[:-1]
            same[:-1] |= same[1:]
            order = order[same]
            order = order[np.lexsort((trigger[order], key[order], phrase[order], context[order]))]
            c, p = context[order], phrase[order]
            new_context = np.ones(len(c), bool)
            new_context[1:] = c[1:] != c[:-1]
            new_phrase = new_context.copy()
            new_phrase[1:] |= p[1:] != p[:-1]
            group = np.cumsum(new_context) - 1
            distinct = np.bincount(group, weights=new_phrase)[group] if len(c) else np.zeros(0)
            for live, take in ((0, ~new_phrase), (1, new_phrase & (distinct > 1))):
                at = order[take]
                if len(at):
                    out = _scattered(key[at] >> ROW_BITS, text_buckets, [key[at], trigger[at], low[at], high[at]], pack)
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(out.num_rows, live, np.int32))], ["bucket", "part", "live"])

    return parts.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(work, PART + ", live int")


def surroundings(texts: DataFrame, back: DataFrame, buckets: int, text_buckets: int) -> DataFrame:
    """Bytes around the triggers of the dictionary's phrases, dealt by context."""
    live = back.filter("live = 1").select("bucket", F.lit(0).cast("bigint").alias("number"), F.col("part").alias("sizes"), F.lit(None).cast("binary").alias("texts"))
    both = live.unionByName(texts.select("bucket", (F.col("number") + 1).alias("number"), "sizes", "texts"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, held, size, last, wanted, parts = zstandard.ZstdCompressor(3), [], 0, None, None, []

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held)]
            bucket = (columns[0] % U64(buckets)).astype(np.int64)
            return _scattered(bucket, buckets, [columns[0], columns[1].view("V168").reshape(-1), *columns[2:]], pack)

        for batch in batches:
            for i in range(batch.num_rows):
                bucket, number = batch.column("bucket")[i].as_py(), batch.column("number")[i].as_py()
                if bucket != last:
                    last, wanted, parts = bucket, None, []
                if number == 0:
                    parts.append(batch.column("sizes")[i].as_py())
                    continue
                if wanted is None:
                    wanted = _joined(parts, BACK_KINDS) if parts else [np.zeros(0, np.int64)] * 4
                    order = np.lexsort((wanted[1], wanted[0]))
                    wanted, parts = [w[order] for w in wanted], []
                row, data, offsets = next(_opened(batch.slice(i, 1)))
                base = (bucket << ROW_BITS) + number - 1
                a, b = np.searchsorted(wanted[0], [base, base + len(offsets) - 1])
                if a == b:
                    continue
                key, trigger, low, high = (w[a:b] for w in wanted)
                start, end = offsets[key - base], offsets[key - base + 1]
                at = start + trigger
                # left part backwards, right part forwards; beyond the text: zeros, never asked for
                around = np.zeros((len(at), SPAN - CONTEXT + SPAN), np.uint8)
                left = at[:, None] - 1 - np.arange(SPAN - CONTEXT)
                right = at[:, None] + np.arange(SPAN)
                around[:, :SPAN - CONTEXT] = np.where(left >= start[:, None], data[np.maximum(left, 0)], 0)
                around[:, SPAN - CONTEXT:] = np.where(right < end[:, None], data[np.minimum(right, len(data) - 1)], 0)
                held.append((range_hashes_any(data, at, at + CONTEXT) >> U64(24), around, key, trigger, low, high))
                size += len(at)
                if size > 100_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return both.repartition(text_buckets, "bucket").sortWithinPartitions("bucket", "number").mapInArrow(work, PART)


def range_hashes_any(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """range_hashes for ranges in any order."""
    order = np.argsort(starts, kind="stable")
    out = np.empty(len(starts), U64)
    out[order] = range_hashes(data, starts[order], ends[order])
    return out


AROUND_KINDS = (U64, "V168", *BACK_KINDS)


def sorted_strings(around: DataFrame, buckets: int, text_buckets: int) -> DataFrame:
    """Repeated strings among the dictionary's phrases: row key, first start, last start."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(1)
        for _, packed in _by_bucket(batches):
            context, raw, key, trigger, low, high = _joined(packed, AROUND_KINDS)
            out = repeated_strings(context, raw.view(np.uint8).reshape(-1, 168), key, trigger, low, high)
            if len(out[0]):
                yield _scattered(out[0] >> ROW_BITS, text_buckets, list(out), pack)

    return around.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(work, PART)


def _common(rows: np.ndarray, order: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with its predecessor in `order`; -1 where the context changes."""
    shared = np.zeros(len(order), np.int64)
    step = 65_536
    for i in range(1, len(order), step):
        a, b = rows[order[i - 1:min(i + step, len(order)) - 1]], rows[order[i:i + step]]
        differ = a != b
        shared[i:i + step] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    c = context[order]
    shared[1:][c[1:] != c[:-1]] = -1
    shared[:1] = -1
    return shared


def _suffix_order(context: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Order of byte rows inside each context."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, :rows.shape[1]] = rows
    words = padded.view(">u8").astype(U64)
    return np.lexsort((*[words[:, k] for k in range(words.shape[1] - 1, -1, -1)], context))


def repeated_strings(context, around, key, trigger, low, high) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row key, first and last start of runs of strings that also start earlier in the corpus."""
    depth = SPAN - CONTEXT
    left, right = around[:, :depth], around[:, depth:]
    by_left, by_right = _suffix_order(context, left), _suffix_order(context, right)
    shared_left, shared_right = _common(left, by_left, context), _common(right, by_right, context)
    place = np.lexsort((trigger, key))  # corpus order of the triggers
    rank = np.empty(len(key), np.int64)
    rank[place] = np.arange(len(key))
    keys, starts = [], []
    left_class, right_class = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    for d in range(depth + 1):
        has = np.flatnonzero((low >= d) & (high <= d))
        if len(has) < 2:
            continue
        left_class[by_left] = np.cumsum(shared_left < d)
        right_class[by_right] = np.cumsum(shared_right < SPAN - d)
        order = has[np.lexsort((rank[has], right_class[has], left_class[has]))]
        again = (left_class[order[1:]] == left_class[order[:-1]]) & (right_class[order[1:]] == right_class[order[:-1]])
        at = order[1:][again]
        keys.append(key[at])
        starts.append(trigger[at].astype(np.int64) - d)
    if not sum(map(len, keys)):
        none = np.zeros(0, np.int64)
        return none, none.astype("<i4"), none.astype("<i4")
    k, s = np.concatenate(keys), np.concatenate(starts)
    order = np.lexsort((s, k))
    k, s = k[order], s[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(k)) - 1
    return k[head], s[head].astype("<i4"), s[tail].astype("<i4")


RUN_KINDS = ("<i8", "<i4", "<i4")


def removed(texts: DataFrame, back: DataFrame, runs: DataFrame, text_buckets: int, with_text: bool) -> DataFrame:
    """Per row: sizes, removed spans and what is left."""
    none = F.lit(None).cast("binary")
    kind = texts.schema["ids"].dataType
    marks = back.filter("live = 0").select("bucket", F.lit(-2).cast("bigint").alias("number"), F.col("part").alias("sizes"), none.alias("texts")).unionByName(
        runs.select("bucket", F.lit(-1).cast("bigint").alias("number"), F.col("part").alias("sizes"), none.alias("texts"))).withColumn("ids", F.lit(None).cast(kind))
    both = marks.unionByName(texts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, copies, runs_, spans_ = None, [], [], None
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, number = batch.column("bucket")[i].as_py(), batch.column("number")[i].as_py()
                if bucket != last:
                    last, copies, runs_, spans_ = bucket, [], [], None
                if number < 0:
                    (copies if number == -2 else runs_).append(batch.column("sizes")[i].as_py())
                    continue
                if spans_ is None:
                    spans_ = _intervals(copies, runs_)
                    copies, runs_ = [], []
                one = batch.slice(i, 1)
                _, data, offsets = next(_opened(one))
                base = (bucket << ROW_BITS) + number
                a, b = np.searchsorted(spans_[0], [base, base + len(offsets) - 1])
                yield _cut(one.column("ids").flatten(), data, offsets, spans_[0][a:b] - base, spans_[1][a:b], spans_[2][a:b], with_text)

    id_kind = kind.elementType.simpleString()
    schema = f"doc_id {id_kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:int,end:int>>"
    return both.repartition(text_buckets, "bucket").sortWithinPartitions("bucket", "number").mapInArrow(work, schema + (", kept binary" if with_text else ""))


def _intervals(copies: list[bytes], runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row key, start and end of removed bytes, by row and start."""
    keys, starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if copies:
        key, trigger, low, high = _joined(copies, BACK_KINDS)
        keys.append(key)
        starts.append(trigger.astype(np.int64) - low)
        ends.append(trigger.astype(np.int64) - high + SPAN)
    if runs:
        key, first, last = _joined(runs, RUN_KINDS)
        keys.append(key)
        starts.append(first.astype(np.int64))
        ends.append(last.astype(np.int64) + SPAN)
    key, start, end = np.concatenate(keys), np.concatenate(starts), np.concatenate(ends)
    order = np.lexsort((start, key))
    return key[order], start[order], end[order]


def _cut(ids, data, offsets, row, start, end, with_text) -> pa.RecordBatch:
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, offsets[row] + start, 1)
    np.add.at(change, offsets[row] + end, -1)
    gone = np.cumsum(change[:-1]) > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.concatenate([[False], gone]), np.concatenate([gone, [False]])
    heads, tails = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
    runs = np.searchsorted(heads, offsets)
    left = data[~gone].tobytes()
    sums = np.concatenate([[0], np.cumsum(~gone)])
    cut = sums[offsets]
    texts = [left[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(runs))
    pairs = pa.StructArray.from_arrays([pa.array((heads - offsets[of]).astype(np.int32)), pa.array((tails - offsets[of]).astype(np.int32))], ["start", "end"])
    size = np.diff(offsets)
    columns = [ids, pa.array(size, pa.int64()), pa.array(size - np.diff(cut), pa.int64()), pa.array(np.diff(runs), pa.int64()),
               pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.ListArray.from_arrays(pa.array(runs, pa.int32()), pairs)]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    if with_text:
        columns, names = [*columns, pa.array(texts, pa.binary())], [*names, "kept"]
    return pa.RecordBatch.from_arrays(columns, names)


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: n_bytes, n_removed, n_spans, kept_sha256, the removed spans and, if asked, the bytes left."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    text_buckets = spread(spark, -(-total // TEXT_BYTES))
    buckets = spread(spark, -(-total // (35 * PHRASES)))
    texts = kept(texts_in_buckets(docs, text_buckets), "texts")
    text_buckets = 1 + (texts.agg(F.max("bucket")).first()[0] or 0)
    back = kept(dictionary(phrases(texts, buckets), buckets, text_buckets), "phrases")
    runs = sorted_strings(surroundings(texts, back, buckets, text_buckets), buckets, text_buckets)
    return removed(texts, back, runs, text_buckets, with_text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir)).drop("spans")
