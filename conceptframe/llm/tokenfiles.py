"""Token-id files: shards of documents in ascending id order, each packed by a pair grammar.

Documents are range-partitioned by id; each task encodes its documents in order and cuts the stream
into shards of about `SHARD_IDS` ids. A shard is packed on its own: the most frequent pairs of
neighbouring symbols become nonterminals, round by round, never across the end of a document. What
is written is one binary image for each shard (format below) in a Parquet table, so that executors
write and read it wherever the session's storage is. Decoding needs the rules' expansion lengths
only, and any document alone can be decoded from its own symbols.

Image, little-endian: 8 bytes magic; uint32 numbers of documents, rules, symbols and first
nonterminal; per document uint32 ids and uint32 symbols; per rule uint32 left, uint32 right and
uint32 expansion length; the symbols as uint16, or uint32 if an id needs it. The ids of documents
(long, with a null mask) are columns beside the image.

Nulls: a null text is empty and gets only the end id; null ids come first; repeated ids keep one
entry each, in the order of the texts' hashes. An empty table gives an empty folder and no rows.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conceptframe.llm.buffers import blocks, ranges
from conceptframe.llm.shared import documents, shared_folder, spread
from conceptframe.llm.tokenizing import tokenizer, word_ids

NAME = "op8_token_files"
SQL = None  # a tokenizer is no SQL; tests hold ids and round trips against the library itself
TOKENIZER, END_ID = "word_bpe_49k.json", 1
SHARD_IDS = 1 << 20
ROUNDS, PAIRS_A_ROUND, LEAST = 7, 2048, 6
BIN_BITS = 18  # pairs are counted in so many bins
MAGIC = b"PAIRGRM1"
SHARDS = ("part int, seq int, n_docs int, n_ids bigint, doc_ids binary, id_nulls binary, image binary")


def pack(ids: np.ndarray, lengths: np.ndarray, first: int) -> bytes:
    """Image of consecutive documents' ids. `first`: the first number that no id uses."""
    wide = first + ROUNDS * PAIRS_A_ROUND > 1 << 16
    half, word = (32, np.uint64) if wide else (16, np.uint32)
    spread_, cut = (word(0x9E3779B97F4A7C15), word(64 - BIN_BITS)) if wide else (word(0x9E3779B1), word(32 - BIN_BITS))
    symbols = ids.astype(word)
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(lengths) - 1] = True
    room = (1 << 31 if wide else 1 << 16) - first
    left, right = [], []
    used, expansion = 0, np.zeros(min(room, ROUNDS * PAIRS_A_ROUND), np.uint32)
    for _ in range(ROUNDS):
        if len(symbols) < 2 or room - used < 1:
            break
        at = np.flatnonzero(~last[:-1])  # where a pair may begin
        pair = (symbols[at] << word(half)) | symbols[at + 1]
        bins = ((pair * spread_) >> cut).astype(np.intp)
        counts = np.bincount(bins, minlength=1 << BIN_BITS)
        holder = np.zeros(1 << BIN_BITS, word)
        holder[bins] = pair  # one pair for each bin; another one in the same bin waits
        heavy = np.flatnonzero(counts >= LEAST)
        most = min(PAIRS_A_ROUND, room - used)
        if len(heavy) > most:
            heavy = heavy[np.argpartition(counts[heavy], len(heavy) - most)[len(heavy) - most:]]
        if not len(heavy):
            break
        number = np.zeros(1 << BIN_BITS, word)
        number[heavy] = first + used + np.arange(len(heavy), dtype=word)
        new = number[bins]
        chosen = np.flatnonzero(new)
        chosen = chosen[holder[bins[chosen]] == pair[chosen]]
        put = at[chosen]
        follows = np.concatenate([[False], np.diff(put) == 1])
        run = np.flatnonzero(~follows)
        since = np.arange(len(put)) - np.repeat(run, np.diff(np.append(run, len(put))))
        chosen = chosen[since % 2 == 0]
        put = at[chosen]
        a, b = (holder[heavy] >> word(half)).astype(np.uint32), (holder[heavy] & word((1 << half) - 1)).astype(np.uint32)
        expansion[used:used + len(heavy)] = _width(a, first, expansion) + _width(b, first, expansion)
        left.append(a)
        right.append(b)
        used += len(heavy)
        symbols[put] = new[chosen]
        last[put] = last[put + 1]
        keep = np.ones(len(symbols), bool)
        keep[put + 1] = False
        symbols, last = symbols[keep], last[keep]
    per_doc = np.diff(np.concatenate([[0], np.flatnonzero(last) + 1]))
    none = [np.zeros(0, np.uint32)]
    head = np.array([len(lengths), used, len(symbols), first], "<u4")
    parts = [head, lengths.astype("<u4"), per_doc.astype("<u4"), np.concatenate(left or none).astype("<u4"),
             np.concatenate(right or none).astype("<u4"), expansion[:used].astype("<u4"), symbols.astype("<u4" if wide else "<u2")]
    return MAGIC + b"".join(p.tobytes() for p in parts)


def _width(symbols: np.ndarray, first: int, expansion: np.ndarray) -> np.ndarray:
    rule = symbols >= first
    out = np.ones(len(symbols), np.uint32)
    out[rule] = expansion[symbols[rule] - first]
    return out


class Image:
    """A shard's image, opened; documents are numbered from 0 inside it."""

    def __init__(self, image: bytes):
        if image[:8] != MAGIC:
            raise ValueError("not a token shard")
        docs, rules, symbols, self.first = np.frombuffer(image, "<u4", 4, 8).tolist()
        at = 24
        parts = []
        for n in (docs, docs, rules, rules, rules):
            parts.append(np.frombuffer(image, "<u4", n, at))
            at += 4 * n
        self.lengths, self.per_doc, left, right, expansion = parts
        wide = self.first + ROUNDS * PAIRS_A_ROUND > 1 << 16
        self.symbols = np.frombuffer(image, "<u4" if wide else "<u2", symbols, at)
        self.sizes = np.concatenate([np.ones(self.first, np.int64), expansion])
        self.places = np.concatenate([np.arange(self.first), self.first + np.cumsum(expansion, dtype=np.int64) - expansion])
        pool = np.zeros(self.first + int(expansion.sum()), np.uint32)
        pool[:self.first] = np.arange(self.first)
        # a rule's sides are older than the rule: fill in waves, each of rules whose sides are filled
        done = 0
        while done < rules:
            a, b = left[done:], right[done:]
            limit = self.first + done
            bad = np.flatnonzero((a >= limit) | (b >= limit))
            ready = done + (int(bad[0]) if len(bad) else len(a))
            own = np.arange(done, ready)
            for side, shift in ((left[own], 0), (right[own], self.sizes[left[own]])):
                n = self.sizes[side]
                pool[ranges(self.places[self.first + own] + shift, n)] = pool[ranges(self.places[side], n)]
            done = ready
        self.pool = pool

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.pool[ranges(self.places[symbols], self.sizes[symbols])]

    def ids(self) -> np.ndarray:
        """Ids of all documents."""
        return self._expand(self.symbols)

    def document(self, n: int) -> np.ndarray:
        """Ids of one document; no other symbols are looked at."""
        start = int(self.per_doc[:n].sum())
        return self._expand(self.symbols[start:start + int(self.per_doc[n])])


def write_token_files(docs: DataFrame, folder: str, name: str = TOKENIZER, end_id: int = END_ID,
                      id_column: str = "doc_id", text_column: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode, pack and write all documents in ascending id order (nulls first)."""
    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), text.alias("text"),
                       F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    parts = spread(docs.sparkSession)
    ordered = rows.repartitionByRange(parts, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        words = word_ids(name)
        first = tokenizer(name).get_vocab_size(with_added_tokens=True)
        ids, lengths, keys, held = [], [], [], 0

        def shard() -> pa.RecordBatch:
            column = pa.chunked_array(keys, pa.int64()).combine_chunks()
            null = np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
            numbers = column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
            n = np.concatenate(lengths)
            image = pack(np.concatenate(ids), n, first)
            values = [[part], [seq], [len(n)], [int(n.sum())], [numbers.tobytes()], [np.packbits(null).tobytes()], [image]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            names = ["part", "seq", "n_docs", "n_ids", "doc_ids", "id_nulls", "image"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

        for batch, data, offsets in blocks(batches):
            own, n = words(data, offsets)
            ends = np.cumsum(n)
            ids.append(np.insert(own, ends, np.uint32(end_id)))
            lengths.append(n + 1)
            keys.append(batch.column("doc_id"))
            held += int(n.sum()) + len(n)
            if held >= shard_ids:
                yield shard()
                seq, ids, lengths, keys, held = seq + 1, [], [], [], 0
        if held:
            yield shard()

    ordered.select("doc_id", "text").mapInArrow(work, SHARDS).write.parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document from the files alone: doc_id, start, n_tokens, ids_crc32 and shard (part, seq)."""
    shards = spark.read.schema(SHARDS).parquet(folder)
    sizes = shards.select("part", "seq", "n_ids")
    in_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row for each partition that wrote files, not for each shard or document
    before = totals.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    starts = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0)).alias("inside")).join(before, "part")
    placed = shards.select("part", "seq", "doc_ids", "id_nulls", "image").join(
        starts.select("part", "seq", (F.col("before") + F.col("inside")).alias("start")), ["part", "seq"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(n)[row].as_py() for n in ("part", "seq", "doc_ids", "id_nulls", "image", "start")}
                image = Image(one["image"])
                ids = memoryview(image.ids().astype("<u4").tobytes())
                n = image.lengths.astype(np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[4 * s:4 * e]) for s, e in zip((ends - n).tolist(), ends.tolist())]
                null = np.unpackbits(np.frombuffer(one["id_nulls"], np.uint8))[:len(n)].astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(one["doc_ids"], "<i8"), pa.int64(), mask=null), pa.array(one["start"] + ends - n, pa.int64()),
                     pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(n), one["part"], np.int32)),
                     pa.array(np.full(len(n), one["seq"], np.int32))],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "part", "seq"])

    return placed.mapInArrow(work, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, part int, seq int")


def token_files(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the files (to a folder of the shared one, unless given) and read them back."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, folder, **options)
    return read_token_files(spark, folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir))
