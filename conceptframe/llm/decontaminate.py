"""Benchmark decontamination with suffix arrays over the training words.

A training shard is a block of whole documents. Its suffix array holds the word positions in the
order of what follows them, up to a window's length and never beyond the document. Every suffix of
every test item is found in it by binary search: the neighbours of its place give the longest
verbatim match, and the places that share a whole window are its occurrences. Positions whose first
word no test suffix begins with, or whose first two words none begins with (where two are asked
for), cannot match a window and are left out of the array before it is sorted.

The test items travel to the tasks as one broadcast of at most `BLOCK_BYTES`; a larger benchmark goes
in several such blocks, whose findings are added up for each document.

Nulls: a null text, in documents or items, has no words. An item without id hits like any other, but
names nothing: it is not among a document's items. Null
document ids: rows stand by themselves; repeated ids: one row out for each row in. Items of fewer
words than a window are one window of all their words; items without words occur nowhere. Empty
tables: no documents, no rows; no items, nothing is hit. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptframe.llm.buffers import BETWEEN, LOWER, U64, blocks, bytes_of, range_hashes, ranges, row_numbers, spans
from conceptframe.llm.shared import documents, kept

NAME = "op10_benchmark_decontamination"
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS words
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS words
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT r, k, n, item_id FROM places JOIN windows USING (n, words)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""
WINDOW, SHARE = 13, 20
BLOCK_BYTES = 32 << 20


class Suffixes:
    """Sorted suffixes of one set of texts: word hashes from each start, up to `width` words."""

    def __init__(self, hashes: np.ndarray, left: np.ndarray, starts: np.ndarray, width: int):
        """left: words from each position to the end of its text; starts: the positions to sort."""
        self.hashes, self.left, self.width = np.append(hashes, U64(0)), left, width
        order = starts
        for k in range(width - 1, -1, -1):  # least significant word first; stable
            order = order[np.argsort(self.word(order, k), kind="stable")]
        self.order = order

    def word(self, at: np.ndarray, k: int) -> np.ndarray:
        """The k-th word from each position; 0 beyond the text's end, before all words."""
        return np.where(self.left[at] > k, self.hashes[np.minimum(at + k, len(self.hashes) - 1)], U64(0))


def matches(test: Suffixes, asked: np.ndarray, train: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each asked test position: first and last place in the training order of the suffixes that
    share all its `width` words (or all it has), and the longest match in words."""
    lo = np.zeros(len(asked), np.int64)
    hi = np.full(len(asked), len(train.order), np.int64)
    depth = np.zeros(len(asked), np.int64)
    live = np.arange(len(asked))
    keep_lo, keep_hi = lo.copy(), hi.copy()
    wanted = np.minimum(test.left[asked], test.width)
    for k in range(test.width):
        live = live[(wanted[live] > k) & (keep_lo[live] < keep_hi[live])]
        if not len(live):
            break
        word = test.word(asked[live], k)
        a = _bound(train, k, word, keep_lo[live], keep_hi[live], False)
        b = _bound(train, k, word, a, keep_hi[live], True)
        depth[live[a < b]] = k + 1
        keep_lo[live], keep_hi[live] = a, b
    full = depth == wanted
    return np.where(full, keep_lo, 0), np.where(full, keep_hi, 0), depth


def _bound(train: Suffixes, k: int, word: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of each word among the k-th words of its own range of the suffix array."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        there = train.word(train.order[mid], k)
        go = there <= word[open_] if right else there < word[open_]
        lo[open_[go]] = mid[go] + 1
        hi[open_[~go]] = mid[~go]


class TestSet:
    """Words of the items of one block, and the windows that begin at each position."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int):
        data, offsets = bytes_of(texts)
        data = LOWER[data]
        starts, ends, firsts = spans(data, offsets, BETWEEN)
        self.ids, self.window = ids, window
        self.hashes = range_hashes(data, starts, ends)
        self.item = row_numbers(firsts)
        self.left = firsts[1:][self.item] - np.arange(len(starts)) if len(starts) else np.zeros(0, np.int64)
        size = np.diff(firsts)[self.item] if len(starts) else np.zeros(0, np.int64)
        # windows: every start with a whole window, or the first word of a shorter item
        short = size < window
        self.asked = np.flatnonzero((self.left >= window) | (short & (self.left == size)))
        self.table = Suffixes(self.hashes, self.left, np.zeros(0, np.int64), window)
        self.one = self.left[self.asked] == 1
        self.bits = np.zeros(1 << 23, bool)
        self.bits[_slots(self.hashes[self.asked[self.one]])] = True
        two = self.asked[~self.one]
        self.bits[_slots(_pair(self.hashes[two], self.hashes[two + 1]))] = True
        self.any_one = bool(self.one.any())

    def begins(self, hashes: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Training positions whose first word, or two, may begin a window."""
        may = np.zeros(len(hashes), bool)
        if self.any_one:
            may |= self.bits[_slots(hashes)]
        if len(hashes) > 1:
            may[:-1] |= (left[:-1] > 1) & self.bits[_slots(_pair(hashes[:-1], hashes[1:]))]
        return np.flatnonzero(may)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * U64(0x9E3779B97F4A7C15) + b


def _slots(x: np.ndarray) -> np.ndarray:
    return ((x * U64(0xD6E8FEB86659FD93)) >> U64(41)).astype(np.int64)


def test_blocks(benchmark: DataFrame, id_column: str, text_column: str, most: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items in blocks of at most `most` bytes of text (one item alone may be longer)."""
    held, size = [], 0
    rows = benchmark.select(F.col(id_column).cast("string").alias("i"), F.col(text_column).cast("string").alias("t"))
    for row in rows.filter("t is not null").toLocalIterator():
        if held and size + len(row.t.encode()) > most:
            yield held
            held, size = [], 0
        held.append((row.i, row.t))
        size += len(row.t.encode())
    yield held


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, id_column: str = "doc_id",
                  text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
                  most: int = BLOCK_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: n_words, n_hit, items with an occurring window, longest match, locations.

    locations: hit runs of words (start, length) and the items' ids; contaminated if hit words are
    one in `share` or more. `keep`: further columns of `docs` to carry along.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"), *[F.col(k).alias(f"_keep_{k}") for k in keep])
    carried = [c for c in rows.columns if c not in ("_id", "_text")]
    base = [(f.name, f.dataType) for f in rows.schema if f.name != "_text" or text_column in keep]
    held = test_blocks(benchmark, item_column, item_text, most)
    first, second = next(held), next(held, None)

    def search(block: list[tuple[str, str]], frame: DataFrame) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = sent.value
            test = TestSet([i for i, _ in items], pa.array([t for _, t in items], pa.large_string()), window)
            for batch, data, offsets in blocks(batches, "_text"):
                yield _found(batch, data, offsets, test, ["_id", *carried])

        types = {f.name: f.dataType.simpleString() for f in frame.schema}
        schema = ", ".join(f"`{n}` {types[n]}" for n in ["_id", *carried])
        return frame.mapInArrow(work, schema + ", n_words bigint, hits array<struct<start:int,length:int>>, items array<string>, longest int")

    if second is None:
        found = search(first, rows)
    else:  # several blocks: the findings of each row are added up under a number of its own
        numbered = kept(rows.withColumn("_keep__row", F.monotonically_increasing_id()), "numbered")
        carried = [c for c in numbered.columns if c not in ("_id", "_text")]
        union = None
        for block in chain([first, second], held):  # the driver holds two of them at most
            part = kept(search(block, numbered), "found")
            union = part if union is None else union.unionByName(part)
        found = union.groupBy("_keep__row").agg(
            *[F.first(c).alias(c) for c in ["_id", *carried] if c != "_keep__row"], F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"),
            F.max("longest").alias("longest"))
    hit = F.col("hits").getField("start"), F.col("hits").getField("length")
    covered = F.aggregate(F.array_sort("hits"), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")), lambda s, h: F.struct(
        (s["n"] + F.greatest(F.lit(0), h["start"] + h["length"] - F.greatest(s["end"], h["start"].cast("bigint")))).alias("n"),
        F.greatest(s["end"], (h["start"] + h["length"]).cast("bigint")).alias("end")))["n"]
    items = F.array_sort(F.array_distinct(F.array_compact("items")))  # an id may have several rows, in one block or in several
    return found.select(
        F.col("_id").alias("doc_id"), *[F.col(f"_keep_{k}").alias(k) for k in keep if k not in (id_column,)],
        "n_words", covered.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), items.alias("items"),
        F.col("hits").alias("locations"), F.col("longest").alias("longest_match"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))


def _found(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, test: TestSet, names: list[str]) -> pa.RecordBatch:
    rows = batch.num_rows
    starts, ends, firsts = spans(LOWER[data], offsets, BETWEEN)
    hashes = range_hashes(LOWER[data], starts, ends)
    row = row_numbers(firsts)
    left = firsts[1:][row] - np.arange(len(starts)) if len(starts) else np.zeros(0, np.int64)
    train = Suffixes(hashes, left, test.begins(hashes, left), test.window)
    lo, hi, _ = matches(test.table, test.asked, train)
    n = hi - lo
    at = train.order[ranges(lo, n)]  # occurrences of windows
    which = np.repeat(np.arange(len(lo)), n)
    length = np.minimum(test.left[test.asked], test.window)[which]
    # hit words and, of each document, the items
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + length, -1)
    inside = np.cumsum(change[:-1]) > 0
    edge = np.zeros(len(starts) + 1, bool)
    edge[firsts] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    run = np.flatnonzero(after & (~before | edge))
    run_end = np.flatnonzero(before & (~after | edge))
    per_row = np.searchsorted(run, firsts)
    pairs = np.unique(np.stack([row[at], test.item[test.asked[which]]]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
    names_of = pa.array([test.ids[i] for i in pairs[1].tolist()], pa.string())
    item_rows = np.searchsorted(pairs[0], np.arange(rows + 1))
    longest = np.zeros(rows, np.int32)
    if len(at):  # windows that follow one another, in the document and in the item, are one match
        place = test.asked[which]
        order = np.lexsort((at, at - place))
        a, b = at[order], place[order]
        joined = np.concatenate([[False], (np.diff(a) == 1) & (np.diff(b) == 1) & (row[a[1:]] == row[a[:-1]]) & (test.item[b[1:]] == test.item[b[:-1]])])
        head = np.flatnonzero(~joined)
        tail = np.append(head[1:], len(a)) - 1
        np.maximum.at(longest, row[a[head]], (a[tail] - a[head] + length[order][tail]).astype(np.int32))
    hits = pa.StructArray.from_arrays([pa.array((run - firsts[row[run]]).astype(np.int32)) if len(run) else pa.array([], pa.int32()),
                                       pa.array((run_end - run).astype(np.int32))], ["start", "length"])
    return pa.RecordBatch.from_arrays(
        [batch.column(n) for n in names] + [
            pa.array(np.diff(firsts), pa.int64()), pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), hits),
            pa.ListArray.from_arrays(pa.array(item_rows, pa.int32()), names_of), pa.array(longest)],
        names + ["n_words", "hits", "items", "longest"])


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    columns = docs.columns
    numbered = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    found = contamination(numbered, benchmark, id_column=names["doc_id"], text_column=names["text"], keep=tuple(numbered.columns), **options)
    return found.filter("not contaminated").select(*[
        (F.col("doc_id") if c == "doc_id" else F.col(names[c])).alias(c) for c in columns])


def digest_columns(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
                        "longest_match", F.size("locations").alias("n_runs"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
                          ).drop("longest_match", "n_runs")
