"""Prefix trie of rebuilt conversations by truncation peeling.

Turns are replaced by digests and lengths before anything moves. A conversation becomes the chain of its
prefix keys (128 bits each: a prefix key is a hash of the shorter prefix's key and the turn), so that a
node is a (depth, key). Conversations that end at one node are merged first: their ids meet as sorted
packed runs and are hashed as a stream.

Peeling goes from the greatest depth down: at each depth the conversations that end there are merged
with the nodes that survived from below, complete nodes are written out, the last turn is stripped and
what is left is grouped again under the shorter prefix, with members, smallest member, childless nodes
and savings added up on the way. Where few different conversations begin with a prefix (a
quarter of an even share at most, or `LEAST`), the peeling down to that prefix runs inside one task;
prefixes of more are cut deeper (at depths 1, 2, 3, 4, 8, 16, ...), and the levels above the deepest cut
are peeled by grouped sums of whole levels, where a prefix that any share of all conversations begins
with is added up in partial sums. A level is a step of its own, so a long prefix that very many different
conversations share costs as many steps as it has turns. One conversation is handled as one row (its
keys and lengths, 24 bytes a turn, never its texts).

Order of turns: null first; equal turns by digest. Null roles and texts count as empty. Rows without
conv_id are no conversation and take no part. Repeated rows are turns of their own. A conversation
without turns is a member of the root. An empty table gives no rows (no root). Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conceptframe.llm.hotkeys import joined_to_groups
from conceptframe.llm.shared import kept, spread

NAME = "op13_prefix_trie"
_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: ascii((conv_id::VARCHAR)[i])::BIGINT)),
  lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM t),
r AS (SELECT conv_id, 1 AS part, pos, role, text FROM t JOIN c USING (conv_id) WHERE pos >= h
  UNION ALL SELECT c.conv_id, 0, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h),
p AS (SELECT conv_id, row_number() OVER w AS depth, sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER w) AS key, length(text) AS size FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
q AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, max(depth) OVER (PARTITION BY conv_id) = depth AS ended FROM p),
n AS (SELECT depth, key, any_value(parent) AS parent, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256 FROM q GROUP BY depth, key),
k AS (SELECT depth - 1 AS depth, parent AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, key)),
s AS (SELECT p.depth, p.key, count_if(m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.size)::BIGINT AS saved_tokens
  FROM m JOIN p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY ALL)
SELECT m.conv_id, m.depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN s USING (depth, key) LEFT JOIN m up ON up.depth = m.depth - 1 AND up.key = m.parent"""
HEADS, FAMILY = 6, 100
LEAST = 300  # different conversations below a prefix that one task always takes
AT_ONCE = 2000  # turns that a task gathers before it peels
RUN = 1 << 16  # ids in a packed run
ROOT = bytes(16)
NOBODY = hashlib.sha256(b"").hexdigest()
SUMS = "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, pos, digest, size of each turn, in the conversation's own order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    narrow = rows.filter("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), F.length(text).cast("bigint").alias("size"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return narrow.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "digest", "size")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id and the list of its turns: the first of the family's conversation, then its own later ones."""
    head = F.crc32(F.col("conv_id").cast("string")) % HEADS
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = turns.select("conv_id").distinct()
    own = turns.filter(F.col("pos") >= head).select("conv_id", F.lit(1).alias("part"), "pos", "digest", "size")
    heads = turns.filter((F.col("conv_id") == base) & (F.col("pos") < HEADS - 1)).select(F.col("conv_id").alias("base"), "pos", "digest", "size")
    first = convs.select("conv_id", base.alias("base"), head.alias("h")).join(heads, "base").filter("pos < h").select("conv_id", F.lit(0).alias("part"), "pos", "digest", "size")
    none = convs.select("conv_id", *[F.lit(None).cast(t).alias(n) for n, t in (("part", "int"), ("pos", "int"), ("digest", "binary"), ("size", "bigint"))])
    turn = F.when(F.col("part").isNotNull(), F.struct("part", "pos", "digest", "size"))
    listed = own.unionByName(first).unionByName(none).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return listed.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.size").alias("sizes"))


def chains(rows: DataFrame) -> DataFrame:
    """conv_id, depth, keys[0 .. depth] and sizes[0 .. depth] of each list of turns."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = [], []
            for digests, lengths in zip(batch.column("digests").to_pylist(), batch.column("sizes").to_pylist()):
                chain = [ROOT]
                for digest in digests:
                    chain.append(hashlib.blake2b(chain[-1] + digest, digest_size=16).digest())
                keys.append(chain)
                sizes.append([0, *lengths])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array([len(k) - 1 for k in keys], pa.int64()), pa.array(keys, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int64()))],
                ["conv_id", "depth", "keys", "sizes"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"conv_id {kind}, depth bigint, keys array<binary>, sizes array<bigint>")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) rows as packed runs (key, first id, number, ids as text)."""
    now, ids, out = None, [], []
    done = lambda: out.append((now, ids[0], len(ids), ",".join(map(str, ids))))
    send = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], ["key", "first", "n", "ids"])
    for batch in batches:
        for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (key != now or len(ids) == RUN):
                done()
                ids = []
            now = key
            ids.append(conv)
        if out:
            yield send()
            out = []
    if ids:
        done()
        yield send()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs as one row a key: smallest id, number and SHA-256 of all ids, hashed as they come."""
    now, first, n, state, out = None, None, 0, None, []
    send = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], ["conv_id", "n_convs", "ends"])
    for batch in batches:
        for key, low, many, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if key != now:
                if state:
                    out.append((first, n, state.hexdigest()))
                now, first, n, state = key, low, 0, hashlib.sha256()
            state.update((("," if n else "") + ids).encode())
            n += many
        if out:
            yield send()
            out = []
    if state:
        out.append((first, n, state.hexdigest()))
        yield send()


def ended(paths: DataFrame) -> DataFrame:
    """One row for each node where conversations end: its chain, smallest member, number and digest of members."""
    parts = spread(paths.sparkSession)
    ids = paths.select(F.element_at("keys", -1).alias("key"), "conv_id").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    runs = ids.mapInArrow(_runs, "key binary, first bigint, n bigint, ids string")
    firsts = runs.repartition(parts, "key").sortWithinPartitions("key", "first").mapInArrow(_digests, "conv_id bigint, n_convs bigint, ends string")
    return firsts.join(paths, "conv_id")


def with_home(items: DataFrame, least: int = LEAST) -> tuple[DataFrame, int]:
    """Items with `home`, the depth down to which one task peels them, and the greatest of these depths."""
    spark = items.sparkSession
    parts = 4 * spread(spark)
    limit = max(least, 1, items.count() // parts)
    left, cut, cuts = items.select("keys", "depth"), 1, []
    while True:
        key = F.get("keys", F.lit(cut))  # null beyond the end
        hot = [(bytearray(r[0]),) for r in left.filter(F.col("depth") >= cut).groupBy(key.alias("k")).agg(F.count("*").alias("s")).filter(F.col("s") > limit).collect()]
        if not hot:  # fewer than `parts` of them otherwise: together they hold at most all items
            break
        few = F.broadcast(spark.createDataFrame(hot, "hot binary"))
        cuts.append((cut, few))
        left = left.join(few, key == F.col("hot"), "left_semi")
        cut = cut + 1 if cut < 4 else 2 * cut
    out = items.withColumn("home", F.lit(None).cast("int"))
    for at, few in cuts:
        out = out.join(few, F.get("keys", F.lit(at)) == F.col("hot"), "left").withColumn(
            "home", F.coalesce("home", F.when(F.col("hot").isNull(), F.lit(at)))).drop("hot")
    return out.withColumn("home", F.least(F.coalesce("home", F.lit(cut)), "depth").cast("bigint")), cut


class Node:
    """A node while it is being merged; `kids` are finished rows that wait for its smallest member."""

    __slots__ = ("conv", "n", "kids", "leaves", "saved", "ends", "keys", "sizes", "home")

    def __init__(self, keys, sizes, home):
        self.conv, self.n, self.kids, self.leaves, self.saved, self.ends = None, 0, [], 0, 0, None
        self.keys, self.sizes, self.home = keys, sizes, home

    def join(self, conv: int, n: int) -> None:
        self.conv = conv if self.conv is None else min(conv, self.conv)
        self.n += n


def peeled(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Finished nodes below the homes of some items, and what is left at the homes, not yet finished.

    rows: (conv_id, n_convs, ends, depth, keys, sizes, home), with all items of a home together.
    """
    ends: dict[int, list[tuple]] = {}
    for row in rows:
        ends.setdefault(row[3], []).append(row)
    finished, tops, live, d = [], [], {}, max(ends)
    while live or ends:
        for conv, n, digest, _, keys, sizes, home in ends.pop(d, ()):
            node = live.get(keys[d])
            if node is None:
                node = live[keys[d]] = Node(keys, sizes, home)
            node.join(conv, n)
            node.ends = digest
        above: dict[bytes, Node] = {}
        for node in live.values():
            finished += [(conv, depth, node.conv, *rest) for conv, depth, *rest in node.kids]
            if d == node.home:
                tops.append((node.conv, d, node.n, len(node.kids), node.leaves, node.saved, node.ends, node.keys[:d + 1], node.sizes[:d + 1]))
                continue
            leaves, saved = max(node.leaves, 1), node.saved + (node.n - 1) * node.sizes[d]
            up = above.get(node.keys[d - 1])
            if up is None:
                up = above[node.keys[d - 1]] = Node(node.keys, node.sizes, node.home)
            up.join(node.conv, node.n)
            up.leaves += leaves
            up.saved += saved
            up.kids.append((node.conv, d, node.n, len(node.kids), leaves, saved, node.ends or NOBODY))
        live = above
        d = d - 1 if live else max(ends, default=0)
    return finished, tops


def peel_in_tasks(items: DataFrame) -> DataFrame:
    """Finished nodes (keys null) and unfinished ones at the homes (keys set)."""
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "keys", "sizes"]
    types = [*[pa.int64()] * 7, pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64())]

    def send(rows: list[tuple]) -> pa.RecordBatch:
        finished, tops = peeled(rows)
        whole = [(*r, None, None) for r in finished] + [(c, d, None, *rest) for c, d, *rest in tops]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*whole), types)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, size = [], None, 0
        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now and size > AT_ONCE:
                    yield send(held)
                    held, size = [], 0
                now = key
                held.append(tuple(row))
                size += row[3] + 1
        if held:
            yield send(held)

    keyed = items.select(F.get("keys", F.col("home").cast("int")).alias("key"), "conv_id", "n_convs", "ends", "depth", "keys", "sizes", "home")
    dealt = keyed.repartition(spread(items.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(work, "conv_id bigint, depth bigint, parent_conv_id bigint, " + SUMS + ", ends string, keys array<binary>, sizes array<bigint>")


def peel_level(rows: DataFrame, d: int) -> DataFrame:
    """Finished nodes of one depth from unfinished ones and stripped children."""
    grouped = rows.groupBy(F.get("keys", F.lit(d)).alias("key")).agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends").alias("ends"),
        F.first("keys").alias("keys"), F.first("sizes").alias("sizes"))
    own = (F.col("n_convs") - 1) * F.get("sizes", F.lit(d))
    return grouped.withColumns({"n_leaves": F.greatest("n_leaves", F.lit(1)), "saved_tokens": F.col("saved_tokens") + own, "depth": F.lit(d).cast("bigint"),
                                "ends": F.coalesce("ends", F.lit(NOBODY)), "up": _cut("keys", d - 1)})


def _cut(keys: str, d: int) -> Column:
    return F.get(keys, F.lit(d)) if d >= 0 else F.lit(None).cast("binary")


def stripped(nodes: DataFrame, d: int) -> DataFrame:
    """The nodes of a depth as unfinished parts of their parents."""
    return nodes.select("conv_id", "n_convs", F.lit(1).cast("bigint").alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends"),
                        F.slice("keys", 1, d).alias("keys"), F.slice("sizes", 1, d).alias("sizes"))


def prefix_trie(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    paths = kept(chains(rebuilt(turns_of(rows))), "chains")
    items, deepest = with_home(kept(ended(paths), "ended"), least)
    parts = kept(peel_in_tasks(items), "peeled")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    found = parts.filter("keys is null").select(*out)
    below = None
    for d in range(deepest, -1, -1):
        own = parts.filter((F.col("depth") == d) & F.col("keys").isNotNull()).select("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "keys", "sizes")
        nodes = kept(peel_level(own if below is None else own.unionByName(stripped(below, d + 1)), d), "level")
        if below is not None:
            parents = nodes.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_size"))
            found = found.unionByName(joined_to_groups(below, parents, "up", "_size").select(*out))
        below = nodes
    return found.unionByName(below.withColumn("parent_conv_id", F.lit(None).cast("bigint")).select(*out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
