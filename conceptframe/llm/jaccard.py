"""Exact n-gram Jaccard join by a token-group matrix.

Documents become sets of word-shingle hashes; equal sets are one class. Classes that share a minimum
under one of a few hash orders form a group (no decision rests on that: a group only says what is
looked at together; large ones are split into groups of at most `MEMBERS`). The matrix stores, for
every token of its members' prefixes, the groups whose union holds it. 0.8 of a set must be shared
by a link, so the first tokens of two linked sets, a fifth and k more of each, share at least k
(k is a fiftieth of the set and one). A class and a group therefore come together only if that many
of the class's tokens are in the group's part of the matrix, from members of a fitting size. Only
then the group is opened: first the overlap of each class with the union of the other group must
reach 0.8 of its size, then set meets set.

Tokens are ordered by hash, but those of very many documents come last, so that a passage that
thousands of documents share is in hardly any prefix. Counts for that order are taken over all
documents; the order changes the work, never the result.

Inside an opened group a class that is already linked is not compared again with the classes linked
to it, so a group of near copies costs about one comparison for each member. Links leave the tasks
as stars and meet in connected components.

Nulls and empties: no text or no words give an empty set, linked with nothing and its own
component. Fewer than `WORDS` words: the whole sequence is the one shingle. Null ids join a
component through their text but never name it. Repeated rows stay. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptframe.llm.buffers import LOWER, SPACES, U64, blocks, mix, range_hashes, ranges, row_numbers, spans
from conceptframe.llm.idfilter import possible, without
from conceptframe.llm.links import components
from conceptframe.llm.shared import documents, kept, spread

NAME = "op2_jaccard_join"
WORDS, PERCENT = 5, 80
ORDERS = 8  # taken two by two, so that a group's members mostly are near copies
MEMBERS = 1000
LONG = 512  # classes under one token; longer lists are opened as a whole
POSTINGS = 2_000_000  # in a bucket of the matrix
COMMON = 12
COMMON_MOST = 500_000  # tokens that the order puts last
_FACTORS = mix(np.arange(11, 11 + 64, dtype=U64)) | U64(1)

SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, r, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')))) END AS g FROM d),
classes AS (SELECT min(r) AS c, g, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
tokens AS (SELECT c, n, unnest(g) AS t FROM classes),
pairs AS (SELECT a.c AS x, b.c AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.c < b.c
  AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
reach AS (SELECT x, y FROM (WITH RECURSIVE walk(x, y) AS (SELECT c, c FROM classes UNION SELECT walk.x, e.y FROM walk JOIN edges e ON e.x = walk.y)
  SELECT x, y FROM walk)),
named AS (SELECT c, min(doc_id) AS own FROM s JOIN classes USING (g) GROUP BY c),
comp AS (SELECT x AS c, min(own) AS component_id FROM reach JOIN named ON named.c = y GROUP BY x)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE component_id END AS component_id
FROM s LEFT JOIN classes USING (g) LEFT JOIN comp USING (c)"""


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and the rows' bounds."""
    low = LOWER[data]
    starts, ends, firsts = spans(low, offsets, SPACES)
    hashes = range_hashes(low, starts, ends)
    count = np.diff(firsts)
    row = row_numbers(firsts)
    here = np.arange(len(hashes)) - firsts[row] if len(hashes) else np.zeros(0, np.int64)
    size = np.minimum(count, words)[row]
    whole = np.flatnonzero(here + size <= count[row])
    token = np.zeros(len(whole), U64)
    for j in range(words):
        there = whole[size[whole] > j]
        token[size[whole] > j] += hashes[there + j] * _FACTORS[j]
    token = mix(token + size[whole].astype(U64))
    of = row[whole]
    order = np.lexsort((token, of))
    token, of = token[order], of[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (of[1:] != of[:-1])
    token, of = token[new], of[new]
    return token, np.searchsorted(of, np.arange(len(offsets)))


def signatures(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits of each set that don't depend on order; two columns."""
    out = np.zeros((len(bounds) - 1, 2), U64)
    for k in range(2):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(tokens + _FACTORS[20 + k]))])
        out[:, k] = mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(U64))
    return out


def shared_at_least(size):
    """k: so many tokens more than needed for one in common are in a prefix."""
    return 1 + size // 50


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def common_tokens(docs: DataFrame, words: int) -> np.ndarray:
    """Hashes of the tokens that most documents have, rarest first; counted over all documents.

    A task reports the tokens that it has found in two distinct sets or more; those with `COMMON` and
    more in sum are common, and the `COMMON_MOST` most frequent of them go to the driver.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def report() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held) if held else np.zeros(0, U64), return_counts=True)
            many = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(counts[many])], ["token", "n"])

        for _, data, offsets in blocks(batches):
            tokens, bounds = shingle_sets(data, offsets, words)
            sign = signatures(tokens, bounds)
            for i, s in enumerate(sign[:, 0].tolist()):
                if s not in seen:
                    seen.add(s)
                    held.append(tokens[bounds[i]:bounds[i + 1]])
                    size += len(held[-1])
            if size > 4_000_000:
                yield report()
                held, size, seen = [], 0, set()
        yield report()

    rows = docs.mapInArrow(work, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
    found = rows.orderBy(F.desc("n"), "token").limit(COMMON_MOST).toPandas()
    return found.token.to_numpy(np.int64).view(U64)[::-1].copy()


def described(docs: DataFrame, common: np.ndarray, words: int, percent: int) -> DataFrame:
    """Per row: id, set size, signature, minima under several orders, prefix tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(common)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = sent.value
        by = np.argsort(late)
        late_sorted = late[by]
        for batch, data, offsets in blocks(batches):
            tokens, bounds = shingle_sets(data, offsets, words)
            size = np.diff(bounds)
            full = np.flatnonzero(size)
            minima = np.zeros((len(size), ORDERS // 2), U64)
            for k in range(ORDERS if len(full) else 0):
                low = np.minimum.reduceat(mix(tokens ^ _FACTORS[30 + k]), bounds[:-1][full])
                minima[full, k // 2] = mix(minima[full, k // 2] + low)
            key = tokens >> U64(1)
            if len(late):
                at = np.minimum(np.searchsorted(late_sorted, tokens), len(late) - 1)
                hit = late_sorted[at] == tokens
                key[hit] = U64(1 << 63) + by[at[hit]].astype(U64)
            need = np.minimum(size - (percent * size + 99) // 100 + shared_at_least(size), size)
            need[size == 0] = 0
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((key, row))
            prefix = tokens[order][ranges(bounds[:-1], need)]
            cut = np.concatenate([[0], np.cumsum(need)])
            sign = signatures(tokens, bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), _binary([s.tobytes() for s in sign]),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * (ORDERS // 2), pa.int32()), pa.array(minima.reshape(-1).view(np.int64))),
                 _binary([prefix[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())])],
                ["doc_id", "n", "sig", "minima", "prefix"])

    return docs.mapInArrow(work, f"doc_id {kind}, n bigint, sig binary, minima array<bigint>, prefix binary")


def grouped(described_rows: DataFrame) -> DataFrame:
    """One row for each class: sid, sig, rep (smallest id), n and gid (its group)."""
    classes = kept(described_rows.filter("n > 0").groupBy("sig").agg(
        F.min("doc_id").alias("rep"), F.first("minima").alias("minima"), F.first("n").alias("n")
    ).withColumn("sid", F.monotonically_increasing_id()), "classes")
    cells = classes.select("sid", F.posexplode("minima").alias("k", "low"))
    shared = cells.groupBy("k", "low").agg(F.count("*").alias("c"), F.min("sid").alias("hub")).filter("c > 1")
    best = cells.join(shared, ["k", "low"]).groupBy("sid").agg(F.max(F.struct("c", (-F.col("hub")).alias("hub"))).alias("best"))
    joined = classes.join(best, "sid", "left").select(
        "sid", "sig", "rep", "n", F.coalesce(-F.col("best.hub"), "sid").alias("hub"))
    sizes = joined.groupBy("hub").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"), F.count("*").alias("members"))
    return kept(joined.join(sizes, "hub").select(
        "sid", "sig", "rep", "n", "members",
        F.when(F.col("members") == 1, F.col("sid")).otherwise(F.xxhash64("hub", F.pmod(F.xxhash64("sid"), "parts"))).alias("gid")), "groups")


def meetings(described_rows: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(lo, hi, sid): which classes are looked at when the groups lo and hi are held together."""
    spark = groups.sparkSession
    total = described_rows.agg(F.sum(F.length("prefix"))).first()[0] or 0
    buckets = spread(spark, -(-total // 8 // POSTINGS))
    rows = described_rows.filter("n > 0").select("doc_id", "sig", "prefix").join(
        groups.select("sig", "sid", "gid", "rep", "n"), "sig").filter(F.col("doc_id").eqNullSafe(F.col("rep"))).select("sid", "gid", "n", "prefix")

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        pack = zstandard.ZstdCompressor(1)

        def flush() -> pa.RecordBatch:
            token, sid, gid, n = (np.concatenate(c) for c in zip(*held))
            bucket = ((token >> U64(20)) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            token, sid, gid, n, bucket = token[order], sid[order], gid[order], n[order], bucket[order]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cut))
            own = [_packed(pack, token[a:b], sid[a:b], gid[a:b], n[a:b]) for a, b in zip(cut[some].tolist(), cut[some + 1].tolist())]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), _binary(own)], ["bucket", "part"])

        for batch in batches:
            if not batch.num_rows:
                continue
            prefix = batch.column("prefix")
            lengths = np.array([len(p) >> 3 for p in prefix.to_pylist()])
            token = np.frombuffer(b"".join(prefix.to_pylist()), U64)
            held.append((token, *[np.repeat(batch.column(c).to_numpy(), lengths) for c in ("sid", "gid", "n")]))
            size += len(token)
            if size > POSTINGS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _runs(batches, "bucket", "part"):
            columns = [np.concatenate(c) for c in zip(*[_unpacked(p) for p in parts])]
            for lists, found in enumerate(_met(*columns, percent)):
                yield pa.RecordBatch.from_arrays([*map(pa.array, found), pa.array(np.full(len(found[0]), lists, np.int32))], ["x", "y", "sid", "c", "lists"])

    parts = rows.mapInArrow(scatter, "bucket int, part binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = parts.mapInArrow(gather, "x bigint, y bigint, sid bigint, c bigint, lists int")
    # x: the class's own group, y: the other one, c: its tokens there, from one bucket
    counted = found.filter("lists <> 1").groupBy("sid", "x", "y", "lists").agg(F.sum("c").alias("c")).join(groups.select("sid", "n"), "sid")
    least = F.floor((percent * F.col("n") + 99) / 100)
    sides = F.when(F.col("lists") == 2, F.array("x", "y")).otherwise(F.array("sid"))
    near = counted.filter(F.col("c") >= shared_at_least_sql(least)).select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), F.explode(sides).alias("sid"))
    whole = found.filter("lists = 1").select(F.col("x").alias("lo"), F.col("y").alias("hi"), "sid").distinct()
    own = groups.filter("members > 1").select(F.col("gid").alias("lo"), F.col("gid").alias("hi"), "sid")
    return near.unionByName(whole).unionByName(own)


def shared_at_least_sql(size):
    return 1 + F.floor(size / 50)


def _packed(pack, token: np.ndarray, sid: np.ndarray, gid: np.ndarray, size: np.ndarray) -> bytes:
    steps = pack.compress(np.diff(sid, prepend=0).tobytes())
    sizes = pack.compress(size.astype("<i8").tobytes())
    other = np.flatnonzero(gid != sid)
    return b"".join([np.array([len(token), len(steps), len(sizes), len(other)], "<i8").tobytes(), token.tobytes(), steps, sizes,
                     other.astype("<i4").tobytes(), gid[other].astype("<i8").tobytes()])


def _unpacked(part: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, steps, sizes, others = np.frombuffer(part, "<i8", 4).tolist()
    unpack = zstandard.ZstdDecompressor()
    token = np.frombuffer(part, U64, n, 32)
    at = 32 + 8 * n
    sid = np.cumsum(np.frombuffer(unpack.decompress(part[at:at + steps]), "<i8"))
    at += steps
    size = np.frombuffer(unpack.decompress(part[at:at + sizes]), "<i8")
    at += sizes
    gid = sid.copy()
    gid[np.frombuffer(part, "<i4", others, at)] = np.frombuffer(part, "<i8", others, at + 4 * others)
    return token, sid, gid, size


def _runs(batches: Iterator[pa.RecordBatch], key: str, value: str) -> Iterator[list[bytes]]:
    """Values of neighbouring rows with the same key, as one list; rows come sorted by key."""
    last, held = None, []
    for batch in batches:
        for k, v in zip(batch.column(key).to_pylist(), batch.column(value)):
            if held and k != last:
                yield held
                held = []
            last = k
            held.append(v.as_py())
    if held:
        yield held


def _met(token: np.ndarray, sid: np.ndarray, gid: np.ndarray, size: np.ndarray, percent: int) -> tuple[tuple, tuple, tuple]:
    """Meetings from one bucket of the matrix: (own group, other group, class, tokens shared), the classes
    of lists too long for that: (list, part, class, 0), and the former once for two groups of one class."""
    order = np.argsort(token, kind="stable")
    t = token[order]
    same = np.zeros(len(t), bool)
    same[1:] = t[1:] == t[:-1]
    same[:-1] |= same[1:]
    order = order[same]  # tokens of one class alone meet nobody
    order = order[np.lexsort((sid[order], size[order], token[order]))]
    token, sid, gid, size = token[order], sid[order], gid[order], size[order]
    first = np.ones(len(token), bool)
    first[1:] = token[1:] != token[:-1]
    heads = np.flatnonzero(first)
    counts = np.diff(np.append(heads, len(token)))
    long = np.repeat(counts > LONG, counts)
    number = np.cumsum(first) - 1
    alone = gid == sid  # groups of one class: a row for the pair stands for both sides
    mine, other, who, by, pairs = [], [], [], [], []
    live, step = np.flatnonzero(~long), 1
    while len(live):  # the next class of a list, then the one after it, while sizes fit
        live = live[live + step < len(token)]
        there = live + step
        live = live[(number[there] == number[live]) & (100 * size[live] >= percent * size[there])]
        there = live + step
        differ = gid[live] != gid[there]
        for a, b in ((live[differ], there[differ]), (there[differ], live[differ])):
            both = alone[a] & alone[b]
            needed = ~both | (sid[a] < sid[b])
            a, b = a[needed], b[needed]
            pairs.append(both[needed])
            mine.append(gid[a])
            other.append(gid[b])
            who.append(sid[a])
            by.append(number[a])
        step += 1
    none = np.zeros(0, np.int64)
    near = two = (none, none, none, none)
    if sum(map(len, who)):
        who, other, by, mine, pairs = (np.concatenate(c) for c in (who, other, by, mine, pairs))
        order = np.lexsort((by, other, who))
        who, other, by, mine, pairs = who[order], other[order], by[order], mine[order], pairs[order]
        pair = np.ones(len(who), bool)
        pair[1:] = (who[1:] != who[:-1]) | (other[1:] != other[:-1])
        fresh = pair.copy()
        fresh[1:] |= by[1:] != by[:-1]
        at = np.flatnonzero(pair)
        shared = np.add.reduceat(fresh.astype(np.int64), at)
        near, two = (tuple(c[keep] for c in (mine[at], other[at], who[at], shared)) for keep in (~pairs[at], pairs[at]))
    lists, parts, members, seen = [], [], [], set()
    for h, n in zip(heads[counts > LONG].tolist(), counts[counts > LONG].tolist()):
        own = np.unique(sid[h:h + n])
        if len(np.unique(gid[h:h + n])) < 2:
            continue
        name = int(np.bitwise_xor.reduce(mix(own.astype(U64) + U64(7))) >> U64(1))
        if name in seen:
            continue
        seen.add(name)
        chunks = np.array_split(own, -(-len(own) // MEMBERS))
        for i, a in enumerate(chunks):
            for j in range(i, len(chunks)) if len(chunks) == 1 else range(i + 1, len(chunks)):
                both = a if i == j else np.concatenate([a, chunks[j]])
                members.append(both)
                lists.append(np.full(len(both), name, np.int64))
                parts.append(np.full(len(both), -1 - (i * len(chunks) + j), np.int64))
    if not members:
        return near, (none, none, none, none), two
    who = np.concatenate(members)
    return near, (np.concatenate(lists), np.concatenate(parts), who, np.zeros(len(who), np.int64)), two


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component (number of its first set) of each set, by breadth-first search over real links.

    Overlaps come from the postings of the sets at hand; a set found linked is taken out, so later
    searches do not meet it again.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    posting_owner = owner[order]
    starts = np.searchsorted(token[order], np.arange(int(token.max()) + 2))
    lengths = np.diff(starts)
    at = np.concatenate([[0], np.cumsum(sizes)])
    root = np.full(n, -1)
    free = n
    for i in range(n):
        if root[i] >= 0:
            continue
        root[i] = i
        free -= 1
        front = [i]
        while front and free:
            f = front.pop()
            own = token[at[f]:at[f + 1]]
            own = own[lengths[own] > 1]
            overlap = np.bincount(posting_owner[ranges(starts[own], lengths[own])], minlength=n)
            near = np.flatnonzero((100 * overlap >= percent * (sizes + sizes[f] - overlap)) & (root < 0))
            root[near] = i
            free -= len(near)
            front += near.tolist()
    return root


def _within_bound(sets: list[np.ndarray], side: np.ndarray, percent: int) -> np.ndarray:
    """Which sets share enough with the union of the other group to open it at all."""
    keep = np.ones(len(sets), bool)
    for own in (False, True):
        mine, other = np.flatnonzero(side == own), np.flatnonzero(side != own)
        if not len(mine) or not len(other):
            return np.zeros(len(sets), bool)
        union = np.unique(np.concatenate([sets[i] for i in other]))
        tokens = np.concatenate([sets[i] for i in mine])
        inside = union[np.minimum(np.searchsorted(union, tokens), len(union) - 1)] == tokens
        size = np.array([len(sets[i]) for i in mine])
        share = np.add.reduceat(inside.astype(np.int64), np.cumsum(size) - size)
        keep[mine[100 * share < percent * size]] = False
    return keep


def opened(docs: DataFrame, groups: DataFrame, met: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between classes, as stars, from all groups that had to be opened."""
    asked = kept(met.join(groups.select("sid", "sig", "rep", "gid"), "sid"), "asked")
    held = docs.select(F.col("doc_id").alias("_id"), "text")
    can = possible(kept(asked.select("rep").distinct(), "asked_ids"), "rep")
    held = held if can is None else held.filter(can(F.col("_id")))
    texts = asked.join(held, F.col("rep").eqNullSafe(F.col("_id"))).select("lo", "hi", "sid", "gid", "sig", "text")
    parts = spread(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}

        def links() -> pa.RecordBatch | None:
            keep = np.ones(len(held), bool)
            sids, sets = np.array(list(held)), [s for s, _ in held.values()]
            sides = np.array([g == last[0] for _, g in held.values()])
            if len(sets) > 1 and last[0] != last[1] and sides.any() and not sides.all():
                keep = _within_bound(sets, sides, percent)
            sids, sets = sids[keep], [s for s, k in zip(sets, keep) if k]
            if len(sets) < 2:
                return None
            root = linked(sets, percent)
            out = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(sids[root[out]]), pa.array(sids[out])], ["a", "b"])

        for batch, data, offsets in blocks(batches):
            tokens, bounds = shingle_sets(data, offsets, words)
            sign = signatures(tokens, bounds)
            columns = [batch.column(c).to_pylist() for c in ("lo", "hi", "sid", "gid", "sig")]
            for i, (lo, hi, sid, gid, sig) in enumerate(zip(*columns)):
                if sign[i].tobytes() != sig:
                    continue  # another text under the same id
                if (lo, hi) != last:
                    if held and (found := links()) is not None:
                        yield found
                    last, held = (lo, hi), {}
                held[sid] = tokens[bounds[i]:bounds[i + 1]], gid
        if held and (found := links()) is not None:
            yield found

    return texts.repartition(parts, "lo", "hi").sortWithinPartitions("lo", "hi").mapInArrow(work, "a bigint, b bigint")


def _joined(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, sig, component, class_id and root (the component's own number; null for empty sets)."""
    rows = kept(described(docs, common_tokens(docs, words), words, percent), "sets")
    groups = grouped(rows)
    links = kept(opened(docs, groups, meetings(rows, groups, percent), words, percent), "stars")
    roots = components(links)
    named = groups.select("sid", "sig", "rep").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn(
        "root", F.coalesce("root", "sid"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component"))
    classes = named.join(smallest, "root").select("sig", "component", F.col("sid").alias("class_id"), "root")
    return rows.select("doc_id", "n", "sig").join(classes, "sig", "left")


def _narrow(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), class_id for each row."""
    out = _joined(_narrow(docs, id_column, text_column), words, percent)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), "class_id")


def without_near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component stays (the smallest id, one of its rows); null ids and empty
    texts all stay. Rows of a repeated id are told apart by their texts."""
    columns = docs.columns
    found = kept(_joined(_narrow(docs, "doc_id", "text"), words, percent).select("doc_id", "sig", "component", "root"), "joined")
    gone = kept(found.filter("component != doc_id").select("doc_id").distinct(), "gone")
    repeated = kept(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return without(docs, "doc_id", gone)
    single = without(docs, "doc_id", kept(gone.union(repeated).distinct(), "gone"))
    # rows of repeated ids get a number of their own, and by it the set of their text and its component
    names = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    own = docs.join(repeated, "doc_id", "left_semi").select(*names, F.monotonically_increasing_id().alias("_row"))
    own = kept(own, "repeated_rows")
    id_, text = (f"c{columns.index(c)}" for c in ("doc_id", "text"))
    plain = own.select(F.col("_row").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sets = described(plain, common_tokens(plain, words), words, percent).select(F.col("doc_id").alias("_row"), "n", "sig")
    classes = found.filter("root is not null").join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("_doc"), "sig", "component", "root").distinct()
    placed = kept(own.select("_row", F.col(id_).alias("_doc")).join(sets, "_row").join(classes, ["_doc", "sig"], "left").select("_row", "_doc", "n", "component", "root"), "placed")
    first = placed.filter("n > 0 and component = _doc").groupBy("root").agg(F.min("_row").alias("_row")).select("_row")
    stay = first.union(placed.filter("n = 0").select("_row"))
    return single.unionByName(own.join(stay, "_row", "left_semi").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir)).drop("class_id")
