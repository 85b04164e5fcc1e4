import hashlib
import random
import zlib

import pytest
from parity import compare, duck

from conceptframe.llm import prefixtrie
from conftest import DATA

KIND = "conv_id bigint, turn bigint, role string, text string, depth int, keys string, n_convs double"


def brute(rows):
    turn_digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, turn_digest(role or "", text or ""), role or "", text or ""))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(convs.get(c - c % 100, [])[:h] + own[h:])
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    out = []
    for seq, members in nodes.items():
        under = [s for s in nodes if s[:len(seq)] == seq]
        kids = [s for s in under if len(s) == len(seq) + 1]
        leaves = [s for s in under if not any(o != s and o[:len(s)] == s for o in under)]
        saved = sum((len(nodes[s]) - 1) * (len(s[-1][1]) if s else 0) for s in under)
        ends = ",".join(map(str, sorted(c for c in members if built[c] == seq)))
        out.append((min(members), len(seq), min(nodes[seq[:-1]]) if seq else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "k", 2.0) for r in rows], KIND).repartition(3)
    return sorted(map(tuple, prefixtrie.prefix_trie(df, **options).collect()), key=str)


def made(seed, convs, words):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        number = 3 * c if c % 5 else c
        rows += [(number, t, rng.choice(["user", "assistant", None]), rng.choice(words)) for t in range(rng.randint(1, 9))]
    return rows


@pytest.mark.parametrize("least", [4, 300])
def test_random_conversations(spark, least):
    rows = made(1, 150, ["a", "bé", "", None])
    assert run(spark, rows, least=least) == brute(rows)


def test_hot_first_turns_and_copies_are_cut_deeper(spark):
    rows = []
    for c in range(240):  # two thirds begin alike, half of these are copies
        same = c % 3 != 0
        rows += [(c * 7, 0, "user", "hello" if same else f"own {c}"), (c * 7, 1, "assistant", "hi" if same else "x"), (c * 7, 2, "user", "bye" if c % 2 else f"q {c}"),
                 (c * 7, 3, "assistant", "end"), (c * 7, 4, "user", "end"), (c * 7, 5, "user", f"z {c % 4}")]
    assert run(spark, rows, least=5) == brute(rows)


def test_edges(spark):
    rows = [(None, 0, "user", "lost"), (100, 0, "user", "a"), (100, 0, "user", "a"), (100, None, "user", "first"), (101, 5, None, None), (101, 2, "user", "b"), (-5, 0, "user", "minus"),
            (-5, 1, "user", "one"), (9_000_000_017, 0, "user", "far"), (305, 0, "user", "no base")]
    assert run(spark, rows, least=2) == brute(rows)
    assert run(spark, [(7, 0, "user", "alone")]) == brute([(7, 0, "user", "alone")])
    assert run(spark, []) == [] and run(spark, [(None, 1, "user", "x")]) == []


def test_deep_conversation_and_very_long_text(spark):
    rows = [(200, t, "user", "t") for t in range(3000)] + [(201, t, "user", "t") for t in range(40)] + [(202, 0, "user", "w" * 20_000_000)]
    out = run(spark, rows)
    assert len(out) == 1 + 3000 + (1 if zlib.crc32(b"202") % 6 == 0 else 0)
    assert max(r[1] for r in out) == 3000


def test_packed_runs_of_ids(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "RUN", 3)
    ids = list(range(40))
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([b"k"] * 40), pa.array(ids)], ["key", "conv_id"])
    runs = list(prefixtrie._runs(iter([batch])))
    out = pa.Table.from_batches(list(prefixtrie._digests(iter(runs)))).to_pylist()
    assert out == [{"conv_id": 0, "n_convs": 40, "ends": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()}]


def test_equals_its_sql(spark):
    assert compare(spark, duck(DATA), DATA, prefixtrie.query, prefixtrie.SQL)[0].startswith("ok")
