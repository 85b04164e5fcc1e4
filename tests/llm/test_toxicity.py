import itertools
import zlib

import duckdb
import numpy as np
import pytest
from conftest import DATA, EDGES

from conceptframe.llm import toxicity
from conceptframe.llm.toxicity import DECAY, EDGE, PATTERNS, REACH, SLOTS, SYMBOLS, U64, kernel, mix, symbols_of


def plain_features(unit):
    symbols = symbols_of([unit])[0].tolist()
    out = {}
    for size in (3, 4):
        for places in itertools.combinations(range(len(symbols)), size):
            if (span := places[-1] - places[0]) < REACH:
                code = 0
                for p in places:
                    code = code * SYMBOLS + symbols[p]
                if size == 4:
                    code = int(mix(np.array([code], U64))[0] >> U64(44)) % (SLOTS - SYMBOLS ** 3) + SYMBOLS ** 3
                out[code] = out.get(code, 0) + DECAY ** (span + 1)
    return out


def test_kernel_is_its_definition():
    words = [b"idiot", b"idxiot", b"a", b"", b"aaaaaa", "é".encode()]
    got = kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            fa, fb = plain_features(a), plain_features(b)
            own = sum(v * fb.get(u, 0) for u, v in fa.items())
            size = [np.sqrt(max(sum(max(len(w) + 2 - p[-1], 0) * DECAY ** (2 * (p[-1] + 1)) for p in PATTERNS), DECAY ** 6)) for w in (a, b)]
            assert abs(got[i, j] - own / size[0] / size[1]) < 1e-4
    assert EDGE in symbols_of([b"x"])[0]
    assert got[0, 1] > 0.6


def test_folded_table_gives_the_landmarks_sum():
    marks, beta = [b"idiot", b"scum", b"then"], np.array([1.0, -0.5, 0.25])
    machine = toxicity.Machine(toxicity.folded_table(marks, beta), 0.1)
    units = [b"idxiot", b"sum", b"", b"another"]
    assert np.allclose(toxicity.linear([machine], units)[0], kernel(units, marks) @ beta + 0.1, atol=1e-4)


def test_words_sentences_and_joined_spans():
    text = "Réel scum-bag, m o r o n. A.b,c! on ly\nÉTÉ 12".encode()
    letters, bounds, row, head = toxicity.cut(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    words = [letters[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:])]
    assert words == ["réel", "scumbag", "m", "o", "r", "o", "n", "a", "b", "c", "on", "ly", "été", "12"]
    assert [w for w, h in zip(words, head) if h] == ["réel", "a", "on", "été"]
    first, last = toxicity.joined(bounds, head)
    assert [letters[bounds[a]:bounds[b]].tobytes().decode() for a, b in zip(first, last)] == ["moron", "abc", "only", "été12"]


def corpus():
    rng = np.random.default_rng(3)
    parts = ["an", "the", "re", "on", "ti", "es", "or", "ha", "in", "ly"]
    plain = lambda: "".join(rng.choice(parts, rng.integers(1, 4)))
    bad = ["moron", "stupid", "scumbag"]
    rows, labels = [], []
    for i in range(700):
        words = [plain() for _ in range(30)]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(2):
                words[rng.integers(30)] = bad[rng.integers(3)]
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    return rows, labels


def test_held_out_documents_and_disguises(spark, table):
    rows, labels = corpus()
    model = toxicity.train(table(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    more = [(10_001, "the anre scum-bag onti"), (10_002, "anre m o r o n onti"), (10_003, "s.t.u.p.i.d"), (10_004, None), (10_005, ""), (10_006, "the anre mordon onti")]
    out = {r.doc_id: r for r in toxicity.score(table(rows + more), model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out for i in held) and sum(r.held_out for r in out.values()) == len(held) + sum(zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in more)
    right = [out[i].predicted == labels[i][2] for i in held]
    assert np.mean(right) > 0.97
    assert [out[i].predicted for i in (10_001, 10_002, 10_003, 10_004, 10_005, 10_006)] == [1, 1, 1, 0, 0, 1]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())


def test_learns_from_nothing_held_out(spark, table):
    rows, labels = corpus()
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (toxicity.train(table(rows), spark.createDataFrame(x, "doc_id bigint, quality int, toxic int")) for x in (labels, turned))
    assert (a.alone.table == b.alone.table).all() and (a.weights == b.weights).all()


def test_edges(spark, table):
    kind = "doc_id bigint, quality int, toxic int"
    none = toxicity.train(table(EDGES), spark.createDataFrame([], kind))
    assert {r.score for r in toxicity.score(table(EDGES), none).collect()} == {0.0}
    one = toxicity.train(table(EDGES), spark.createDataFrame([(i, 0, 1) for i in range(12)] + [(None, 0, 0), (3, 0, None)], kind))
    out = toxicity.score(table(EDGES), one).collect()
    assert len(out) == len(EDGES) and {r.score for r in out} == {1.0}
    assert toxicity.score(table([]), one).count() == 0


def test_accepted_rows_keep_their_columns(spark, table):
    rows, labels = corpus()
    df = table(rows)
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    kept = toxicity.accepted(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in toxicity.score(df, model).collect() if not r.predicted}


def test_very_long_texts(spark, table):
    rows, labels = corpus()
    model = toxicity.train(table(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    long = "anre" * 90_000
    more = [(1, long), (2, long[:180_001] + "scumbagscumbag" + long), (3, "anre the " * 150_000), (4, "a " * 100_000)]
    out = {r.doc_id: r.predicted for r in toxicity.score(table(more, 1), model).collect()}
    assert out == {1: 0, 2: 1, 3: 0, 4: 0}


@pytest.fixture(scope="module")
def trained(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, toxicity.train(docs, labels)


def test_held_out_accuracy_of_the_given_labels(trained):
    docs, labels, model = trained
    held = docs.join(labels.filter("toxic is not null"), "doc_id").filter(toxicity.held_out("doc_id"))
    out = {r.doc_id: r.predicted for r in toxicity.score(held, model).collect()}
    rows = held.select("doc_id", "toxic").collect()
    caught = sum(out[r.doc_id] and r.toxic for r in rows)
    # five of the 97 toxic ones hold no insult at all; measured 0.928 and 0.947
    assert caught / sum(r.toxic for r in rows) >= 0.92 and caught / sum(out.values()) >= 0.93


def test_learned_insults_in_disguise(trained, spark, table):
    _, _, model = trained
    insults = ["trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron"]
    clean = [r[0].split(" ") for r in duckdb.sql("""SELECT text FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id)
      WHERE toxic = 0 AND lang = 'en' AND len(text) BETWEEN 200 AND 2000 AND doc_id % 7 = 3 ORDER BY doc_id LIMIT 12""").fetchall()]
    forms = {f"put in {c}": [w[:i] + c + w[i:] for w in insults for i in range(1, len(w))] for c in "x7e*"}
    forms["left out"] = [w[:i] + w[i + 1:] for w in insults for i in range(1, len(w) - 1)]
    forms["doubled"] = [w[:i] + w[i] + w[i:] for w in insults for i in range(len(w))]
    forms["two pieces"] = [w[:i] + " " + w[i:] for w in insults for i in range(2, len(w) - 1)]
    forms["spelled"] = [" ".join(w) for w in insults]
    forms["inside"] = ["theerin" + w + "onantly" for w in insults] + [f"the,an,{w},or" for w in insults]
    rows, kind = [], []
    for name, texts in forms.items():
        for n, x in enumerate(texts):
            words = clean[n % len(clean)]
            for text in (" ".join([*words[:len(words) // 2], x, *words[len(words) // 2:]]), f"an {x} er"):
                rows.append((len(rows), text))
                kind.append(name)
    out = {r.doc_id: r.predicted for r in toxicity.score(table(rows), model).collect()}
    for name in forms:
        own = [out[i] for i, k in enumerate(kind) if k == name]
        assert np.mean(own) >= 0.9, (name, np.mean(own))
    plain = toxicity.score(table([(n, " ".join(w)) for n, w in enumerate(clean)]), model)
    assert plain.filter("predicted = 1").count() == 0


def test_given_tables(spark):
    out = toxicity.query(spark, DATA)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert out.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
