import random
import re

from conftest import EDGES

from conceptframe.llm import jaccard
from conceptframe.llm.links import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text):
    w = WORD.findall((text or "").encode().translate(LOW))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[k:k + 5]) for k in range(len(w) - 4)))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((str(doc), len(sets[i]), str(min(own) if sets[i] and own else doc)))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.jaccard_join(df).collect())


def near_rows(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 6, 12, 40, 90]))] for _ in range(8)]
    shared = [rng.choice(words) for _ in range(30)]
    rows = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            text[rng.randrange(len(text))] = rng.choice(words)
        if rng.random() < 0.3:
            text = [rng.choice(words) for _ in range(25)] + shared
        rows.append((rng.randrange(10 ** 6), " ".join(text)))
    return rows


def test_components_are_those_of_brute_force(table):
    for seed in (1, 2):
        rows = near_rows(seed)
        assert found(table(rows)) == brute(rows)


def test_edges(table):
    assert found(table(EDGES)) == brute(EDGES)


def test_small_groups_and_long_lists(table, monkeypatch):
    """The ways for lists and groups beyond the limits give the same components."""
    rows = near_rows(5)
    monkeypatch.setattr(jaccard, "MEMBERS", 7)
    monkeypatch.setattr(jaccard, "LONG", 4)
    assert found(table(rows)) == brute(rows)


def test_one_document_of_a_group_stays(table):
    rows = [(5, "a b c d e f g"), (3, "A b c d e f g"), (9, None), (8, ""), (7, "other words are in this one here")]
    kept = jaccard.without_near_copies(table(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 8, 9]
    assert kept.columns == table(rows).columns


def test_no_rows(table):
    assert jaccard.jaccard_join(table([])).count() == 0
    assert jaccard.jaccard_join(table([(1, None), (2, " ")])).count() == 2


def test_chains_and_stars_become_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, None), (300, 300)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert roots == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 140)}}


def test_rows_of_a_repeated_id_are_decided_by_their_texts(table):
    copy, own, more = "a b c d e f g", "quite another text of words here", "third kind of words in this row"
    rows = [(1, copy), (2, copy), (2, own), (3, more), (3, more), (4, more), (5, ""), (5, ""), (None, copy), (6, own), (7, "u v w x y z"), (7, "h i j k l m")]
    df = table(rows)
    out = jaccard.without_near_copies(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted([
        ("1", copy), ("2", own), ("3", more), ("5", ""), ("5", ""), ("None", copy), ("7", "u v w x y z"), ("7", "h i j k l m")])
