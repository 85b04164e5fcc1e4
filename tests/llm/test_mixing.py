import math
from collections import Counter

from conftest import EDGES

from conceptframe.llm import mixing


def rows_of(sizes):
    return [(1000 * s + i, " ".join(["w"] * (1 + (7 * i) % 13)), f"s{s}") for s, n in enumerate(sizes) for i in range(n)]


def shares(rows, copies):
    tokens = Counter()
    for i, t, s in rows:
        tokens[s] += (1 + len((t or "").split())) * copies.get(i, 0)
    total = sum(tokens.values())
    return {s: n / total for s, n in tokens.items()}, total


def entropy(weights):
    return -sum(w * math.log(w) for w in weights.values() if w)


def test_weights_reach_the_target_within_the_budget(table):
    rows = rows_of([600, 120, 60, 30])
    for target, most in ((0.9, 100.0), (0.98, 100.0), (0.98, 2.0)):
        copies = {r.doc_id: r.copies for r in mixing.temperature_mix(table(rows), target=target, most_repeats=most).collect()}
        weights, total = shares(rows, copies)
        _, all_ = shares(rows, {r[0]: 1 for r in rows})
        assert total <= all_ and total > 0.97 * all_
        assert max(copies.values()) <= math.ceil(most)
        if most == 100:
            assert abs(entropy(weights) / math.log(4) - target) < 0.02
        for s in weights:  # copies inside a source differ by one at most
            own = [copies.get(i, 0) for i, _, x in rows if x == s]
            assert max(own) - min(own) <= 1


def test_even_sources_stay_as_they_are(table):
    rows = rows_of([50, 50])
    assert {r.copies for r in mixing.temperature_mix(table(rows)).collect()} == {1}


def test_budget(table):
    rows = rows_of([100, 100])
    copies = {r.doc_id: r.copies for r in mixing.temperature_mix(table(rows), budget=300).collect()}
    assert 200 < shares(rows, copies)[1] <= 300


def test_same_mix_from_another_layout(table):
    rows = rows_of([300, 40, 9])
    a, b = (sorted(map(tuple, mixing.temperature_mix(table(rows, p)).collect())) for p in (1, 6))
    assert a == b


def test_edges(table):
    rows = [(i, t, None if k % 3 == 0 else "s" if k % 3 == 1 else "") for k, (i, t) in enumerate(EDGES)]
    df = table(rows)
    out = mixing.mixed(df, target=0.5)
    assert out.columns == df.columns and out.count() > 0
    assert mixing.temperature_mix(table([])).count() == 0 and mixing.mixed(table([])).count() == 0
    # repeated rows come and go together
    twice = mixing.mixed(table([(1, "a b", "s"), (1, "a b", "s"), (2, "c", "s")])).collect()
    assert Counter(r.doc_id for r in twice) == {1: 2, 2: 1}
