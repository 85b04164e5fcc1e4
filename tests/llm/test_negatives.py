import math
import random

from parity import compare, duck

from conceptframe.llm import negatives
from conftest import DATA

KIND = "vec_id bigint, label int, embedding array<double>, score double, anchor string, window int"
LONG = (1 << 63) - 1


def brute(rows, every, scale=256):
    exact = lambda x: int(x) * scale if abs(x) >= 2.0 ** 53 else math.floor(x * scale)
    good = [(i, c, [exact(x) for x in v]) for i, c, v in rows if None not in (i, c, v) and all(x is not None and math.isfinite(x) for x in v)]
    held = lambda s: max(-LONG - 1, min(LONG, s))
    out = []
    for ai, al, av in good:
        if ai % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, c) for i, c, v in good)
        for ps, pi, _ in [r for r in scored if r[2] == al and r[1] != ai][:5]:
            fit = [r for r in scored if r[2] != al and 50 * -ps <= 100 * -r[0] <= 95 * -ps][:3]
            out += [(ai, pi, n + 1, i, held(-ps), held(-s)) for n, (s, i, _) in enumerate(fit)]
    return sorted(out)


def run(spark, rows, every=5, **options):
    df = spark.createDataFrame([(*r, 1.0, "a", 2) for r in rows], KIND).repartition(3)
    return sorted(map(tuple, negatives.mined(df, f"vec_id % {every} = 0", **options).collect()))


def vectors(seed, n, width, labels=3):
    rng = random.Random(seed)
    return [(i, rng.randrange(labels), [rng.randint(-40, 90) / 64 for _ in range(width)]) for i in range(n)]


def test_random_vectors_with_ties(spark):
    rows = vectors(1, 300, 12)
    rows += [(300 + i, i % 3, rows[5][2]) for i in range(60)]
    got = run(spark, rows)
    assert got == brute(rows, 5) and len(got) > 300


def test_blocks_of_anchors_and_of_candidates(spark, monkeypatch):
    rows = vectors(2, 240, 6)
    assert run(spark, rows, most=300) == brute(rows, 5)


def test_the_algorithm_stops_before_all_rows_are_seen():
    import numpy as np
    rng = np.random.default_rng(5)
    values = np.floor(rng.normal(0, 20, (4000, 3)))
    values[7] = (400, -400, 400)
    lists = negatives.Lists(np.arange(4000), np.zeros(4000, int), values)
    seen = 0
    for fresh, limit in lists.accessed(np.array([3.0, -2.0, 1.0])):
        seen += len(fresh)
        if limit < 2400:
            break
    assert seen < 200


def test_edges(spark):
    v = [1.0, 2.0]
    rows = [(0, 1, v), (0, 1, v), (1, 1, [1.0, 1.0]), (2, None, v), (3, 2, None), (4, 2, [None, 1.0]), (5, 2, [float("nan"), 1.0]), (6, 2, [float("inf"), 0.0]),
            (None, 2, v), (7, 2, []), (8, 2, [1.2]), (9, 1, [0.0, 0.0]), (10, 1, [0.0]), (11, 2, [0.5, 0.9]), (11, 2, [0.5, 0.9]), (12, 1, [0.7, 0.8, 0.9])]
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, []) == [] and run(spark, [(0, 1, v)]) == [] and run(spark, [(1, 1, v)]) == []


def test_scores_beyond_doubles_and_longs(spark):
    rng = random.Random(3)
    rows = [(i, i % 2, [rng.uniform(-1, 3) * 10.0 ** rng.choice([0, 6, 12]) for _ in range(4)]) for i in range(60)]
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, [(0, 0, [1e300]), (1, 0, [1e300]), (2, 1, [7e299])])[0][:4] == (0, 1, 1, 2)


def test_equals_its_sql(spark):
    assert compare(spark, duck(DATA), DATA, negatives.query, negatives.SQL)[0].startswith("ok")
