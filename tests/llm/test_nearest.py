import math
import random

from conceptframe.llm import nearest

KIND = "vec_id bigint, embedding array<float>, score double, rank string, query_id int"


def brute(rows, queries, k):
    """Exact Python integers; a score beyond a long is the nearest long."""
    held = lambda s: min(max(s, -2**63), 2**63 - 1)
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in queries:
        for qi, qv in (r for r in good if r[0] == q):
            score = sorted(((-held(sum(a * b for a, b in zip(qv, v))), i) for i, v in good if i != qi))[:k]
            out += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(score)]
    return sorted(out)


def run(spark, rows, queries, k=10, **options):
    df = spark.createDataFrame([(i, v, 1.0, "r", 3) for i, v in rows], KIND).repartition(3)
    return sorted(map(tuple, nearest.top_k(df, df.filter(df.vec_id.isin(queries)), k, **options).collect()))


def vectors(seed, n, width):
    rng = random.Random(seed)
    half = lambda: rng.randint(-512, 512) / 256  # noqa: E731  exact in a float
    rows = [(i, [half() for _ in range(width)]) for i in range(n)]
    return rows + [(n + i, rows[5][1]) for i in range(40)]  # ties


def test_best_are_those_of_brute_force(spark):
    rows = vectors(1, 300, 40)
    assert run(spark, rows, [0, 5, 100, 305]) == brute(rows, [0, 5, 100, 305], 10)


def test_blocks_of_queries(spark):
    rows = vectors(2, 120, 8)
    asked = list(range(0, 160, 7))
    assert run(spark, rows, asked, most=300) == brute(rows, asked, 10)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, []), (6, [3.0]), (None, [1.0, 1.0]), (7, [-1.0, 0.5]), (7, [-1.0, 0.5])]
    assert run(spark, rows, [0, 1, 3, 6]) == brute([r for r in rows], [0, 1, 3, 6], 10)
    assert run(spark, [], [0]) == []
    assert run(spark, [(0, [1.0])], [0]) == []


def test_large_components_are_scored_in_whole_numbers(spark):
    """Scores around 2^53 and 2^63 and beyond, next to small ones; floats are widened to doubles first."""
    import numpy as np
    rng = random.Random(4)
    sizes = [1.0, 1e6, 3e7, 2e9, 1e18, 3e38]
    rows = [(i, [float(np.float32(rng.uniform(-1, 1) * sizes[(i * 7 + j) % 6 if i % 3 else 0])) for j in range(5)]) for i in range(90)]
    rows += [(90, [1e6, 1e6, 0.0, 0.0, 0.0]), (91, [1e6, 1e6, 0.0, 0.0, 0.0])]
    asked = list(range(0, 92, 6)) + [91]
    assert run(spark, rows, asked) == brute(rows, asked, 10)
    doubles = [(i, [1e308 * s, 1.0]) for i, s in enumerate([1, -1, 1])]
    df = spark.createDataFrame(doubles, "vec_id bigint, embedding array<double>")
    got = sorted(map(tuple, nearest.top_k(df, df, 1).collect()))
    assert got == [(0, 1, 2, 2**63 - 1), (1, 1, 0, -2**63), (2, 1, 0, 2**63 - 1)]
