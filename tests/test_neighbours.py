import math
import random

import pytest

from conceptframe.operators.neighbours import nearest_neighbours, sample_distance_graph
from conceptframe.schema import Refused

KIND = "sample_id string, vector array<double>"


def brute(rows, k):
    out = []
    for i, x in rows:
        far = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))), j) for j, y in rows if j != i)
        out += [(i, j, round(d, 9)) for d, j in far[:k]]
    return sorted(out)


def run(spark, rows, k, **options):
    found = nearest_neighbours(spark.createDataFrame(rows, KIND).repartition(3), k, **options).collect()
    return sorted((r.sample_id, r.neighbour, round(r.distance, 9)) for r in found)


@pytest.mark.parametrize("k, pivots, chunk", [(3, 6, 20), (5, 64, 4096)])
def test_neighbours_are_those_of_brute_force(spark, k, pivots, chunk):
    """Clusters, ties on a grid, more copies than neighbours, and one material far away."""
    rng = random.Random(k)
    rows = [[c + rng.randint(0, 4) / 4, c + rng.randint(0, 4) / 4, rng.randint(0, 1)] for c in (0, 50, 51) for _ in range(40)]
    rows += [[7.0, 7.0, 0.0]] * 30 + [[1e5, 0.0, 0.0], [-0.0, 0.0, 0.0], [0.0, 0.0, 0.0]]
    rows = [(f"s{i}", [float(v) for v in x]) for i, x in enumerate(rows)]
    assert run(spark, rows, k, pivots=pivots, chunk=chunk) == brute(rows, k)


def test_graph_is_the_union_of_directed_lists(spark):
    rows = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 2.0])], KIND)
    assert sorted(map(tuple, sample_distance_graph(rows, 1).collect())) == [("a", "b", 1.0), ("a", "c", 2.0)]


def test_few_materials_and_refusals(spark):
    assert run(spark, [("a", [1.0])], 5) == []
    assert run(spark, [], 5) == []
    assert run(spark, [("a", [1.0]), ("b", [1.0])], 5) == [("a", "b", 0.0), ("b", "a", 0.0)]
    for bad in ([("a", None)], [("a", [None])], [("a", [float("nan")])], [(None, [1.0])]):
        with pytest.raises(Exception, match="missing|without"):
            run(spark, bad, 1)
    with pytest.raises(Refused):
        run(spark, [("a", [1.0])], 0)
