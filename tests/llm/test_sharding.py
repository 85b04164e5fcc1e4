import zlib

import numpy as np
from conftest import EDGES

from conceptframe.llm.sharding import feistel_shards, permuted


def test_permutation_of_any_size_and_back():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        image = permuted(np.arange(n), n, 3)
        assert sorted(image.tolist()) == list(range(n))
        assert (permuted(image, n, 3, inverse=True) == np.arange(n)).all()
    assert (permuted(np.arange(1000), 1000, 3) != permuted(np.arange(1000), 1000, 4)).any()


def test_shards(table):
    out = feistel_shards(table(EDGES)).collect()
    assert len(out) == len(EDGES)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in EDGES)
    sizes = [sorted(r.slot for r in out if r.shard == s) for s in range(8)]
    assert all(s == list(range(len(s))) for s in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
    numbers = sorted(out, key=lambda r: r.row_number)
    assert [r.row_number for r in numbers] == list(range(len(out)))
    assert [r.doc_id for r in numbers] == sorted((r.doc_id for r in out), key=lambda x: (x is not None, x))
    place = permuted(np.arange(len(out)), len(out))
    assert all((place[r.row_number] % 8, place[r.row_number] // 8) == (r.shard, r.slot) for r in out)


def test_same_shards_from_another_layout(table):
    rows = [(i, f"text {i % 7}") for i in range(300)]
    a, b = (sorted(map(tuple, feistel_shards(table(rows, p)).collect())) for p in (1, 5))
    assert [x[:6] for x in a] == [x[:6] for x in b]


def test_no_rows(table):
    assert feistel_shards(table([])).count() == 0
