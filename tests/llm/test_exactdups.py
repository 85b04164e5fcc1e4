import hashlib
import random

from parity import compare, duck

from conceptframe.llm import exactdups
from conftest import DATA, EDGES


def brute(rows):
    plain = [(i, t or "") for i, t in rows]
    norm = ["".join(c for c in t if c not in " \t\n\x0b\x0c\r") for _, t in plain]
    out = []
    for n, (i, t) in enumerate(plain):
        group = [m for m in range(len(plain)) if norm[m] == norm[n]]
        best = min(group, key=lambda m: (-len(plain[m][1]), plain[m][0] is None, plain[m][0] or 0, m))
        out.append((i, plain[best][0], len(group), (plain[best][0], plain[best][1]) == (i, t) and best == n, hashlib.sha256(norm[n].encode()).hexdigest()))
    return sorted(out, key=str)


def run(df, **options):
    return sorted(map(tuple, exactdups.exact_groups(df, **options).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_random_texts_and_edges(table):
    rng = random.Random(4)
    rows = EDGES + [(100 + n, "".join(rng.choice("ab \n é") for _ in range(rng.randint(0, 5)))) for n in range(400)]
    assert run(table(rows, 5)) == brute(rows)


def test_ranges_of_hashes_give_the_same(table):
    rows = [(n, f"text {n % 300}" + " " * (n % 7)) for n in range(1000)]
    assert run(table(rows, 4), most=100) == brute(rows)


def test_hot_group_and_unique_rows_pass_through(spark, table):
    rows = [(n, "same  text" if n % 3 == 0 else f"own {n}") for n in range(900)]
    out = run(table(rows))
    assert out == brute(rows)
    hashed = table(rows).selectExpr("doc_id", "xxhash64(text) AS h")
    maybe = {r.doc_id for r in exactdups.tested(hashed, "h", 1).filter("_maybe").collect()}
    assert maybe >= set(range(0, 900, 3)) and len(maybe) < 330


def test_rows_that_stay_keep_their_columns(table):
    df = table([(1, "a b"), (2, "ab"), (2, "ab"), (3, None), (4, " "), (5, "c"), (5, "c")])
    stay = exactdups.deduplicated(df)
    assert stay.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in stay.collect()) == [(1, "a b"), (4, " "), (5, "c")]


def test_empty_table_and_very_long_text(spark, table):
    assert run(table([(1, "x")]).limit(0)) == []
    long = "ab " * 10_000_000
    assert [r[:4] for r in run(table([(1, long), (2, long + " "), (3, "w" * 20_000_000)], 1))] == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]


def test_equals_its_sql(spark):
    assert compare(spark, duck(DATA), DATA, exactdups.query, exactdups.SQL)[0].startswith("ok")
