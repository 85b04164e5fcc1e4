import hashlib
import random

from conftest import EDGES

from conceptframe.llm.repeats import SPAN, repeated_passages


def brute(rows):
    """All strings of SPAN bytes in corpus order; equal ids in any order hold equal bytes here."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for x in range(len(data) - SPAN + 1):
            if data[x:x + SPAN] in seen:
                gone[x:x + SPAN] = b"\1" * SPAN
            seen.add(data[x:x + SPAN])
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((str(i), len(data), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(data, gone) if not g)).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_passages(df).collect())


def test_removed_bytes_are_those_of_brute_force(table):
    for seed in (1, 2):
        rng = random.Random(seed)
        base = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(80, 400))) for _ in range(6)] + ["a" * 500, "ab" * 200, "\0" * 150]
        rows = []
        for i in range(50):
            parts = []
            for _ in range(rng.randint(0, 6)):
                b = rng.choice(base)
                parts.append(rng.choice([b, b[rng.randrange(len(b) // 2):][:rng.randint(90, 200)], "".join(rng.choice("pqrst") for _ in range(rng.randint(0, 60)))]))
            rows.append((i, "".join(parts)))
        rows += [(50, rows[3][1]), (51, rows[3][1] + "z")]
        assert found(table(rows)) == brute(rows)


def test_edges_and_exact_lengths(table):
    rows = [r for r in EDGES if r[0] is not None] + [(60, "q" * 99), (61, "q" * 99), (62, "r" * 100), (63, "r" * 100), (64, "r" * 101), (65, "s" * 99 + "t"), (66, "s" * 98 + "t")]
    assert found(table(rows)) == brute(rows)


def test_only_short_texts_and_strings_that_share_no_whole_span(table):
    short = [(i, "short text") for i in range(20)]
    assert found(table(short)) == brute(short)
    near = [(1, "k" * 60 + "common part of both texts, long enough for a context of its own, " + "l" * 40), (2, "m" * 60 + "common part of both texts, long enough for a context of its own, " + "n" * 40)]
    assert found(table(near)) == brute(near)


def test_what_is_left(table):
    row = [(1, "u" * 10 + "abcdefghij" * 12), (2, "abcdefghij" * 12 + "vw")]
    out = {r.doc_id: bytes(r.kept) for r in repeated_passages(table(row), with_text=True).collect()}
    assert out[2] == b"vw" and out[1].startswith(b"u" * 10)


def test_no_rows(table):
    assert repeated_passages(table([])).count() == 0
    assert repeated_passages(table([(1, None), (2, "")])).count() == 2
