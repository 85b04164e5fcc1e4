import zlib

import numpy as np
import public_tokenizers
from conftest import EDGES
from tokenizers import Tokenizer

from conceptframe.llm import tokencounts, tokenfiles
from conceptframe.llm.tokenizing import word_ids

ODD = [(20, "foo  <|endoftext|> bar"), (21, "a \n\n b\r\n  c "), (22, "don't we'll\t\tgo  "), (23, "x  y  z"), (24, " lead"), (25, "<|startoftext|>"), (26, "Word, word. WORD J\u030cA I\u0307, It\u2019S IT'S. 3.5, a.b,, \u00c9, x\u0301.")]


def test_counts_are_the_library_s(table):
    rows = EDGES + ODD
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(map(tuple, tokencounts.token_counts(table(rows)).collect()), key=str)
    want = []
    for i, t in rows:
        n = len(own.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert got == sorted(want, key=str)


def test_groups_share_counts_of_distinct_pieces(table):
    rows = [(i, " ".join(["alpha beta"] * (i % 7) + [f"w{i % 50}"])) for i in range(400)] + [(900, "rep " * 70_000), (901, None), (902, "a" * 100_000)]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(rows).select("doc_id", "text")
    got = sorted(map(tuple, tokencounts.token_counts(docs, group_bytes=1, group_pairs=1).collect()))
    want = sorted((i, len((t or "").encode()), n, n > 512) for i, t in rows for n in [len(own.encode(t or "", add_special_tokens=False).ids)])
    assert got == want
    # more than one group asks for the same pieces, and each distinct one is counted once in its bucket
    held = tokencounts.gathered(docs, "byte_bpe_50k.json", 4, 500, 20).cache()
    assert held.filter("ids is not null").count() >= 3
    counts = tokencounts.piece_counts(held, "byte_bpe_50k.json", 4)
    assert counts.count() == held.filter("bucket is not null").count() > 4


def test_whole_numbers_round_trip_through_their_bytes():
    values = np.array([0, 1, 255, 256, 70_000, 2**32 - 1])
    assert (tokencounts.restored(tokencounts.squeezed(values)) == values).all()
    assert len(tokencounts.restored(tokencounts.squeezed(values[:0]))) == 0


def test_no_rows(table):
    assert tokencounts.token_counts(table([])).count() == 0
    assert tokenfiles.token_files(table([])).count() == 0


def test_files_hold_all_ids_in_order(table, tmp_path):
    rows = EDGES + ODD
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = tokenfiles.token_files(table(rows), folder=(tmp_path / "t").as_uri(), shard_ids=900).orderBy("start").collect()
    ids = [r.doc_id for r in out]
    assert sorted(ids, key=lambda x: (x is not None, x)) == ids and len(ids) == len(rows)
    start = 0
    for r in out:
        assert r.start == start
        start += r.n_tokens
    want = sorted((str(i), len(e) + 1, zlib.crc32(np.array([*e, 1], "<u4").tobytes()))
                  for i, t in rows for e in [own.encode(t or "", add_special_tokens=False).ids])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in out) == want
    assert len({(r.part, r.seq) for r in out}) > 1


def test_one_document_is_decoded_from_its_own_symbols():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 500, 1, 3000, 7, 20_000])
    ids = rng.integers(0, 40, lengths.sum()).astype(np.uint32)
    ids[600:2600] = 7  # a run of one id
    image = tokenfiles.Image(tokenfiles.pack(ids, lengths, 49_408))
    assert (image.ids() == ids).all()
    assert len(image.symbols) < len(ids) / 2
    ends = np.cumsum(lengths)
    for n in range(len(lengths)):
        assert (image.document(n) == ids[ends[n] - lengths[n]:ends[n]]).all()


def test_wide_ids_round_trip():
    ids = np.array([70_000, 1, 70_000, 1] * 50, np.uint32)
    image = tokenfiles.Image(tokenfiles.pack(ids, np.array([100, 100]), 70_001))
    assert (image.ids() == ids).all()


def test_words_are_kept_between_blocks():
    words = word_ids("word_bpe_49k.json")
    data = np.frombuffer(b"same same other", np.uint8)
    first, again = words(data, np.array([0, 15])), words(data, np.array([0, 15]))
    assert (first[0] == again[0]).all()
