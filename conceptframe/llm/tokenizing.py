"""Public tokenizers inside tasks, asked once for each distinct piece of text."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from conceptframe.llm.buffers import SPACES, Vocabulary, range_hashes, ranges, row_numbers, spans

#: Strings that pass through the library at once.
AT_ONCE = 2_000


@lru_cache(maxsize=4)
def tokenizer(name: str):
    """The tokenizer in a file; a bare name is looked up among the public ones where the task runs."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if os.sep not in name:
        import public_tokenizers
        name = public_tokenizers.path(name)
    return Tokenizer.from_file(name)


def encoded(name: str, texts: list[str]):
    """Ids of each text."""
    own = tokenizer(name)
    for i in range(0, len(texts), AT_ONCE):
        for one in own.encode_batch_fast(texts[i:i + AT_ONCE], add_special_tokens=False):
            yield one.ids


@lru_cache(maxsize=4)
def special_strings(name: str) -> list[bytes]:
    return [t.content.encode() for t in tokenizer(name).get_added_tokens_decoder().values() if t.content]


def odd_rows(name: str, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with white space beyond ASCII or a special string: there the cut into pieces isn't safe."""
    raw, odd = data.tobytes(), set()
    for mark in (*_WIDE_SPACES, *special_strings(name)):
        at = raw.find(mark)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            odd.add(row)
            at = raw.find(mark, int(offsets[row + 1]))  # one find is enough for a row
    return np.array(sorted(odd), np.int64)


def counted(name: str, texts: list[str]) -> np.ndarray:
    """Number of tokens of each text."""
    return np.fromiter((len(ids) for ids in encoded(name, texts)), np.int64, len(texts))


#: White space that isn't one of the six ASCII characters, in UTF-8; 1C-1F count for some libraries.
_WIDE_SPACES = [chr(c).encode() for c in (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028,
                                          0x2029, 0x202F, 0x205F, 0x3000)]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces that tile each row, for a byte-level tokenizer.

    A row is cut where no pre-token can cross: before the last white space of a run, which a word
    takes along if it is a blank.
    """
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    words, word_ends, _ = spans(data, offsets, SPACES)
    blank = ~first[words]
    blank[blank] = data[words[blank] - 1] == 0x20
    runs, run_ends, _ = spans(data, offsets, ~SPACES)
    before_word = ~first[run_ends]
    taken = before_word & (data[run_ends - 1] == 0x20)
    long = run_ends - runs > 1
    own = runs[long | ~taken]
    last = run_ends[before_word & ~taken & long] - 1
    return np.sort(np.concatenate([words - blank, own, last]))


_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True


class WordIds:
    """Ids of rows under a tokenizer that drops white space and case: each distinct word is encoded once.

    To have fewer distinct words, a comma or full stop after an ASCII letter or digit at a word's end
    is a word of its own (no pre-token holds both), and capitals A-Z are made small unless a
    character beyond ASCII follows (it might combine with them) or the block holds "<|", which begins
    the special strings.
    """

    def __init__(self, name: str):
        self.name = name
        self.words = Vocabulary(self.encode, self.forget)
        self.forget()

    def forget(self) -> None:
        self.pool, self.size = [], 0

    def encode(self, words: list[bytes]) -> np.ndarray:
        ids = list(encoded(self.name, [w.decode() for w in words]))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        places = self.size + np.cumsum(lengths) - lengths
        self.pool.append(np.fromiter((i for own in ids for i in own), np.uint32, int(lengths.sum())))
        self.size += int(lengths.sum())
        return (places << 24) | lengths

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number in each row."""
        starts, ends, firsts = spans(data, offsets, SPACES)
        if len(starts):
            final = data[ends - 1]
            apart = np.flatnonzero(((final == 0x2C) | (final == 0x2E)) & (ends - starts > 1))
            apart = apart[_ALNUM[data[ends[apart] - 2]]]
            marks = ends[apart] - 1
            order = np.argsort(np.concatenate([starts, marks]), kind="stable")
            cut = ends.copy()
            cut[apart] = marks
            starts, ends = np.concatenate([starts, marks])[order], np.concatenate([cut, marks + 1])[order]
            firsts = np.searchsorted(starts, offsets)
            if b"<|" not in data.tobytes():
                capital = (data >= 65) & (data <= 90)
                capital[:-1] &= data[1:] < 128
                data = data + capital.astype(np.uint8) * np.uint8(32)
        where = self.words(data, starts, ends, range_hashes(data, starts, ends))
        if len(self.pool) > 1:
            self.pool = [np.concatenate(self.pool)]
        pool = self.pool[0] if self.pool else np.zeros(0, np.uint32)
        lengths, places = where & 0xFFFFFF, where >> 24
        ids = pool[ranges(places, lengths)]
        per_row = np.bincount(row_numbers(firsts), weights=lengths, minlength=len(offsets) - 1).astype(np.int64)
        return ids, per_row


@lru_cache(maxsize=2)
def word_ids(name: str) -> WordIds:
    """One table of encoded words for each worker process."""
    return WordIds(name)
