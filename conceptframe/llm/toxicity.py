"""Toxicity by a subsequence string kernel, a support vector machine and Nystroem landmarks.

A text is cut into sentences (at stops and line ends) and words (white space and separating marks; marks
like - * _ ' # inside a word are dropped, case is folded). The spans that are judged are the words of a
sentence, two neighbouring words written together, runs of three and more single characters written
together, and, of long words, every stretch of `STRETCHES` bytes. So an insult is met in two pieces, spelled
out, and inside a long word.

Two spans are compared by the subsequences of three and four symbols that they share: every choice of
places within `REACH` of each other counts `DECAY` to the power of what it spans, so that gaps, inserted
and left-out characters weaken a match and do not end it. Word begin and end are symbols too.

Landmarks (spans of toxic and of clean sentences) span the Nystroem space; the machine is a linear one in
it, fitted with a squared hinge. Its decision for a span is a sum over the landmarks of kernel values, and
since the kernel is a product of feature vectors, the landmarks fold into one table with a weight for each
subsequence: scoring a span costs thirty lookups for each of its characters, and gives the same value as
going over the landmarks.

Labels belong to documents. Their sentences take them over: a clean document's are all clean; of a toxic
document the sentence with the strongest span is the toxic one, found anew in each round of fitting. The
strongest spans are learned in disguise too: with a character put in, left out or doubled at each place.
A document's score is a logistic function of its strongest span and of how many of its words, and which
share of them, pass each of a few decision values; toxic training documents enter that fit a second time
with their strongest span disguised. The fit reads at most `TRAIN_DOCS` labelled documents, those with
the smallest digests of their ids, half of them toxic where there are enough, and mines at most `NEGATIVES`
clean spans a round. Documents whose crc32(id as text) is a multiple of five are never learned from. Only
texts are inputs of a score.

Nulls: a null or empty text has no span and gets the score of the weakest possible one. Null ids count as
the empty text (held out) and keep their rows, as repeated ids do; a label row with a null is no label;
several label rows for an id: the larger one. No labels of both kinds: every score is the share of toxic
labels, 0 without labels. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptframe.llm.buffers import U64, Vocabulary, blocks, mix, range_hashes, ranges, row_numbers, spans
from conceptframe.llm.shared import documents, give_back

NAME = "op4_toxicity_kernel_svm"
SQL = None  # tests: kernel against its definition, folded table against landmarks, disguises, held-out accuracy
TRAIN_DOCS, LANDMARKS, NEGATIVES, FITS = 4000, 160, 8000, 3
POOL, FIRM, ALIKE, SELDOM, OWN, SURE = 50_000, 60, 0.65, 0.3, 0.6, 12.0  # clean spans looked at; witnesses, their likeness and strength
REACH, DECAY, SYMBOLS, SLOTS = 6, 0.75, 64, 1 << 20
EDGE = SYMBOLS - 1
LONG, STRETCHES = 10, (6, 9)  # bytes of a long word and of its stretches
PAIR_MOST = 11  # bytes of two words written together
RIDGE, PENALTY = 1e-3, 10.0
PIECE, AT_ONCE = 4096, 40_000  # bytes of a piece of a very long word, and of the pieces judged at a time
SCREEN = 0.01  # share of learned disguises that the look at the closest triples may cost
CLEAN_WEIGHT = 3.0  # of a clean document in the last fit: it costs more to lose one
FAINT = 0.5  # a decision up to here says nothing alone
STEADY = 80  # words that a text counts as having besides its own, in shares
LEVELS = (0.0, 0.25, 0.5)  # decision values that words are counted at
WEAKEST = -2.0  # of a text without spans
FIXED = 1e8  # decisions are kept as whole numbers of this share

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[:] = 36 + np.arange(256) % 26
_SYMBOL[97:123] = np.arange(26)
_SYMBOL[48:58] = 26 + np.arange(10)
PATTERNS = [(a, b) for b in range(2, REACH) for a in range(1, b)] + [(a, b, c) for c in range(3, REACH) for b in range(2, c) for a in range(1, b)]
NEAR = ((1, 2), (1, 3), (2, 3))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_DROP = np.zeros(256, bool)
_DROP[[ord(c) for c in "-*_'#@$%^~`+&"]] = True
_APART = np.zeros(256, bool)
_APART[:128] = [not chr(c).isalnum() for c in range(128)]
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def disguised(unit: bytes) -> list[bytes]:
    """A span with one character put in at each inner place (several), doubled, or left out."""
    put = [unit[:i] + c + unit[i:] for i in range(1, len(unit)) for c in (unit[i - 1:i], *(bytes([b"aeionrstxz7q0"[(5 * i + k) % 13]]) for k in (0, 3, 7)))]
    return put + [unit[:i] + unit[i + 1:] for i in range(1, len(unit) - 1)] if len(unit) >= 4 else []


def symbols_of(units: list[bytes], edge: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all spans, with an edge on both sides of each, and their bounds."""
    pad = 1 if edge else 0
    sizes = np.array([len(u) + 2 * pad for u in units], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    symbols = np.full(int(bounds[-1]), EDGE, np.int64)
    symbols[ranges(bounds[:-1] + pad, sizes - 2 * pad)] = _SYMBOL[np.frombuffer(b"".join(units), np.uint8)]
    return symbols, bounds


def stretches(unit: bytes) -> list[bytes]:
    return [unit[i:i + n] for n in STRETCHES for i in range(len(unit) - n + 1)] if len(unit) >= LONG else []


def subsequences(symbols: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pattern of gaps: span, slot of the subsequence and weight, of all its places."""
    unit = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for pattern in PATTERNS:
        reach = pattern[-1]
        first = np.flatnonzero(unit[:-reach] == unit[reach:]) if len(unit) > reach else np.zeros(0, np.int64)
        code = symbols[first]
        for step in pattern:
            code = code * SYMBOLS + symbols[first + step]
        if len(pattern) == 3:
            code = (mix(code.astype(U64)) >> U64(44)).astype(np.int64) % (SLOTS - SYMBOLS ** 3) + SYMBOLS ** 3
        yield unit[first], code, DECAY ** (reach + 1)


def scale(bounds: np.ndarray) -> np.ndarray:
    """Length of a span's feature vector, as if no subsequence came twice: a function of its size."""
    size = np.diff(bounds)
    total = sum(np.maximum(size - p[-1], 0) * DECAY ** (2 * (p[-1] + 1)) for p in PATTERNS)
    return np.sqrt(np.maximum(total, DECAY ** 6))


def kernel(units: list[bytes], landmarks: list[bytes], edge: bool = True) -> np.ndarray:
    """Normalised subsequence kernel, spans x landmarks, over the subsequences that the landmarks have."""
    marks, mark_bounds = symbols_of(landmarks)
    places = list(subsequences(marks, mark_bounds))
    slots = np.unique(np.concatenate([what for _, what, _ in places]))
    number = np.full(SLOTS, -1, np.int64)
    number[slots] = np.arange(len(slots))
    table = np.zeros((len(slots), len(landmarks)), np.float32)
    for who, what, weight in places:
        np.add.at(table, (number[what], who), weight)
    out = np.zeros((len(units), len(landmarks)))
    symbols, bounds = symbols_of(units, edge)
    for who, what, weight in subsequences(symbols, bounds):
        at = number[what]
        who, at = who[at >= 0], at[at >= 0]
        for start in range(0, len(who), 20_000):
            part = slice(start, start + 20_000)
            heads = np.flatnonzero(np.concatenate([[True], np.diff(who[part]) > 0]))
            out[who[part][heads]] += weight * np.add.reduceat(table[at[part]], heads, axis=0)
    return out / scale(bounds)[:, None] / scale(mark_bounds)[None, :]


@dataclass
class Machine:
    """Weights of subsequences (the folded landmarks) and bias; what stays below `screen` in `near` is not looked at further."""

    table: np.ndarray
    bias: float
    screen: float = -np.inf


def near(machines: list[Machine], units: list[bytes]) -> np.ndarray:
    """Decisions from the closest triples alone, of each span or its best stretch: machines x spans."""
    symbols, bounds = symbols_of(units)
    unit = np.repeat(np.arange(len(units)), np.diff(bounds))
    sums = np.zeros((len(machines), len(symbols) + 1))
    for a, b in NEAR:
        first = np.flatnonzero(unit[:-b] == unit[b:]) if len(unit) > b else np.zeros(0, np.int64)
        code = (symbols[first] * SYMBOLS + symbols[first + a]) * SYMBOLS + symbols[first + b]
        for own, m in zip(sums, machines):
            own[first + 1] += DECAY ** (b + 1) * m.table[code]
    sums = np.cumsum(sums, axis=1)
    out = (sums[:, bounds[1:]] - sums[:, bounds[:-1]]) / scale(bounds)
    long = np.flatnonzero(np.diff(bounds) - 2 >= LONG)
    for n in STRETCHES if len(long) else ():
        count = np.diff(bounds)[long] - 2 - n + 1
        start = ranges(bounds[long] + 1, count)
        heads = np.concatenate([[0], np.cumsum(count)[:-1]])
        best = np.maximum.reduceat(sums[:, start + n - 2] - sums[:, start], heads, axis=1) / scale(np.array([0, n]))
        out[:, long] = np.maximum(out[:, long], best)
    return out + np.array([m.bias for m in machines])[:, None]


def linear(machines: list[Machine], units: list[bytes], edge: bool = True) -> np.ndarray:
    """Decisions of machines on spans as they are: machines x spans."""
    symbols, bounds = symbols_of(units, edge)
    out = np.zeros((len(machines), len(units)))
    for who, what, weight in subsequences(symbols, bounds):
        for own, machine_ in zip(out, machines):
            own += weight * np.bincount(who, weights=machine_.table[what], minlength=len(units))
    return out / scale(bounds) + np.array([m.bias for m in machines])[:, None]


def decide(machines: list[Machine], units: list[bytes]) -> np.ndarray:
    """Decisions on spans, each the largest of its own and those of its stretches; a few at a time.

    What is longer than `PIECE` bytes is judged in overlapping pieces, so that a word of any length is read whole.
    """
    pieces, owner = [], []
    for n, u in enumerate(units):
        cuts = range(0, max(len(u) - STRETCHES[-1], 1), PIECE - STRETCHES[-1]) if len(u) > PIECE else (0,)
        pieces += [u[i:i + PIECE] for i in cuts]
        owner += [n] * len(cuts)
    out = np.full((len(machines), len(units)), WEAKEST)
    sizes = np.cumsum([len(p) for p in pieces]) // AT_ONCE
    for batch in range(int(sizes[-1]) + 1 if len(sizes) else 0):
        low, high = np.searchsorted(sizes, [batch, batch + 1])
        if low == high:
            continue
        some, of = pieces[low:high], np.array(owner[low:high])
        if any(np.isfinite(m.screen) for m in machines):
            able = np.flatnonzero((near(machines, some) >= np.array([m.screen for m in machines])[:, None]).any(0))
            some, of = [some[i] for i in able.tolist()], of[able]
            if not some:
                continue
        own = linear(machines, some)
        parts = [stretches(u) for u in some]
        count = np.array([len(p) for p in parts])
        if count.any():
            inner = linear(machines, [s for p in parts for s in p], False)
            for row, values in zip(own, inner):
                np.maximum.at(row, np.repeat(np.arange(len(some)), count), values)
        for row, values in zip(out, own):
            np.maximum.at(row, of, values)
    return np.clip(out, WEAKEST, -WEAKEST)


@dataclass
class Model:
    """Two machines and the logistic function of documents.

    `alone` knows spans of which one is enough; `often` those that clean documents have too, but rarely.
    """

    alone: Machine | None
    often: Machine | None
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(LEVELS) + 2))
    constant: float | None = None

    def probability(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features), self.constant)
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -30, 30)))


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words one after the other, bounds of the words, their rows, and whether a word begins a sentence."""
    folded = _FOLD[data]
    if len(folded) > 1:  # capitals of two bytes
        second = (folded[:-1] == 0xC3) & (folded[1:] >= 0x80) & (folded[1:] <= 0x9E) & (folded[1:] != 0x97)
        folded[1:][second] += 0x20
    stop = _STOP[folded]
    stop[:-1] &= _SPACE[folded[1:]]
    stop |= folded == 0x0A
    stay = ~_DROP[folded]
    moved = np.concatenate([[0], np.cumsum(stay)])
    folded, stop = folded[stay], np.concatenate([[0], np.cumsum(stop[stay])])
    starts, ends, firsts = spans(folded, moved[offsets], _APART)
    row = row_numbers(firsts)
    letters = folded[ranges(starts, ends - starts)] if len(starts) else folded[:0]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    head = np.ones(len(starts), bool)
    head[1:] = (row[1:] != row[:-1]) | (stop[starts[1:]] > stop[ends[:-1]])
    return letters, bounds, row, head


def joined(bounds: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word (exclusive) of the spans of several words: neighbours, and runs of single characters."""
    n = len(head)
    size = np.diff(bounds)
    pair = np.flatnonzero(~head[1:] & (size[1:] + size[:-1] <= PAIR_MOST) & (size[1:] > 1) & (size[:-1] > 1) & (size[1:] + size[:-1] >= 4)) if n > 1 else np.zeros(0, np.int64)
    single = size == 1
    begin = np.flatnonzero(single & (head | ~np.concatenate([[False], single[:-1]])))
    close = np.flatnonzero(single & np.concatenate([head[1:] | ~single[1:], [True]])) + 1 if n else begin
    run = close - begin >= 3
    first, last = np.concatenate([pair, begin[run]]), np.concatenate([pair + 2, close[run]])
    order = np.argsort(first, kind="stable")
    return first[order], last[order]


def features(rows: int, word_row: np.ndarray, alone: np.ndarray, often: np.ndarray, more_row: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Of each row: 1, the strongest span by itself (what it has above `FAINT`), and the share of words above each level (as logarithms)."""
    out = np.zeros((rows, len(LEVELS) + 2))
    top = np.full(rows, WEAKEST)
    np.maximum.at(top, word_row, alone)
    np.maximum.at(top, more_row, more)
    count = np.bincount(word_row, minlength=rows)
    out[:, 0], out[:, 1] = 1, np.maximum(top - FAINT, 0)
    for k, level in enumerate(LEVELS):
        out[:, 2 + k] = np.log1p(200 * np.bincount(word_row[often > level], minlength=rows) / (count + STEADY))
    return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps on its active rows."""
    w = np.zeros(x.shape[1] + 1)
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        active = np.flatnonzero(y * (x @ w[:-1] + w[-1]) < 1)
        square, right = np.zeros_like(ridge), np.zeros_like(w)
        for start in range(0, len(active), 2000):  # a part at a time, for the driver's memory
            rows = active[start:start + 2000]
            part = np.hstack([x[rows], np.ones((len(rows), 1))])
            a = part * weight[rows, None]
            square += part.T @ a
            right += a.T @ y[rows]
        new = np.linalg.solve(ridge + PENALTY * square, PENALTY * right)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Weights of a logistic function by damped Newton steps, none below 0 but the first column's.

    A column whose weight comes out negative is taken out and the rest fitted anew.
    """
    free = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        w[free] = _newton(x[:, free], y, weight, ridge)
        worst = 1 + int(np.argmin(w[1:]))
        if w[worst] >= 0:
            return w
        free[worst] = False


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    w = np.zeros(x.shape[1])
    hold = np.full(x.shape[1], ridge * weight.sum() / len(y))
    hold[0] = 1e-6
    loss = lambda v: (weight * np.logaddexp(0, -(2 * y - 1) * (x @ v))).sum() + (hold * v * v).sum() / 2
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(hold), x.T @ (weight * (y - p)) - hold * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


class Bags:
    """Spans of labelled documents by number: all words of each document and its different joined spans."""

    def __init__(self, texts: list[bytes]):
        number: dict[bytes, int] = {}
        self.words, self.more = [], []
        for text in texts:
            letters, bounds, _, head = cut(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            raw, at = letters.tobytes(), bounds.tolist()
            self.words.append(np.fromiter((number.setdefault(raw[a:b], len(number)) for a, b in zip(at[:-1], at[1:])), np.int32, len(at) - 1))
            first, last = joined(bounds, head)
            self.more.append(np.unique(np.fromiter((number.setdefault(raw[at[a]:at[b]], len(number)) for a, b in zip(first.tolist(), last.tolist())), np.int32, len(first))))
        self.units = list(number)

    def features(self, alone: np.ndarray, often: np.ndarray) -> np.ndarray:
        out = [np.zeros((0, len(LEVELS) + 2))]
        for start in range(0, len(self.words), 200):  # a part at a time, for the driver's memory
            rows = [self.words[start:start + 200], self.more[start:start + 200]]
            word_row, more_row = (np.repeat(np.arange(len(r)), [len(own) for own in r]) for r in rows)
            words, more = (np.concatenate(r) for r in rows)
            out.append(features(len(rows[0]), word_row, alone[words], often[words], more_row, alone[more]))
        return np.vstack(out)


def folded_table(landmarks: list[bytes], beta: np.ndarray) -> np.ndarray:
    marks, bounds = symbols_of(landmarks)
    table, share = np.zeros(SLOTS), beta / scale(bounds)
    for who, what, weight in subsequences(marks, bounds):
        np.add.at(table, what, weight * share[who])
    return table


def inside(unit: bytes, around: bytes) -> list[bytes]:
    """Stretches that hold a whole span between other letters."""
    size = next((n for n in STRETCHES if n > len(unit)), None)
    spare = size - len(unit) if size else 0
    return [around[i:i + left] + unit + around[i + left:i + spare] for left in range(spare + 1) for i in range(0, len(around) - spare, 5)] if size else [unit[i:i + STRETCHES[-1]] for i in range(2)]


def machine(units: list[bytes], found: np.ndarray, counts: np.ndarray, masked: list[int], hard: np.ndarray, plain: np.ndarray, known: set[bytes], deep: bool, often: np.ndarray) -> Machine:
    """Machine that tells found spans, and masked ones in disguise and inside others, from hard and plain clean ones."""
    hard, plain = hard[~np.isin(hard, found)], plain[~np.isin(plain, found)]
    top = found[np.argsort(-counts, kind="stable")]
    landmarks = [units[i] for i in [*top[:LANDMARKS // 2], *hard[:LANDMARKS // 2]]]
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    root = vectors / np.sqrt(np.maximum(values, RIDGE))[None, :]
    text = lambda rows: [units[i] for i in rows.tolist()]
    around = b"".join(text(plain[:8]))[:30]
    masks = [m for i in masked for m in disguised(units[i]) if m not in known]
    within = [m for i in masked for m in inside(units[i], around)]
    parts = [m for u in text(plain) + text(hard) if len(u) >= LONG for m in stretches(u)][:NEGATIVES]
    shares = (1 / 5, 1 / 5, 1 / 10, 1 / 4, 1 / 8, 1 / 8) if deep else (1 / 3, 1 / 3, 0, 1 / 6, 1 / 6, 0)
    sets = [(text(found), True, 1), (masks, True, 1), (within if deep else [], False, 1), (text(hard), True, -1), (text(plain), True, -1), (parts if deep else [], False, -1)]
    sets = [(*s, share) for s, share in zip(sets, shares)]
    total = sum(len(u) for u, *_ in sets)
    x = np.vstack([kernel(u, landmarks, edge) @ root for u, edge, _, _ in sets if u])
    y = np.concatenate([np.full(len(u), float(sign)) for u, _, sign, _ in sets])
    parts_of = [counts / counts.sum(), *[np.full(len(u), 1 / max(len(u), 1)) for u, *_ in sets[1:]]]
    for n, rows in ((3, hard), (4, plain)):  # a clean span counts with the documents that have it
        parts_of[n] = parts_of[n] * np.minimum(1 + often[rows] / 4, 40)
    weight = np.concatenate([p * share * total for p, (_, _, _, share) in zip(parts_of, sets)])
    w, bias = svm(x, y, np.minimum(weight, 100.0))
    return Machine(folded_table(landmarks, root @ w), bias)


def rare_in_clean(units: list[bytes], kinds: list[np.ndarray], toxic: np.ndarray, firm: np.ndarray) -> np.ndarray:
    """Which spans are like words of clean documents much more seldom than like words of toxic ones, and mostly themselves."""
    words = np.unique(np.concatenate(kinds))
    like = np.zeros((len(words), len(firm)), bool)
    marks = [units[i] for i in firm.tolist()]
    for start in range(0, len(words), 10_000):
        like[start:start + 10_000] = kernel([units[i] for i in words[start:start + 10_000].tolist()], marks) >= ALIKE
    some = [n for n, k in enumerate(kinds) if len(k)]
    has = np.array([like[np.searchsorted(words, kinds[n])].any(0) for n in some])
    bad = toxic[some].astype(bool)
    own = np.array([np.mean([i in k for k in sets]) for sets in [[set(kinds[n].tolist()) for n, t in zip(some, bad) if t]] for i in firm.tolist()])
    near, far = has[bad].mean(0), has[~bad].mean(0)
    return (far < SELDOM * near) & (own > OWN * near)


def fit(texts: list[bytes], toxic: np.ndarray) -> Model:
    """Model of labelled documents, on the driver; its input is bounded by `TRAIN_DOCS`."""
    share = float(toxic.mean()) if len(texts) else 0.0
    if not len(texts) or toxic.all() or not toxic.any():
        return Model(None, None, constant=share)
    bags = Bags(texts)
    units = bags.units
    kinds = [np.unique(w) for w in bags.words]
    bad = [k for k, t in zip(kinds, toxic) if t and len(k)]
    good = [k for k, t in zip(kinds, toxic) if not t]
    if not bad:
        return Model(None, None, constant=share)
    in_toxic = np.bincount(np.concatenate(bad), minlength=len(units))
    in_clean = np.bincount(np.concatenate([np.zeros(0, np.int64), *good]), minlength=len(units))
    # the first witnesses: words found in many more toxic documents than their share lets expect
    nt, nc = len(bad), max(len(good), 1)
    expected = np.maximum((in_toxic + in_clean) * nt / (nt + nc), 0.05)
    strength = in_toxic * np.log(np.maximum(in_toxic, 0.5) / expected) - (in_toxic - expected)
    strength[in_toxic <= expected] = -1
    odds = in_toxic / nt > 3 * in_clean / nc  # what clean documents have as often is no witness
    marked = np.flatnonzero(odds & (strength >= SURE))
    joins = [m for m, t in zip(bags.more, toxic) if not t]
    clean = np.unique(np.concatenate([np.flatnonzero(in_clean > 0), *joins]))
    clean = clean[(in_clean[clean] > 0) | (in_toxic[clean] == 0)]  # written together, any two words may look like a third
    if not len(clean):
        return Model(None, None, constant=share)
    clean = clean[np.argsort([zlib.crc32(units[i]) for i in clean.tolist()], kind="stable")]
    common = clean[np.argsort(-in_clean[clean], kind="stable")]
    pool = np.unique(np.concatenate([common[:POOL // 2], clean[:POOL // 2]]))  # spans that hard ones are looked for among
    plain = np.unique(np.concatenate([common[:NEGATIVES // 4], clean[:NEGATIVES // 4]]))
    looked = np.unique(np.concatenate([pool, *bad]))
    known = {units[i] for i in np.flatnonzero(in_clean > 0).tolist()}

    def decided(m: Machine) -> np.ndarray:
        out = np.full(len(units), WEAKEST)
        out[looked] = decide([m], [units[i] for i in looked.tolist()])[0]
        return out

    def hardest(value: np.ndarray) -> np.ndarray:
        return pool[np.argsort(-value[pool], kind="stable")[:NEGATIVES // 2]]

    value, often = strength, None
    for turn in range(FITS):
        witness = np.array([b[np.argmax(value[b])] for b in bad])
        found, counts = np.unique(np.concatenate([witness, marked]), return_counts=True)
        sure = odds[found] & ((turn > 0) | (value[found] >= max(np.quantile(value[witness], 0.1), 1.0)))
        found, counts = (found[sure], counts[sure]) if sure.any() else (found, counts)
        top = found[np.argsort(-counts, kind="stable")][:LANDMARKS // 2].tolist()
        often = machine(units, found, counts, [i for i in top if in_clean[i] == 0], hardest(value) if turn else pool[:NEGATIVES // 2], plain, known, False, in_clean)
        value = decided(often)
    # spans like none of a clean document are enough alone
    firm = found[(in_toxic[found] >= 2) & (in_clean[found] == 0)] if len(found) else found
    firm = firm if len(firm) else found
    firm = firm[np.argsort(-in_toxic[firm], kind="stable")][:FIRM]
    firm = firm[rare_in_clean(units, kinds, toxic, firm)]
    if not len(firm):
        firm = found
    alone = often
    for _ in range(FITS):
        hard = hardest(decided(alone))
        alone = machine(units, firm, in_toxic[firm].astype(float) + 1, firm[np.argsort(-in_toxic[firm], kind="stable")][:LANDMARKS // 2].tolist(), hard, plain, known, True, in_clean)
    # from here on spans that are far from all that was learned are passed over
    disguises = [m for i in firm.tolist() for m in [units[i], *disguised(units[i]), *inside(units[i], b"theraninonenstatore")]]
    alone.screen = float(np.quantile(near([alone], disguises), SCREEN))
    often = Machine(often.table, often.bias)
    known_often = looked[value[looked] > LEVELS[0]]
    often.screen = float(np.quantile(near([often], [units[i] for i in known_often.tolist()]), SCREEN)) if len(known_often) else np.inf
    one = decide([alone], units)[0]
    words = np.unique(np.concatenate([np.zeros(0, np.int32), *bags.words]))
    many = np.full(len(units), WEAKEST)
    both = decide([alone, often], [units[i] for i in words.tolist()])
    one[words], many[words] = both
    seen = bags.features(one, many)
    # toxic documents with such a span a second time, the span in disguise and none other there
    mask = {i: float(np.quantile(decide([alone], d), 0.1)) for i in firm.tolist() if (d := disguised(units[i]))}
    lower = np.array([max((mask[i] for i in np.intersect1d(k, firm).tolist() if i in mask), default=np.nan) if t else np.nan for k, t in zip(kinds, toxic)])
    again = seen[np.isfinite(lower)].copy()
    again[:, 1] = np.minimum(again[:, 1], np.maximum(lower[np.isfinite(lower)] - FAINT, 0))
    again[:, 2:] = 0
    x = np.vstack([seen, again])
    y = np.concatenate([toxic.astype(float), np.ones(len(again))])
    weight = np.concatenate([np.where(toxic, 1.0, CLEAN_WEIGHT), np.ones(len(again))])
    return Model(alone, often, logistic(x, y, weight))


def packed(values: np.ndarray) -> np.ndarray:
    """One or two decisions of a span in one whole number."""
    whole = np.rint(values * FIXED).astype(np.int64)
    return whole[0] * (1 << 32) + (whole[-1] + (1 << 31))


def unpacked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (values >> 32) / FIXED, ((values & 0xFFFFFFFF) - (1 << 31)) / FIXED


def held_out(id_column: str | Column) -> Column:
    return F.pmod(F.coalesce(F.crc32(F.col(id_column).cast("string") if isinstance(id_column, str) else id_column.cast("string")), F.lit(0)), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """Model from at most `most` labelled documents that are not held out."""
    known = labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg(
        (F.max(label_column) > 0).alias("_toxic")).filter(~held_out("_id"))
    digest = F.sha2(F.col("_id").cast("string"), 256)
    chosen = known.filter("_toxic").orderBy(digest).limit(most // 2).unionByName(known.filter("not _toxic").orderBy(digest).limit(most - most // 2))
    rows = docs.select(F.col(id_column).alias("_doc"), F.col(text_column).cast("string").alias("_text")).join(
        F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_id", "_toxic", F.coalesce("_text", F.lit("")).alias("_text")).toPandas()
    rows = rows.sort_values(["_id", "_text"], kind="stable")
    texts, toxic = [t.encode() for t in rows["_text"]], rows["_toxic"].to_numpy(bool)
    del rows
    model = fit(texts, toxic)
    del texts
    give_back()
    return model


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, held_out, score and predicted for each row; `keep` carries columns along."""
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"), held_out(id_column).alias("_out"),
                       *[F.col(k).alias(f"_keep_{k}") for k in keep])
    others = [c for c in rows.columns if c != "_text"]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        known, wide = (Vocabulary(lambda found, m=m: packed(decide(m, found))) if own.constant is None else None for m in ([own.alone, own.often], [own.alone]))
        for batch, data, offsets in blocks(batches, "_text"):
            n = len(offsets) - 1
            if own.constant is not None:
                p = own.probability(np.zeros((n, 1)))
            else:
                letters, bounds, row, head = cut(data, offsets)
                alone, often = unpacked(known(letters, bounds[:-1], bounds[1:], range_hashes(letters, bounds[:-1], bounds[1:])))
                first, last = joined(bounds, head)
                more, _ = unpacked(wide(letters, bounds[first], bounds[last], range_hashes(letters, bounds[first], bounds[last])))
                p = own.probability(features(n, row, alone, often, row[first], more))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in others], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*others, "_score", "_predicted"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in others) + ", _score double, _predicted int"
    found = rows.mapInArrow(work, schema)
    return found.select(F.col("_id").alias("doc_id"), F.col("_out").alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"),
                        *[F.col(f"_keep_{k}").alias(f"keep_{k}") for k in keep])


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """Documents that are not found toxic, with all their columns."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    numbered = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    found = score(numbered, model, names["doc_id"], names["text"], keep=tuple(names.values()))
    return found.filter("predicted = 0").select(*[F.col(f"keep_{n}").alias(c) for c, n in names.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
