"""Periodic runs of words, found with minimizers at several scales.

A run is a maximal stretch of words with smallest period q and at least 2 q and
``MIN_WORDS`` words. Periods below ``3 * FIRST`` are found by comparing all words
with those q places on (direct lag scans). Longer ones are found scale by scale:

* At scale t a window of t + 1 neighbouring t-word pieces chooses its smallest
  hash; a position is a minimizer if it, or the piece t words on, is the least of
  its window. Inside a run the windows repeat at the distance of the period, so
  do the minimizers: positions x and x + q with equal 2 t words, for every run of
  a period from 3 t up to 6 t.
* Pieces that have a period of t / 3 or less themselves take no part: their runs
  are known from smaller scales, and without them equal minimizers are more than
  t / 3 words apart, so each is compared with a few next ones, however often a
  passage repeats. A run whose halves lie in two such short-period runs has
  no minimizer; it is sought from the place where these two meet.
* Each pair that fits at sample places is extended word by word to both sides.

All documents of a block are searched together, in one array with a separator
between them that equals nothing. Every run is found, and none twice.
"""

from __future__ import annotations

from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import named, packed, unpacked

MIN_WORDS = 12
# The smallest piece; periods below three of it are scanned directly.
FIRST = 8
ADDED = ["runs", "collapsed"]
SAMPLES = 8
BLOCK_BYTES = 2 << 20
RUNS = "array<struct<start:long,length:long,period:long>>"
C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of joined pieces from the hashes of both parts."""
    x = a * C1 + b
    x ^= x >> np.uint64(32)
    return x * C2


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by their first position."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def agreeing(words: np.ndarray, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
    """How many words from places x and y on are equal, forwards or backwards."""
    found = np.zeros(len(x), np.int64)
    alive = np.arange(len(x))
    chunk, last = 16, len(words) - 1
    while len(alive):
        way = found[alive, None] + np.arange(chunk)
        one = np.clip(x[alive, None] + step * way, 0, last)
        two = np.clip(y[alive, None] + step * way, 0, last)
        differ = words[one] != words[two]
        ends = differ.any(axis=1)
        found[alive] += np.where(ends, differ.argmax(axis=1), chunk)
        alive = alive[~ends]
        chunk = max(16, min(2 * chunk, (1 << 20) // max(len(alive), 1)))
    return found


class Search:
    """The runs of documents given as one array of word numbers.

    ``words`` begins and ends with a separator and has one between documents;
    all separators differ. ``ends`` are the places of the separators. Documents
    come in falling length, so those long enough for a scale are in front.
    """

    def __init__(self, words: np.ndarray, ends: np.ndarray) -> None:
        self.words, self.ends = words, ends
        self.sizes = np.diff(ends) - 1
        self.start = self.length = self.period = np.zeros(0, np.int64)

    def front(self, least_words: int) -> int:
        """Length of the part that holds the documents of so many words."""
        n = np.searchsorted(-self.sizes, -least_words, "right")
        return int(self.ends[n]) + 1

    def add(self, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> None:
        """Take stretches up; of the periods of one stretch the least stays."""
        start = np.concatenate([self.start, start])
        length = np.concatenate([self.length, length])
        period = np.concatenate([self.period, period])
        order = np.lexsort((period, length, start))
        start, length, period = start[order], length[order], period[order]
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
        self.start, self.length, self.period = start[new], length[new], period[new]

    def scan(self, q: int) -> None:
        """All stretches of period q, by comparing words q places apart."""
        words = self.words[: self.front(max(FIRST, 2 * q))]
        if len(words) <= q:
            return
        differ = np.flatnonzero(words[:-q] != words[q:])
        before = np.concatenate([[-1], differ])
        size = np.diff(np.concatenate([before, [len(words) - q]])) - 1
        ok = size >= max(FIRST - q, q)
        self.add(before[ok] + 1, size[ok] + q, np.full(ok.sum(), q))

    def pairs(self, t: int, hashes: np.ndarray, twice: np.ndarray) -> list[np.ndarray]:
        """Pairs (x, q) of minimizers with equal words, 3 t to 6 t apart."""
        value = hashes >> np.uint64(1)
        for s, n in self.short(t, t):
            value[s : s + n - t + 1] = NEVER
        small = least(value, t + 1)
        at = np.flatnonzero(
            ((value[: len(small)] == small) | (value[t : t + len(small)] == small)) & (small != NEVER)
        )
        key = twice[at]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        found, r = [], 1
        while r < len(at):
            apart = at[r:] - at[:-r]
            near = (key[r:] == key[:-r]) & (apart < 6 * t)
            if not near.any():
                break
            near &= apart >= 3 * t
            found.append(np.stack([at[:-r][near], apart[near]]))
            r += 1
        return found

    def short(self, t: int, size: int) -> list[tuple[int, int]]:
        """Known runs in front of at least ``size`` words and a period of t / 3."""
        ok = (3 * self.period <= t) & (self.length >= size) & (self.start < self.front(6 * t))
        return list(zip(self.start[ok].tolist(), self.length[ok].tolist()))

    def meetings(self, t: int) -> list[np.ndarray]:
        """Pairs (x, q) where two runs of one short period meet out of step."""
        ok = np.flatnonzero((3 * self.period <= t) & (self.length >= 3 * t))
        ok = ok[np.lexsort((self.start[ok], self.period[ok]))]
        found = []
        for one, two in zip(ok[:-1], ok[1:]):
            d, a, b = int(self.period[one]), int(self.start[one]), int(self.start[two])
            if self.period[two] != d or b > a + self.length[one]:
                continue
            room = min(int(self.length[one]), int(self.length[two]), 6 * t - 1)
            for q in range(3 * t, min(3 * t + d, room + 1)):
                x = max(a, b - q)
                if np.array_equal(self.words[x : x + d], self.words[x + q : x + q + d]):
                    lags = np.arange(q, room + 1, d)
                    found.append(np.stack([np.maximum(a, b - lags), lags]))
        return found

    def extend(self, x: np.ndarray, q: np.ndarray) -> None:
        """Take up the stretches of period q around the places x."""
        words, last = self.words, len(self.words) - 1
        half = (q - 1) // 2
        right, left = np.ones(len(x), bool), np.ones(len(x), bool)
        for k in range(SAMPLES + 1):
            way = half * k // SAMPLES
            right &= words[np.minimum(x + way, last)] == words[np.minimum(x + way + q, last)]
            left &= words[np.maximum(x - way, 0)] == words[np.maximum(x - way + q, 0)]
        ok = right | left
        x, q = x[ok], q[ok]
        doc = np.searchsorted(self.ends, x)
        order = np.lexsort((x, q, doc))
        x, q, doc = x[order], q[order], doc[order]
        while len(x):
            first = np.ones(len(x), bool)
            first[1:] = (doc[1:] != doc[:-1]) | (q[1:] != q[:-1])
            group = np.cumsum(first) - 1
            a, b = x[first], q[first]
            after = a + agreeing(words, a, a + b, 1)
            before = a - agreeing(words, a - 1, a + b - 1, -1)
            long = after - before >= b
            self.add(before[long], (after - before + b)[long], b[long])
            rest = x >= np.maximum(after, a + 1)[group]
            x, q, doc = x[rest], q[rest], doc[rest]

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        for q in range(1, 3 * FIRST):
            self.scan(q)
        t = 1
        hashes = mixed(self.words.astype(np.uint64) ^ C2, C1)
        while t < FIRST:
            hashes = mixed(hashes[:-t], hashes[t:])
            t *= 2
        while self.sizes.max(initial=0) >= 6 * t:
            hashes = hashes[: self.front(6 * t) - t + 1]
            twice = mixed(hashes[:-t], hashes[t:])
            found = self.pairs(t, hashes, twice) + self.meetings(t)
            if found:
                self.extend(*np.concatenate(found, axis=1))
            hashes, t = twice, 2 * t
        long = self.length >= MIN_WORDS
        return self.start[long], self.length[long], self.period[long]


def collapsed(texts: list[bytes]) -> tuple[list[np.ndarray], list[bytes]]:
    """Per text its runs (start, length, period) and the words that stay."""
    split = [t.split() for t in texts]  # bytes split at ASCII white space alone
    order = sorted(range(len(split)), key=lambda d: -len(split[d]))
    flat = list(chain.from_iterable(split[d] for d in order))
    numbers = dict(zip(dict.fromkeys(flat), range(len(flat))))
    sizes = np.array([len(split[d]) for d in order], np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes + 1)])
    words = np.empty(len(flat) + len(ends), np.int64)
    inside = np.ones(len(words), bool)
    inside[ends] = False
    words[inside] = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
    words[ends] = -1 - np.arange(len(ends))
    start, length, period = Search(words, ends).run()

    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    stays = np.cumsum(edges)[:-1] == 0
    rank = np.lexsort((period, start))
    start, length, period = start[rank], length[rank], period[rank]
    cut = np.searchsorted(start, ends)
    runs: list[np.ndarray] = [None] * len(split)
    out: list[bytes] = [None] * len(split)
    for k, d in enumerate(order):
        i, j, base = cut[k], cut[k + 1], ends[k] + 1
        runs[d] = np.stack([start[i:j] - base, length[i:j], period[i:j]], axis=1)
        kept = split[d] if i == j else compress(split[d], stays[base : ends[k + 1]])
        out[d] = b" ".join(kept)
    return runs, out


def blocks(texts: list[bytes], size: int = BLOCK_BYTES):
    """Slices of the texts with about ``size`` bytes; a longer text is alone."""
    first = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield texts[first:i]
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield texts[first:]


def searched(text: pa.Array) -> pa.Array:
    texts = [t or b"" for t in text.cast(pa.binary()).to_pylist()]
    runs, out = [], []
    for part in blocks(texts):
        a, b = collapsed(part)
        runs += a
        out += b
    flat = np.concatenate([*runs, np.zeros((0, 3), np.int64)])
    ends = np.cumsum([0] + [len(r) for r in runs])
    rows = pa.StructArray.from_arrays(
        [pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"]
    )
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)
    kept = pa.array(out, pa.binary()).cast(pa.string())
    return pa.StructArray.from_arrays([lists, kept], ["runs", "collapsed"])


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """Every row with the runs of its text and the text without repetitions.

    Adds ``runs`` (start, length and period in words, by start, then period) and
    ``collapsed``: the words, joined by one space, that no run contains after its
    first period. Input columns of these names are replaced. Words are stretches
    without ASCII white space. A null or empty text has no runs and collapses to
    the empty text; null keys and repeated rows are rows like others; an empty
    table gives an empty result. One pass, no shuffle; a task holds one block of
    texts (``BLOCK_BYTES``, or one longer text) and about 100 bytes for each of
    its words.
    """
    search = F.arrow_udf(searched, f"struct<runs:{RUNS},collapsed:string>")
    rows = df.select(packed(df), search(named(text)).alias("_found"))
    return rows.select(
        *unpacked(df.columns, ADDED), F.col("_found.runs"), F.col("_found.collapsed")
    )
