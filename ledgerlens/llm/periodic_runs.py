"""Runs of periodic words in whole texts, by internal pattern matching.

A run is a maximal stretch of words with smallest period q that is at least ``max(MIN_LENGTH, REPEATS * q)`` long.
Prefix doubling sorts the suffixes and names, on the way, all stretches of 2^k words; a name is an interval of the suffix
array. For every k the stretches at multiples of B = 2^k are patterns: a wavelet matrix over the suffix array answers, for all of
them at once, where a pattern occurs first and last, and how often, in the next B places and in the B after those (a range successor is
a count and a selection). Within B places occurrences form an arithmetic progression: one or two give their distance as
candidate period; three or more with difference p give the distance between the ends of the p-periodic stretches around the
pattern and around the progression.

A run of period q is found by the k with B <= q < 2B (B = 8 for shorter ones, as a run has 24 words): the first pattern in it lies, with its copy
q words on, within the run. Nearer occurrences hide that copy only if the pattern has a period p <= B / 2; then the copy lies in another p-periodic
stretch, and the run, of three periods, holds the break at both left ends or at both right ends. A candidate is extended to both sides by
comparing hashes, and the whole run is then compared word by word (and extended so, if hashes were wrong).

Texts in which no 16 words recur have no run, as one repeats 16 words at least; the others are searched many at a time, with a
word of its own between two texts. Memory follows the longest text: about 60 bytes a word.

Edge cases: null and empty texts have no words, no runs and an empty collapsed text; white space is ASCII white space; repeated rows and
rows with a null id are texts of their own; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_batches
from .token_files import blocks

MIN_LENGTH, REPEATS = 24, 3
LEAST = 3                       # patterns have 2^3 words at least
BLOCK_BYTES = 8 << 20
#: Texts are searched together up to so many words (or one longer text alone).
TOGETHER = 1 << 17


class WaveletMatrix:
    """Counts and selections by value in any range of a list of numbers below 2^bits; a bit and a half for each number and level."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            packed = np.zeros(len(values) // 64 + 1, np.uint64)
            raw = np.packbits(one, bitorder="little")
            packed.view(np.uint8)[:len(raw)] = raw
            before = np.cumsum(np.bitwise_count(packed), dtype=np.int64) - np.bitwise_count(packed)
            values = np.concatenate([values[~one], values[one]])
            self.levels.append((bit, packed, before, len(one) - int(one.sum())))

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(packed[word] & below)

    def count_below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of [lo, hi) are below ``bound``."""
        found = np.zeros(len(lo), np.int64)
        for bit, packed, before, zeros in self.levels:
            a, b = self._ones(packed, before, lo), self._ones(packed, before, hi)
            one = (bound >> bit) & 1 == 1
            found += np.where(one, (hi - b) - (lo - a), 0)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return found

    def select(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank k (from 0) in [lo, hi)."""
        value = np.zeros(len(lo), np.int64)
        for bit, packed, before, zeros in self.levels:
            a, b = self._ones(packed, before, lo), self._ones(packed, before, hi)
            none = (hi - b) - (lo - a)
            one = k >= none
            k = np.where(one, k - none, k)
            value |= np.where(one, np.int64(1) << bit, 0)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return value


def patterns(words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and (place, length, lo, hi) of the stretches of 2^k words at multiples of 2^k that occur more than once."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    found, k, length = [], 0, 1
    while True:
        if length == 1:
            key = rank
        else:
            second = np.zeros(n, np.int64)
            second[:n - length // 2] = rank[length // 2:] + 1
            key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        first = np.ones(n, bool)
        first[1:] = np.diff(key[order]) != 0
        starts = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        rank = np.empty(n, np.int64)
        rank[order] = starts[group]
        if k >= LEAST:
            place = np.arange(0, n - length + 1, length)
            lo = rank[place]
            hi = np.append(starts, n)[group[lo] + 1]
            many = hi - lo > 1
            found.append(np.stack([place, np.full(len(place), length), lo, hi])[:, many])
        if len(starts) == n or length >= n:
            return order, found
        length, k = 2 * length, k + 1


class Extender:
    """How far words agree to the right and to the left of two places; never too short, as equal words have equal hashes."""

    def __init__(self, words: np.ndarray):
        n, rng = len(words), np.random.default_rng(20)
        self.n = n
        base = np.full(n + 1, 0x9E3779B97F4A7C15, np.uint64)
        base[0] = 1
        self.power = np.cumprod(base)
        value = rng.integers(1, 1 << 63, int(words.max()) + 1, dtype=np.uint64)[words]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * self.power[:n])])

    def _grow(self, a: np.ndarray, d: np.ndarray, most: np.ndarray, side: int) -> np.ndarray:
        """Greatest m <= most so that m words from a (side 1) or up to a (side -1) equal those d further on."""
        m, shift = np.zeros(len(a), np.int64), self.power[d]
        step = 1 << int(most.max(initial=0)).bit_length()
        while step := step >> 1:
            to = m + step
            able = to <= most
            end = np.where(able, a + side * to, a)
            x = (self.sums[end] - self.sums[a]) * shift
            y = self.sums[end + d] - self.sums[a + d]
            m = np.where(able & (x == y), to, m)
        return m

    def stretch(self, a: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the longest stretch around a that keeps period d."""
        return a - self._grow(a, d, a, -1), a + d + self._grow(a, d, self.n - a - d, 1)


def _extend(words: np.ndarray, a: int, d: int) -> tuple[int, int]:
    """The same, word by word."""
    differ = np.flatnonzero(words[:-d] != words[d:])
    at = np.searchsorted(differ, a)
    return (int(differ[at - 1]) + 1 if at else 0), (int(differ[at]) if at < len(differ) else len(words) - d) + d


def candidates(words: np.ndarray, ext: Extender) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances, among them one of every run."""
    n = len(words)
    suffixes, found = patterns(words)
    if not found or not sum(x.shape[1] for x in found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, size, lo, hi = np.concatenate(found, axis=1)
    matrix = WaveletMatrix(suffixes, n.bit_length())
    out = []
    for near in (True, False):
        x = np.minimum(place + 1 if near else place + size + 1, n)
        below = matrix.count_below(lo, hi, x)
        count = matrix.count_below(lo, hi, np.minimum(x + size, n)) - below
        some = count > 0
        i, c, a, b, k = place[some], count[some], lo[some], hi[some], below[some]
        f, g = matrix.select(a, b, k), matrix.select(a, b, k + c - 1)
        out += [(i, f - i), (i, g - i)]
        many = c > 2
        i, f, p = i[many], f[many], (g - f)[many] // (c[many] - 1)
        left, right = ext.stretch(i, p)
        left2, right2 = ext.stretch(f, p)
        out += [(i, left2 - left), (i, right2 - right)]
    a, d = (np.concatenate(x) for x in zip(*out))
    good = (d > 0) & (a + d < n)
    return a[good], d[good]


def find_runs(words: np.ndarray, min_length: int = MIN_LENGTH, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """All runs of a list of word numbers (from 0) as (start, length, period), by start, then period."""
    if min_length < 3 << LEAST or repeats < 3:
        raise ValueError("runs of 24 words and three periods at least are found")
    if len(words) < min_length:
        return []
    ext = Extender(words)
    a, d = candidates(words, ext)
    if not len(a):
        return []
    start, end = ext.stretch(a, d)
    long = end - start >= np.maximum(min_length, repeats * d)
    rows = np.unique(np.stack([start, end, d, a])[:, long], axis=1)
    found: dict[tuple[int, int], int] = {}
    last = None
    for s, e, q, i in rows.T.tolist():
        if (s, e, q) == last:
            continue
        last = (s, e, q)
        if not np.array_equal(words[s:e - q], words[s + q:e]):
            s, e = _extend(words, i, q)
            last = None
        if e - s >= max(min_length, repeats * q):
            found[s, e] = min(q, found.get((s, e), q))
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def may_have_runs(words: np.ndarray, of: np.ndarray, texts: int, width: int = 16) -> np.ndarray:
    """Which of fewer than 2^20 texts hold some ``width`` words (a power of two) twice, or two with the same hash; words and the
    numbers of their texts come one after the other."""
    out = np.zeros(texts, bool)
    if len(words) <= width:
        return out
    h = np.random.default_rng(16).integers(1, 1 << 63, int(words.max()) + 1, dtype=np.uint64)[words]
    step = 1
    while step < width:
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + (h[step:] ^ (h[step:] >> np.uint64(29)))
        step *= 2
    low = np.uint64(0xFFFFF)
    inside = of[:len(h)] == of[width - 1:]
    h = np.sort(((h * np.uint64(0xD6E8FEB86659FD93) & ~low) | of[:len(h)].astype(np.uint64))[inside])
    out[(h[1:][h[1:] == h[:-1]] & low).astype(np.int64)] = True
    return out


def runs_of_texts(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of several texts, given as word numbers."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    long = [i for i, t in enumerate(texts) if len(t) >= MIN_LENGTH]
    size = 1 << 19
    some: list[int] = []
    for part in (long[i:i + size] for i in range(0, len(long), size)):
        lengths = [len(texts[i]) for i in part]
        may = may_have_runs(np.concatenate([texts[i] for i in part]), np.repeat(np.arange(len(part)), lengths), len(part))
        some += [part[i] for i in np.flatnonzero(may)]
    held: list[int] = []
    full = 0
    for i in [*some, None]:
        if held and (i is None or full + len(texts[i]) > TOGETHER):
            apart = max(int(texts[j].max()) for j in held) + 1
            joined = np.concatenate([x for k, j in enumerate(held) for x in (texts[j], [apart + k])])
            starts = np.cumsum([0, *(len(texts[j]) + 1 for j in held)])
            runs = find_runs(joined)
            at = np.searchsorted(starts, [r[0] for r in runs], "right") - 1
            for k, (s, length, q) in zip(at.tolist(), runs):
                out[held[k]].append((s - int(starts[k]), length, q))
            held, full = [], 0
        if i is not None:
            held.append(i)
            full += len(texts[i])
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        drop[s + q] += 1
        drop[s + length] -= 1
    kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()
    return b" ".join([words[i] for i in kept])


def collapse_runs(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per text ``runs`` (start, length, period; by start, then period) and the ``collapsed`` text."""
    text_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    fields = ["start", "length", "period"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, BLOCK_BYTES):
            number: defaultdict[bytes, int] = defaultdict(lambda: len(number))
            words = [(t or b"").split() for t in b.column(1).cast(pa.large_binary()).to_pylist()]
            runs = runs_of_texts([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in words])
            flat = np.array([r for x in runs for r in x], np.int64).reshape(-1, 3)
            ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
            rows = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields))
            text_out = pa.array([collapse(w, r) for w, r in zip(words, runs)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), rows, text_out], names=["id", "runs", "collapsed"])
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    return docs.mapInArrow(run, f"id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string"
                           ).withColumnRenamed("id", id_col)


def greatest() -> Column:
    """The run with the greatest exact length / period; ties go to the smallest start, then period."""
    better = "(r.length * s.period > s.length * r.period OR (r.length * s.period = s.length * r.period AND " \
             "(r.start < s.start OR (r.start = s.start AND r.period < s.period))))"
    return F.expr(f"reduce(runs, CAST(NULL AS STRUCT<start:BIGINT,length:BIGINT,period:BIGINT>), "
                  f"(s, r) -> CASE WHEN s IS NULL OR {better} THEN r ELSE s END)")
