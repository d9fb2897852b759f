"""Periodic runs of words by the tandem-repeat method of Gusfield and Stoye.

A run is a stretch of words with smallest period q (words q apart are equal) that no
neighbouring word extends. Found are those of at least `min_length` words and
`min_exponent` periods, in every whole text.

Per bounded chunk of rows:

1. Stretches that can hold a run are cut out. A run with at least `min_length` words and
   `min_exponent` periods is covered by windows of g words that stand in the text twice,
   and holds one that stands there three times, for g as in `_window`. Windows are told
   apart by hash, so this can only let too much through. All other words part stretches.
2. The stretches, each closed by a sign of its own, form one text over integers that
   stand for exactly equal words. Prefix doubling gives the rank of every factor of 1, 2,
   4, ... words; so the longest common extension of many pairs of places, forwards or
   backwards, is a few vectorised steps. The order of the suffixes and the common prefixes
   of neighbours are the suffix tree: a place in it is an interval of suffixes and a depth.
3. Lempel-Ziv blocks: the second half of a square's leftmost occurrence starts in one block
   and ends in it or in the next, so extensions around the block borders give squares that
   cover all leftmost occurrences.
4. Walks complete the vocabulary: the suffix link of a square leads to its words without
   the first, and if these go on there with that first word, this is the next rotation, a
   square as well. A walk ends at a place already marked. Squares of squares are left out.
5. The suffixes below each marked place are all occurrences; occurrences of one period at
   neighbouring places merge into runs.

A text is worked off in one task: rows are spread over the cluster, and a text of n words
needs O(n log n) time and memory. Nothing is shuffled.

Defined results: a null or blank text has no words and no run; repeated rows and rows that
share a doc_id, null included, give a row each; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels
from .kernels import U

MIN_LENGTH = 24
MIN_EXPONENT = 3

_FOUND = "doc_id long, n_words long, n_dropped long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class SuffixTree:
    """Suffixes of an integer text in order, with the ranks of its factors of 2^k values.
    The last value must occur once."""

    def __init__(self, text: np.ndarray):
        self.text, n, step = text, len(text), 1
        rank = np.unique(text, return_inverse=True)[1]
        self.levels = [rank.astype(np.int32)]
        while True:
            key = rank.astype(np.int64) * (n + 1)
            key[: n - step] += rank[step:] + 1
            order = np.argsort(key)
            ordered = key[order]
            new = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
            rank = np.empty(n, dtype=np.int64)
            rank[order] = new
            self.levels.append(rank.astype(np.int32))
            step *= 2
            if new[-1] == n - 1:
                break
        self.order, self.rank = order, rank
        self.common = np.zeros(n, dtype=np.int64)  # with the suffix before it in order
        self.common[1:] = self.ahead(order[:-1], order[1:])
        self.least = [self.common]  # of 2^k neighbours up to each
        while 2 << (len(self.least) - 1) <= n:
            have, w = self.least[-1], 1 << (len(self.least) - 1)
            more = have.copy()
            more[w:] = np.minimum(have[w:], have[:-w])
            self.least.append(more)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal values from places i and j on (i differs from j)."""
        i, j = i.astype(np.int64), j.astype(np.int64)
        start = i.copy()
        for k in reversed(range(len(self.levels))):
            step = (self.levels[k][i] == self.levels[k][j]).astype(np.int64) << k
            i += step
            j += step
        return i - start

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal values up to places i and j, these included."""
        i, j = i.astype(np.int64) + 1, j.astype(np.int64) + 1
        end = i.copy()
        for k in reversed(range(len(self.levels))):
            a, b = i - (1 << k), j - (1 << k)
            same = (a >= 0) & (b >= 0)
            same &= self.levels[k][np.maximum(a, 0)] == self.levels[k][np.maximum(b, 0)]
            i -= same.astype(np.int64) << k
            j -= same.astype(np.int64) << k
        return end - i

    def locus(self, i: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last of the suffixes that start with the `depth` values at i."""
        first, last, n = self.rank[i].copy(), self.rank[i].copy(), len(self.text)
        for k in reversed(range(len(self.least))):
            step = 1 << k
            # common[first - step + 1 .. first] all at least depth: then the suffix `step` before shares the values
            ok = (first >= step) & (self.least[k][first] >= depth)
            first -= ok * step
            to = np.minimum(last + step, n - 1)
            ok = (last + step < n) & (self.least[k][to] >= depth)
            last += ok * step
        return first, last


def _blocks(tree: SuffixTree) -> np.ndarray:
    """Where the Lempel-Ziv blocks start, and the length of the text: each block is the longest
    stretch that also starts earlier, or one value."""
    n = len(tree.text)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    ranks, left, right = tree.rank.tolist(), [0] * n, [0] * n
    for i in range(n - 1, -1, -1):  # unlink the suffixes from the last place on: neighbours left start earlier
        r = ranks[i]
        a, b = before[r], after[r]
        left[i], right[i] = a, b
        if a >= 0:
            after[a] = b
        if b < n:
            before[b] = a
    longest = np.zeros(n, dtype=np.int64)
    for side in (np.array(left), np.array(right)):
        at = np.flatnonzero((side >= 0) & (side < n))
        longest[at] = np.maximum(longest[at], tree.ahead(at, tree.order[side[at]]))
    starts, i, step = [], 0, np.maximum(longest, 1).tolist()
    while i < n:
        starts.append(i)
        i += step[i]
    return np.array(starts + [n], dtype=np.int64)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the counted things, whose it is and which (from 0)."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def _covering_squares(tree: SuffixTree, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, half) of squares among which are the leftmost occurrence of every square, or a
    rotation to the left of it. longest: no half is longer."""
    starts = _blocks(tree)
    h, h1 = starts[:-1], starts[1:]
    size, n, text = h1 - h, len(tree.text), tree.text
    h2 = np.append(h1[1:], n)
    # the square ends in the next block: pairs of places around the border between the two
    of, k = _spread(np.minimum(size, longest) * (h1 < n))
    k = k + 1
    q = h1[of] - k
    ok = text[q] == text[h1[of]]
    k, q, b = k[ok], q[ok], h1[of][ok]
    k1, k2 = tree.ahead(q, b), np.zeros(len(q), dtype=np.int64)
    inner = q > 0
    k2[inner] = tree.behind(q[inner] - 1, b[inner] - 1)
    found = k1 + k2 >= k
    first = [np.maximum(q - k2, q - k + 1)[found]]
    half = [k[found]]
    # the square starts before the block and its centre lies in it
    of, k = _spread(np.minimum(h2 - h, longest) * (h > 0))
    k = k + 1
    ok = h[of] + k < n
    of, k = of[ok], k[ok]
    a, q, end = h[of], h[of] + k, h1[of]
    ok = (text[a] == text[q]) & (text[a - 1] == text[q - 1])
    a, q, k, end = a[ok], q[ok], k[ok], end[ok]
    k1, k2 = tree.ahead(a, q), tree.behind(a - 1, q - 1)
    start = np.maximum(a - k2, a - k + 1)
    found = (k1 + k2 >= k) & (start + k <= end)
    first.append(start[found])
    half.append(k[found])
    return np.concatenate(first), np.concatenate(half)


def _primitive(tree: SuffixTree, i: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the q values at i, the first half of a square, are no power of fewer ones."""
    out, rest, p = np.ones(len(q), dtype=bool), q.copy(), 2
    while len(at := np.flatnonzero(out & (rest > 1))):
        if p * p > rest[at].max():
            factor = rest[at]  # a prime for all that is left
            step = q[at] // factor
            out[at] &= tree.ahead(i[at], i[at] + step) < 2 * q[at] - step
            break
        hit = at[rest[at] % p == 0]
        if len(hit):
            step = q[hit] // p
            out[hit] &= tree.ahead(i[hit], i[hit] + step) < 2 * q[hit] - step
            while len(hit):
                rest[hit] //= p
                hit = hit[rest[hit] % p == 0]
        done = at[(rest[at] > 1) & (rest[at] < p * p)]
        if len(done):
            step = q[done] // rest[done]
            out[done] &= tree.ahead(i[done], i[done] + step) < 2 * q[done] - step
            rest[done] = 1
        p += 1
    return out


def _distinct(key: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    key, at = np.unique(key, return_index=True)
    return key, *[x[at] for x in more]


def _vocabulary(tree: SuffixTree, i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, half) of the places of all squares that walks from the given ones reach."""
    n, text = len(tree.text), tree.text
    key_of = lambda place, half: tree.locus(place, 2 * half)[0] * (n + 1) + half
    marked, places, halves = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    left = q.copy()
    while len(i):
        key, i, q, left = _distinct(key_of(i, q), i, q, left)
        fresh = ~np.isin(key, marked, assume_unique=True)
        i, q, left = i[fresh], q[fresh], left[fresh]
        if not len(i):
            break
        # as far as this occurrence goes on with period q, each step of the walk is one place on
        m = np.minimum(tree.ahead(i, i + q) - q + 1, left)
        of, step = _spread(m)
        new, half = i[of] + step, q[of]
        marked, places, halves = _distinct(np.append(marked, key_of(new, half)), np.append(places, new), np.append(halves, half))
        # beyond, the suffix link leads to other occurrences of the words without the first
        more = left > m
        at, q, left = (i + m - 1)[more], q[more], (left - m)[more]
        first, last = tree.locus(at + 1, 2 * q - 1)
        sought, lo, hi = text[at], first.copy(), last.copy()
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            less = text[tree.order[mid] + 2 * q - 1] < sought
            lo, hi = np.where(less & (lo < hi), mid + 1, lo), np.where(less | (lo >= hi), hi, mid)
        i = tree.order[lo]
        there = text[i + 2 * q - 1] == sought
        i, q, left = i[there], q[there], left[there]
    first, last = tree.locus(places, 2 * halves)
    return first, last, halves


def find_runs(text: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of an integer text, by start, then period; its last
    value must occur once. min_exponent: 2 at least."""
    if len(text) < 3:
        return (np.zeros(0, dtype=np.int64),) * 3
    tree = SuffixTree(text)
    i, q = _covering_squares(tree, len(text) // min_exponent)
    prime = _primitive(tree, i, q)
    first, last, half = _vocabulary(tree, i[prime], q[prime])
    of, step = _spread(last - first + 1)
    half, place = half[of], tree.order[first[of] + step]
    order = np.lexsort((place, half))
    half, place = half[order], place[order]
    cut = np.append(True, (half[1:] != half[:-1]) | (place[1:] != place[:-1] + 1))[: len(half)]
    heads = np.flatnonzero(cut)
    start, period = place[heads], half[heads]
    length = np.append(heads[1:], len(half)) - heads - 1 + 2 * period
    ok = length >= np.maximum(min_length, min_exponent * period)
    start, length, period = start[ok], length[ok], period[ok]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _window(min_length: int, min_exponent: int) -> int:
    """Words g such that a run of L >= min_length words and L >= min_exponent * q has L - 2q >= g:
    then its first g words stand at q and 2q as well, and any g of its words stand q to the left
    or to the right within it."""
    return min_length * (min_exponent - 2) // min_exponent


def _stretches(w: kernels.Words, g: int, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) words of the stretches that can hold a run."""
    n = len(w.start)
    covered = np.zeros(n + 1, dtype=np.int64)
    thrice = np.zeros(n + 1, dtype=np.int64)
    if g < 1:
        covered[:-1], thrice[1:] = 1, np.arange(1, n + 1)
    elif n >= g:
        at = np.flatnonzero(kernels.same_row(w.row, g))
        key = kernels.mix(kernels.run_hashes(kernels.word_hashes(w), g)[at] + w.row[at].astype(U) * U(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        ordered = key[order]
        heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
        times = np.repeat(np.diff(np.append(heads, len(ordered))), np.diff(np.append(heads, len(ordered))))
        at, times = at[order], times[:]
        twice = at[times > 1]
        np.add.at(covered, twice, 1)
        np.subtract.at(covered, twice + g, 1)
        covered = np.cumsum(covered)
        mark = np.zeros(n, dtype=np.int64)
        mark[at[times > 2]] = 1
        thrice[1:] = np.cumsum(mark)
    inside = covered[:-1] > 0
    change = w.row[1:] != w.row[:-1]
    begins = np.flatnonzero(inside & np.append(True, ~inside[:-1] | change)[:n])
    ends = np.flatnonzero(inside & np.append(~inside[1:] | change, True)[:n]) + 1
    ok = (ends - begins >= min_length) & (thrice[ends] > thrice[begins])
    return begins[ok], ends[ok]


def _find(min_length: int, min_exponent: int):
    g = _window(min_length, min_exponent)

    def find(batches):
        for chunk in kernels.chunks(batches):
            data, off = kernels.utf8(chunk.column("text"))
            w = kernels.find_words(data, off)
            first, end = _stretches(w, g, min_length)
            start = length = period = np.zeros(0, dtype=np.int64)
            if len(first):
                of, step = _spread(end - first + 1)
                sign = step == (end - first)[of]
                at = first[of] + step
                text = np.empty(len(of), dtype=np.int64)
                codes = kernels.pick(w, at[~sign]).dictionary_encode()
                text[~sign] = codes.indices.to_numpy()
                text[sign] = len(codes.dictionary) + np.arange(len(first))
                start, length, period = find_runs(text, min_length, min_exponent)
                start = at[start]  # words of the chunk
                order = np.lexsort((period, start))
                start, length, period = start[order], length[order], period[order]
            drop = np.zeros(len(w.start) + 1, dtype=np.int64)
            np.add.at(drop, start + period, 1)
            np.subtract.at(drop, start + length, 1)
            kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
            row = w.row[start]
            edges = np.searchsorted(row, np.arange(chunk.num_rows + 1)).astype(np.int32)
            runs = pa.StructArray.from_arrays([pa.array(start - w.first[row]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
            n_words = np.diff(w.first[: chunk.num_rows + 1])
            n_kept = np.bincount(w.row[kept], minlength=chunk.num_rows)[: chunk.num_rows]
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(n_words), pa.array(n_words - n_kept), pa.ListArray.from_arrays(pa.array(edges), runs), kernels.joined(w, kept, chunk.num_rows)],
                names=["doc_id", "n_words", "n_dropped", "runs", "collapsed"],
            )

    return find


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """One row per document: doc_id, n_words, n_dropped, runs (by start, then period; places and
    lengths in words) and collapsed, the words that no run holds after its first period, joined
    by a blank."""
    if min_exponent < 2:
        raise ValueError("min_exponent must be 2 or more")
    return docs.select("doc_id", "text").mapInArrow(_find(min_length, min_exponent), _FOUND)
