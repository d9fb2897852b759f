"""Vectorised text kernels over Arrow string columns.

Every function works on the contiguous UTF-8 buffer of one bounded chunk of rows, so
the Python cost is per chunk and not per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: U, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1), base, dtype=U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 1 << 21:
            _powers[str(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit values."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(29))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of at most `max_bytes` of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        off = offsets(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + max_bytes, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def offsets(arr: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    if not len(arr):
        return np.zeros(1, dtype=np.int64)
    return np.frombuffer(arr.buffers()[1], dtype=kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows of a string column, and where each row starts."""
    off = offsets(arr)
    buf = arr.buffers()[2] if len(arr) else None
    data = np.frombuffer(buf, dtype=np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


@dataclass
class Words:
    data: np.ndarray  # UTF-8 of the chunk
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # one past its last byte
    row: np.ndarray  # row of the chunk it stands in
    first: np.ndarray  # index of the first word of each row, and the number of words

    def place(self) -> np.ndarray:
        """Place of each word in its row."""
        return np.arange(len(self.row)) - self.first[self.row]


def find_words(data: np.ndarray, off: np.ndarray, blank: np.ndarray = _BLANK) -> Words:
    inside = ~blank[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    heads = off[:-1][off[:-1] < off[1:]]
    begins[heads] = inside[heads]
    tails = off[1:][off[:-1] < off[1:]] - 1
    ends[tails] = inside[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(off, start, side="right") - 1
    return Words(data, start, end, row, np.searchsorted(row, np.arange(len(off))))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(w: Words, block: int = 1 << 17) -> np.ndarray:
    """64-bit hash of each word's bytes, worked off in blocks of words to bound memory."""
    out = np.zeros(len(w.start), dtype=U)
    for i in range(0, len(out), block):
        start, end = w.start[i : i + block], w.end[i : i + block]
        lo, hi = int(start[0]), int(end[-1])
        sums = np.zeros(hi - lo + 1, dtype=U)
        np.cumsum((w.data[lo:hi].astype(U) + U(1)) * _power(_BASE, hi - lo), out=sums[1:])
        h = (sums[end - lo] - sums[start - lo]) * _power(_INVERSE, hi - lo)[start - lo]
        out[i : i + block] = mix(h ^ ((end - start).astype(U) << U(56)))
    return out


def run_hashes(h: np.ndarray, k: int, places: range | list[int] | None = None) -> np.ndarray:
    """Hash of the k values from each position on (all but the last k - 1 positions);
    with `places`, of those among the k only."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, dtype=U)
    for j in range(k) if places is None else places:
        out += h[j : j + n] * U((0xD6E8FEB86659FD93 * (2 * j + 1) + (j << 17) * 2) & ((1 << 64) - 1) | 1)
    return mix(out)


def same_row(row: np.ndarray, k: int) -> np.ndarray:
    """Whether the k words from each position on stand in one row."""
    return row[: max(0, len(row) - k + 1)] == row[k - 1 :] if len(row) >= k else np.zeros(0, dtype=bool)


def running_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of the k values from each position on."""
    have, out = 1, x
    while have < k:
        step = min(have, k - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def pick(w: Words, at: np.ndarray) -> pa.Array:
    """The words at these places as a binary column."""
    size = w.end[at] - w.start[at]
    edges = np.append(0, np.cumsum(size))
    take = np.arange(edges[-1]) + np.repeat(w.start[at] - edges[:-1], size)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(w.data[take])])


def joined(w: Words, at: np.ndarray, n_rows: int) -> pa.Array:
    """For each row of the chunk, those of its words that stand at the places `at` (in order),
    joined by one blank."""
    row = w.row[at]
    size = w.end[at] - w.start[at]
    blank = np.append(row[1:] == row[:-1], False)[: len(at)]
    edges = np.append(0, np.cumsum(size + blank))
    out = np.full(int(edges[-1]), 32, dtype=np.uint8)
    inside = np.append(0, np.cumsum(size))
    step = np.arange(inside[-1])
    out[step + np.repeat(edges[:-1] - inside[:-1], size)] = w.data[step + np.repeat(w.start[at] - inside[:-1], size)]
    offset = edges[np.searchsorted(row, np.arange(n_rows + 1))].astype(np.int32)
    return pa.StringArray.from_buffers(n_rows, pa.py_buffer(offset), pa.py_buffer(out))


def pack(raw: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def unpack(raw: bytes, size: int) -> memoryview:
    return memoryview(pa.decompress(raw, decompressed_size=size, codec="zstd"))
