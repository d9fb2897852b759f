"""Benchmark decontamination by spaced-seed hashing.

A mask names the token positions of a span that count; the others may differ. Every span
of a benchmark item and of a document is hashed under each mask, equal hashes are hits,
and the two texts are compared token by token along a hit's diagonal: a document is
contaminated where `WINDOW` aligned tokens agree but for `MAX_CHANGED`, or a whole shorter
item agrees but for as many as the masks are sure to leave room for. Tokens are runs of letters and digits, lower-cased.

The test hashes are joined inside the scan: they are handed to the tasks as a table whose
size is counted first and bounded by `BLOCK_TOKENS`. A larger benchmark is worked off in
blocks of items, one after the other: the driver and the tasks hold one block at a time,
what it finds is written, and the documents are joined with that at the end. In a task,
the pairs of document span and item span that a hash brings together are taken in slices
of `SLICE`, verified and forgotten, so a phrase that thousands of items share costs time
in proportion to its pairs but no memory.

Defined results: null or empty texts are clean; items with fewer tokens than the
shortest mask spans can't be found, nor can items without a text; an item without an id
contaminates what holds it but has no place in item_ids; rows with a null doc_id are
judged like others; repeated rows and items are judged alike; an empty benchmark leaves
all clean; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, kernels
from .kernels import U

#: Positions that count. However three of thirteen tokens are changed, one of these masks
#: still fits somewhere between the changes (the tests try all ways).
MASKS = ["111011", "1101011", "110101", "11011"]
WINDOW = 13
MAX_CHANGED = 3
BLOCK_TOKENS = 2_000_000
SLICE = 1 << 17
_BITS = 20
_OTHER = np.ones(256, dtype=bool)
_OTHER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def _tokens(texts: pa.Array) -> kernels.Words:
    data, off = kernels.utf8(pc.utf8_lower(texts))
    return kernels.find_words(data, off, _OTHER)


@functools.cache
def tolerance(span: int) -> int:
    """Tokens that may differ in an aligned window: up to MAX_CHANGED, as long as a mask is
    left to fit between the changes wherever they are."""
    fits = lambda changed: any(not any(c == "1" and at + i in changed for i, c in enumerate(m)) for m in MASKS for at in range(span - len(m) + 1))
    n = 0
    while n < min(MAX_CHANGED, span) and all(fits(set(c)) for c in itertools.combinations(range(span), n + 1)):
        n += 1
    return n


def _places(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


@dataclass
class Index:
    """Hashes of the items' spans under each mask, sorted, and the token each starts at."""

    ids: list
    token: np.ndarray  # hashes of all tokens of all items
    row: np.ndarray
    first: np.ndarray
    spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # hash, start, table of leading bits

    @classmethod
    def of(cls, ids: list, texts: list[str]) -> Index:
        w = _tokens(pa.array(texts, pa.string()))
        h, spans = kernels.word_hashes(w), []
        for mask in MASKS:
            at = np.flatnonzero(kernels.same_row(w.row, len(mask)))
            x = kernels.run_hashes(h, len(mask), _places(mask))[at]
            order = np.argsort(x, kind="stable")
            seen = np.zeros(1 << _BITS, dtype=bool)
            seen[(x >> U(64 - _BITS)).astype(np.int64)] = True
            spans.append((x[order], at[order], seen))
        return cls(ids, h, w.row, w.first, spans)


def hits(h: np.ndarray, row: np.ndarray, index: Index):
    """Slices of (document row, diagonal, item), distinct in a slice: token i of the row
    meets token i - diagonal of the items' token list."""
    for mask, (hashes, start, seen) in zip(MASKS, index.spans):
        if not len(hashes) or len(h) < len(mask):
            continue
        x = kernels.run_hashes(h, len(mask), _places(mask))
        at = np.flatnonzero(seen[(x >> U(64 - _BITS)).astype(np.int64)] & kernels.same_row(row, len(mask)))
        lo, hi = np.searchsorted(hashes, x[at], side="left"), np.searchsorted(hashes, x[at], side="right")
        at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        ends = np.cumsum(n)
        for a in range(0, int(ends[-1]) if len(ends) else 0, SLICE):
            pair = np.arange(a, min(a + SLICE, int(ends[-1])))
            k = np.searchsorted(ends, pair, side="right")
            met, own = at[k], start[lo[k] + pair - (ends[k] - n[k])]
            span = len(h) + len(index.token) + 1
            key = np.unique(((met - own) + len(index.token)) + span * (row[met] * len(index.ids) + index.row[own]))
            who = key // span
            yield who // len(index.ids), key % span - len(index.token), who % len(index.ids)


def verify(h: np.ndarray, first: np.ndarray, row: np.ndarray, diagonal: np.ndarray, item: np.ndarray, index: Index) -> np.ndarray:
    """Tokens of the best aligned window that agree, less those asked for: 0 or more means
    contaminated."""
    out = np.full(len(row), -WINDOW)
    size = index.first[item + 1] - index.first[item]
    for n in np.unique(size).tolist():
        group = np.flatnonzero(size == n)
        for i in range(0, len(group), 4096):
            g = group[i : i + 4096]
            there = index.first[item[g]][:, None] + np.arange(n)
            here = there + diagonal[g][:, None]
            inside = (here >= first[row[g]][:, None]) & (here < first[row[g] + 1][:, None])
            same = (h[np.clip(here, 0, len(h) - 1)] == index.token[there]) & inside
            span = min(WINDOW, n)
            sums = np.cumsum(np.pad(same, ((0, 0), (1, 0))), axis=1)
            out[g] = (sums[:, span:] - sums[:, : n - span + 1]).max(axis=1) - (span - tolerance(span))
    return out


def _found(texts: pa.Array, index: Index) -> list[set[int]]:
    """The items (by their place in the index) that each text holds."""
    w = _tokens(texts)
    h = kernels.word_hashes(w)
    out: list[set[int]] = [set() for _ in range(len(texts))]
    for row, diagonal, item in hits(h, w.row, index):
        good = verify(h, w.first, row, diagonal, item, index) >= 0
        for r, i in set(zip(row[good].tolist(), item[good].tolist())):
            out[r].add(i)
    return out


def _search(index: Index, all_rows: bool):
    """Adds the number of items found and their ids to all rows, or to those with any."""

    def run(batches):
        for chunk in kernels.chunks(batches):
            found = _found(chunk.column("text"), index)
            ids = [sorted({int(index.ids[i]) for i in x if index.ids[i] is not None}) for x in found]
            keep = [c for c in chunk.schema.names if all_rows or c != "text"]
            out = pa.RecordBatch.from_arrays([chunk.column(c) for c in keep] + [pa.array([len(x) for x in found], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=[*keep, "n_overlaps", "item_ids"])
            yield out if all_rows else out.filter(pa.array([bool(x) for x in found], pa.bool_()))

    return run


def _blocks(benchmark: DataFrame):
    """The indexes of the items' blocks, one at a time."""
    items = benchmark.filter("text is not null").select("item_id", "text").distinct()
    n_tokens = F.regexp_count(F.lower("text"), F.lit(r"[a-z0-9\x{80}-\x{10FFFF}]+"))
    total = items.agg(F.sum(n_tokens)).first()[0] or 0
    n = -(-total // BLOCK_TOKENS)
    for k in range(n):
        got = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        if got:
            yield n, Index.of([r.item_id for r in got], [r.text for r in got])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All rows: whole (the input row), n_overlaps (items found in it) and item_ids."""
    rows = docs.select("text", F.struct("*").alias("whole"))
    added = [T.StructField("n_overlaps", T.LongType()), T.StructField("item_ids", T.ArrayType(T.LongType()))]
    keyed, parts = docs.select(common.row_key().alias("row_key"), "text"), []
    for n, index in _blocks(benchmark):
        if n == 1:
            return rows.mapInArrow(_search(index, True), T.StructType([*rows.schema.fields, *added])).drop("text")
        parts.append(common.materialise(keyed.mapInArrow(_search(index, False), T.StructType([keyed.schema.fields[0], *added])).dropDuplicates(["row_key"])))
    none = F.array().cast("array<bigint>")
    if not parts:
        return rows.select("whole", F.lit(0).cast("long").alias("n_overlaps"), none.alias("item_ids"))
    found = functools.reduce(DataFrame.union, parts).groupBy("row_key").agg(F.sum("n_overlaps").alias("n_overlaps"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    out = rows.withColumn("row_key", common.row_key()).join(found.hint("merge"), "row_key", "left")
    return out.select("whole", F.coalesce("n_overlaps", F.lit(0)).cast("long").alias("n_overlaps"), F.coalesce("item_ids", none).alias("item_ids"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The clean rows, with all their columns."""
    return contamination(docs, benchmark).filter("n_overlaps = 0").select("whole.*")
