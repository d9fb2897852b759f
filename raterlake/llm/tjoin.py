"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Two documents link when percent * |union| <= 100 * |intersection| of their sets of word
shingles. Such a pair shares at least T = ceil(percent * (s + r) / (100 + percent))
shingles, so each search asks which sets occur at least T times in the inverted lists of
a query set: a heap merges the short lists and counts, the long ones are only probed by
binary search for the sets that the short ones left in reach of T (DivideSkip).

Steps
1. One pass fingerprints every set; equal sets become one node, so copies are never
   compared. It also counts the shingles that repeat inside a chunk: the most frequent of
   them are the long lists and stand last in the global order of shingles (any order is
   right; a bounded list keeps it cheap).
2. Each node posts the first s - ceil(percent * s / 100) + c shingles of that order, with
   c = s // SPARE + 1; two nodes that link share the smaller of their c at least. Postings
   travel packed by bucket, with as many buckets as their counted bytes ask for; lists with
   one node are dropped there. Long lists skip the bucket, so no task gathers one.
3. Lists of the very same nodes, as the shingles of a shared passage have them, become one
   list with their number as its weight. A node whose lists weigh less than what it would
   share with any partner is left out: it has no link.
4. Sketches: each node has counts of its shingles by hash class, a sixteenth of the set's
   size. The sum of the smaller counts bounds the overlap of a pair from above; pairs
   that can't reach T are dropped before any set travels. No link is lost by that.
5. Star round: each list names its smallest and its largest node as queries for all the
   others, linear in the postings. Verified links merge groups of near copies. Best round:
   in lists that still hold several components, each node is paired with those few whose
   sketches leave most room; this merges what the star has missed.
6. Rest round: nodes of one list that are still in different components, are of fitting
   sizes and can still reach T from the shared posting on and by their sketches, are
   searched too, so that no link between different components is missed. A link inside a
   component cannot change it and is not looked for.

Queries with many candidates are dealt out in blocks of bounded size; each block has the
inverted lists of its candidates. Tables that grow with the data are joined by sort and
merge at every size. Sets are compared as sets of 64-bit shingle hashes; a node is the
64-bit fingerprint of such a set.

Defined results: null or blank texts have an empty set and stand alone, each in its own
component; fewer words than a shingle make one short shingle; a row with a null doc_id
takes no part and has a null component; rows that share a doc_id are separate texts;
other columns are not read.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels
from .graph import components
from .kernels import U

MAX_LONG = 100_000
LONG_IN_CHUNK = 6
BUCKETS_PER_PARTITION = 4
#: Bytes of postings that a bucket holds at most, by the count before they are sent.
BUCKET_BYTES = 64 << 20
#: A node posts one more shingle for each so many it has.
SPARE = 64
#: Shingles of candidates that one block of a search holds (8 bytes each).
BLOCK = 500_000
#: Bits of the filter of sets to send: so many for each node that is searched, within limits.
#: A filter at its upper limit lets more sets through than needed, at most all.
BITS_PER_NODE = 8
FILTER_BITS = (1 << 16, 1 << 26)
#: Nodes of a list that are searched in one task, and with how many of them each is paired
#: in the best round.
PART = 4096
NEIGHBOURS = 3
#: In a sketch this count stands for itself and all above it.
MANY = 15
_POST = np.dtype([("token", U), ("node", np.int64), ("size", np.int32), ("at", np.int32)])
_POSTING = "token long, node long, size int, at int"


def least_overlap(size, percent: int):
    """Shingles that a set of this size shares with any set it links to."""
    return -((-percent * size) // 100)


def required(s, r, percent: int):
    """T for two sizes."""
    return -((-percent * (s + r)) // (100 + percent))


def posted(size, percent: int):
    """Shingles that a set of this size posts, if it has as many."""
    return size - least_overlap(size, percent) + size // SPARE + 1


def least_shared(size, percent: int):
    """Posted shingles that a set of this size shares with any set it links to, whose size
    is at least least_overlap."""
    return least_overlap(size, percent) // SPARE + 1


class Sets:
    """The distinct shingles of each row of a chunk, sorted by row, then hash."""

    def __init__(self, texts: pa.Array, k: int):
        data, off = kernels.utf8(texts)
        w = kernels.find_words(kernels.lower_ascii(data), off)
        h = kernels.word_hashes(w)
        at = np.flatnonzero(kernels.same_row(w.row, k))
        token, row = kernels.run_hashes(h, k)[at], w.row[at]
        n_words = np.diff(w.first)
        for n in range(1, k):
            short = np.flatnonzero(n_words == n)
            if len(short):
                token = np.append(token, kernels.mix(kernels.run_hashes(h, n)[w.first[short]] + U(n)))
                row = np.append(row, short)
        order = np.lexsort((token, row))
        token, row = token[order], row[order]
        new = np.append(True, (token[1:] != token[:-1]) | (row[1:] != row[:-1])) if len(token) else np.zeros(0, dtype=bool)
        self.token, self.row = token[new], row[new]
        self.first = np.searchsorted(self.row, np.arange(len(texts) + 1))
        self.size = np.diff(self.first)
        sums = np.append(U(0), np.cumsum(kernels.mix(self.token ^ U(0xA0761D6478BD642F))))
        self.node = kernels.mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.size.astype(U)).view(np.int64)

    def sketches(self) -> pa.Array:
        """Each row's counts of shingles by the low bits of the hash, two to a byte. A set has
        a power of two of classes, between a half of its size and its size."""
        classes = 1 << np.floor(np.log2(np.maximum(self.size, 8))).astype(np.int64)
        base = np.append(0, np.cumsum(classes))
        at = base[self.row] + (self.token & (classes[self.row] - 1).astype(U)).astype(np.int64)
        counts = np.minimum(np.bincount(at, minlength=int(base[-1])), MANY).astype(np.uint8)
        packed = counts[0::2] | (counts[1::2] << np.uint8(4))
        return pa.Array.from_buffers(pa.binary(), len(self.size), [None, pa.py_buffer((base // 2).astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())])

    def distinct(self) -> np.ndarray:
        """The first row of each node of the chunk, empty sets left out."""
        rows = np.unique(self.node, return_index=True)[1]
        return np.sort(rows[self.size[rows] > 0])


def _fingerprints(k: int):
    def run(batches):
        for chunk in kernels.chunks(batches):
            s = Sets(chunk.column("text"), k)
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), chunk.column("row_key"), pa.array(s.node), pa.array(s.size.astype(np.int64)), pa.array(np.zeros(len(s.size), dtype=np.int64)), s.sketches()], names=["doc_id", "row_key", "node", "n", "token", "sketch"])
            token, n = np.unique(s.token, return_counts=True)
            often = n >= LONG_IN_CHUNK
            token, n = token[often].view(np.int64), n[often]
            nulls = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([nulls, nulls, nulls, pa.array(n.astype(np.int64)), pa.array(token), pa.nulls(len(n), pa.binary())], names=["doc_id", "row_key", "node", "n", "token", "sketch"])

    return run


def _post(k: int, percent: int, n_buckets: int, long_token: np.ndarray, long_rank: np.ndarray):
    def run(batches):
        for chunk in kernels.chunks(batches):
            s = Sets(chunk.column("text"), k)
            rank = np.zeros(len(s.token), dtype=np.int64)
            if len(long_token):
                at = np.minimum(np.searchsorted(long_token, s.token), len(long_token) - 1)
                rank = np.where(long_token[at] == s.token, long_rank[at], 0)
            order = np.lexsort((s.token, rank, s.row))
            place = np.arange(len(order)) - s.first[s.row]
            size = s.size[s.row]
            use = np.zeros(len(s.size), dtype=bool)
            use[s.distinct()] = True
            use = use[s.row] & (place < posted(size, percent))
            order, place, row = order[use], place[use], s.row[use]
            found = np.zeros(len(order), dtype=_POST)
            found["token"], found["node"], found["size"], found["at"] = s.token[order], s.node[row], s.size[row], place
            is_long = rank[order] > 0
            bucket = np.where(is_long, kernels.mix(found["node"].view(U)) % U(n_buckets), kernels.mix(found["token"]) % U(n_buckets)).astype(np.int64)
            kind = is_long.astype(np.int64)
            by = np.lexsort((kind, bucket))
            b = bucket[by] * 2 + kind[by]
            edges = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b)) if len(b) else [0]
            out = []
            for x, y in zip(edges[:-1], edges[1:]):
                part = found[by[x:y]]
                nodes, index = np.unique(part["node"], return_inverse=True)
                raw = b"".join((part["token"].tobytes(), nodes.tobytes(), index.astype(np.int32).tobytes(), part["size"].tobytes(), part["at"].tobytes()))
                out.append((int(b[x]) // 2, int(b[x]) % 2, len(part), len(nodes), len(raw), kernels.pack(raw)))
            for i in range(0, len(out), 256):
                cols = list(zip(*out[i : i + 256]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in cols[:5]] + [pa.array(cols[5], pa.binary())], names=["bucket", "kind", "n", "nodes", "size", "payload"])

    return run


def _distinct(p: np.ndarray) -> np.ndarray:
    """Each posting once, by token, then node."""
    p = p[np.lexsort((p["node"], p["token"]))]
    return p[np.append(True, (p["token"][1:] != p["token"][:-1]) | (p["node"][1:] != p["node"][:-1]))[: len(p)]]


def _shared_lists(table: pa.Table) -> pa.Table:
    """The postings of lists that hold two nodes at least; long lists pass."""
    found = {0: [np.zeros(0, dtype=_POST)], 1: [np.zeros(0, dtype=_POST)]}
    for kind, n, n_nodes, size, payload in zip(*(table.column(c).to_pylist() for c in ("kind", "n", "nodes", "size", "payload"))):
        raw = kernels.unpack(payload, size)
        part = np.zeros(n, dtype=_POST)
        part["token"] = np.frombuffer(raw, dtype=U, count=n)
        nodes = np.frombuffer(raw, dtype=np.int64, count=n_nodes, offset=8 * n)
        rest = np.frombuffer(raw, dtype=np.int32, count=3 * n, offset=8 * (n + n_nodes)).reshape(3, n)
        part["node"], part["size"], part["at"] = nodes[rest[0]], rest[1], rest[2]
        found[kind].append(part)
    short, long = (_distinct(np.concatenate(found[kind])) for kind in (0, 1))
    alike = np.append(False, short["token"][1:] == short["token"][:-1])[: len(short)]
    p = np.concatenate((short[alike | np.append(alike[1:], False)[: len(short)]], long))
    return pa.table({"token": p["token"].view(np.int64), "node": p["node"].copy(), "size": p["size"].copy(), "at": p["at"].copy()})


def _counts(sketch: bytes) -> np.ndarray:
    z = np.frombuffer(sketch, dtype=np.uint8)
    x = np.stack([z & 15, z >> 4], axis=1).ravel().astype(np.int64)
    x[x == MANY] = 1 << 40
    return x


def _folded(counts: np.ndarray, n: int) -> np.ndarray:
    """Counts by n classes, of as many or more."""
    return counts.reshape(-1, n).sum(axis=0)


def most_shared(a: bytes, b: bytes) -> int:
    """An upper bound of the overlap of the sets behind two sketches."""
    x, y = _counts(a), _counts(b)
    n = min(len(x), len(y))
    return int(np.minimum(_folded(x, n), _folded(y, n)).sum())


def near_pairs(size: np.ndarray, at: np.ndarray, label: np.ndarray, half: np.ndarray, sketches: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one list that differ in label and are left in reach of T by sizes,
    places and sketches, and by how much their sketches exceed T. Where half holds both
    values, only pairs across it are asked for."""
    counts = [_counts(z) for z in sketches]
    width = np.array([len(c) for c in counts])
    rows = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
    table = {w: np.stack([counts[i] for i in found.tolist()]) for w, found in rows.items()}
    across = half.min() != half.max()
    none = np.zeros(0, dtype=np.int64)
    left, right, spare = [none], [none], [none]
    for i in range(len(size)):
        for w, found in rows.items():
            if w > width[i]:
                continue
            t = required(size[found].astype(np.int64), int(size[i]), percent)
            fits = (label[found] != label[i]) & (np.minimum(size[found] - at[found], size[i] - at[i]) >= t) & (np.minimum(size[found], size[i]) >= t)
            if w == width[i]:
                fits &= found > i
            if across:
                fits &= half[found] != half[i]
            at_ = np.flatnonzero(fits)
            if len(at_):
                most = np.minimum(table[w][at_], _folded(counts[i], w)).sum(axis=1)
                near = at_[most >= t[at_]]
                left.append(np.full(len(near), i))
                right.append(found[near])
                spare.append((most - t[at_])[most >= t[at_]])
    return np.concatenate(left), np.concatenate(right), np.concatenate(spare)


def best_of_each(left: np.ndarray, right: np.ndarray, spare: np.ndarray, best: int) -> np.ndarray:
    """Which pairs are among the `best` of one of their rows."""
    row, pair = np.concatenate([left, right]), np.tile(np.arange(len(left)), 2)
    order = np.lexsort((-spare[pair], row))
    row, pair = row[order], pair[order]
    first = np.searchsorted(row, row)
    return np.unique(pair[np.arange(len(row)) - first < best])


def _search_lists(percent: int, best: int | None):
    """Rows sorted by list and part; gives the pairs of each, the smaller node as query."""

    def solve(rows):
        if len(rows) < 2:
            return []
        node, size, at, label, half = (np.array([r[i] for r in rows]) for i in range(5))
        a, b, spare = near_pairs(size, at, label, half, [r[5] for r in rows], percent)
        if best is not None:
            keep = best_of_each(a, b, spare, best)
            a, b = a[keep], b[keep]
        return [(int(node[i]), int(node[j]), int(size[j])) if node[i] < node[j] else (int(node[j]), int(node[i]), int(size[i])) for i, j in zip(a.tolist(), b.tolist())]

    def batch(found):
        found = sorted(set(found))
        cols = list(zip(*found)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], names=["q", "node", "size"])

    def run(batches):
        key, rows = None, []
        for b in batches:
            found = []
            cols = [b.column(c).to_pylist() for c in ("token", "i", "j", "node", "size", "at", "label", "half", "sketch")]
            for t, i, j, *row in zip(*cols):
                if (t, i, j) != key:
                    found += solve(rows)
                    key, rows = (t, i, j), []
                rows.append(row)
            yield batch(found)
        yield batch(solve(rows))

    return run


def _in_reach(percent: int):
    def run(batches):
        for batch in batches:
            size, q_size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "q_size"))
            t = required(size.astype(np.int64), q_size.astype(np.int64), percent)
            most = [most_shared(a, b) for a, b in zip(batch.column("sketch").to_pylist(), batch.column("q_sketch").to_pylist())]
            yield batch.select(["q", "node", "size"]).filter(pa.array(np.array(most, dtype=np.int64) >= t))

    return run


def _reachable(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (q, node, q_size, size) that their sketches leave in reach of T."""
    both = pairs.join(sketches.hint("merge"), "node").join(sketches.select(F.col("node").alias("q"), F.col("sketch").alias("q_sketch")).hint("merge"), "q")
    return both.select("q", "node", "size", "q_size", "sketch", "q_sketch").mapInArrow(_in_reach(percent), "q long, node long, size int")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bit for each key, by its remainder: of bounded size, and it may only let too many
    rows through."""
    want = min(max(FILTER_BITS[0], keys.count() * BITS_PER_NODE), FILTER_BITS[1])
    n_bits = 1 << (want - 1).bit_length()
    some = keys.select(F.pmod("key", F.lit(n_bits)).alias("s")).groupBy(F.shiftright("s", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(s % 8 as int))")).alias("b"))
    blocks = some.groupBy(F.shiftright("byte", 10)).agg(F.collect_list(F.col("byte") * 256 + F.col("b")).alias("bytes")).select("bytes").collect()
    bits = np.zeros(n_bits // 8, dtype=np.uint8)
    for r in blocks:
        found = np.array(r.bytes, dtype=np.int64)
        bits[found >> 8] = found & 255
    return bits


def _emit_sets(k: int, bits: np.ndarray):
    def run(batches):
        for batch in batches:
            bit = (batch.column("key").to_numpy().view(U) % U(len(bits) * 8)).astype(np.int64)
            batch = batch.filter(pa.array((bits[bit >> 3] >> (bit & 7)) & 1 > 0))
            for chunk in kernels.chunks([batch]):
                s = Sets(chunk.column("text"), k)
                rows = s.distinct()
                for i in range(0, len(rows), 512):
                    part = rows[i : i + 512].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(s.node[part]), pa.array([s.token[s.first[r] : s.first[r + 1]].tobytes() for r in part], pa.binary())], names=["node", "tokens"])

    return run


def divide_skip(query: np.ndarray, token: np.ndarray, owner: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which sets reach T with the query. token, owner: the inverted lists, sorted by
    token, then owner; sizes: of the owners."""
    lo, hi = np.searchsorted(token, query, side="left"), np.searchsorted(token, query, side="right")
    length, n = hi - lo, len(sizes)
    t = required(len(query), sizes, percent)
    fits = (t <= len(query)) & (t <= sizes)
    if not fits.any():
        return np.zeros(0, dtype=np.int64)
    least = int(t[fits].min())
    n_long = min(least - 1, int(least / (0.0085 * np.log2(max(2, length.max())) + 1)))
    order = np.argsort(length, kind="stable")
    short, long = order[: len(order) - n_long], order[len(order) - n_long :]
    count = np.zeros(n, dtype=np.int64)
    heap = heapq.merge(*(owner[a:b].tolist() for a, b in zip(lo[short].tolist(), hi[short].tolist()) if b > a))
    for o, run in itertools.groupby(heap):
        count[o] = sum(1 for _ in run)
    left = np.flatnonzero(fits & (count >= t - n_long) & (count > 0))
    if len(left) and n_long:
        key = np.repeat(np.arange(n_long) * n, length[long]) + owner[np.concatenate([np.arange(a, b) for a, b in zip(lo[long].tolist(), hi[long].tolist())])]
        for i in range(0, len(left), 4096):
            some = left[i : i + 4096]
            for j in range(0, n_long, 256):
                probe = (np.arange(j, min(j + 256, n_long)) * n)[:, None] + some
                at = np.minimum(np.searchsorted(key, probe), max(len(key) - 1, 0))
                if len(key):
                    count[some] += (key[at] == probe).sum(axis=0)
    return left[count[left] >= t[left]]


def _search(percent: int):
    """Rows sorted by block, the query first; gives the links found."""

    def solve(rows):
        query = np.frombuffer(rows[0][3], dtype=U)
        sets = [np.frombuffer(r[3], dtype=U) for r in rows[1:]]
        if rows[0][2] or not sets:
            return []
        sizes = np.array([len(x) for x in sets])
        token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.lexsort((owner, token))
        return [(rows[0][1], rows[1 + i][1]) for i in divide_skip(query, token[order], owner[order], sizes, percent).tolist()]

    def run(batches):
        block, rows = None, []
        for batch in batches:
            found = []
            for q, salt, member, node, tokens in zip(*(batch.column(c).to_pylist() for c in ("q", "salt", "member", "node", "tokens"))):
                if (q, salt) != block:
                    found += solve(rows) if rows else []
                    block, rows = (q, salt), []
                rows.append((salt, node, member, tokens))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})
        found = solve(rows) if rows else []
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _searched(rows: DataFrame, members: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: the pairs (q, node, size) whose sets link. Of each node of the pairs one row is
    read again; only its set leaves the scan."""
    spark = pairs.sparkSession
    nodes = pairs.select(F.explode(F.array("q", "node")).alias("node")).distinct()
    chosen = members.groupBy("node").agg(F.min(F.struct("doc_id", "row_key")).alias("row")).join(nodes.hint("merge"), "node", "left_semi")
    bits = _bitmap(chosen.select(F.xxhash64("row.doc_id", "row.row_key").alias("key")))
    keyed = rows.select(F.xxhash64("doc_id", common.row_key()).alias("key"), "text")
    sets = keyed.mapInArrow(_emit_sets(k, bits), "node long, tokens binary")
    # copies that the filter lets through give a set more than once: keep one
    sets = sets.groupBy("node").agg(F.max("tokens").alias("tokens"))
    blocks = pairs.groupBy("q").agg((F.ceil(F.sum("size") / BLOCK)).cast("int").alias("n_salts"))
    dealt = pairs.join(blocks.hint("merge"), "q").select("q", F.pmod(F.xxhash64("node"), "n_salts").cast("int").alias("salt"), "node")
    members = dealt.select("q", "salt", F.lit(True).alias("member"), "node")
    heads = dealt.select("q", "salt").distinct().select("q", "salt", F.lit(False).alias("member"), F.col("q").alias("node"))
    both = members.union(heads).join(sets.hint("merge"), "node").select("q", "salt", "member", "node", "tokens")
    both = both.repartition(common.shuffle_partitions(spark), "q", "salt").sortWithinPartitions("q", "salt", "member", "node")
    return both.mapInArrow(_search(percent), "a long, b long")


def _fitting(s: str, r: str, i: str, j: str, percent: int):
    """Sizes and places of a shared posting that leave T in reach."""
    t = F.ceil(F.lit(percent) * (F.col(s) + F.col(r)) / F.lit(100 + percent))
    return (F.least(F.col(s) - F.col(i), F.col(r) - F.col(j)) >= t) & (F.least(s, r) >= t)


def _merged(lists: DataFrame) -> DataFrame:
    """One list, the first in the order of shingles, for all lists of the same nodes, with
    their number as weight. Lists are told apart by two 64-bit sums over their nodes."""
    print_of = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"sum{i}") for i in range(2)]
    by_token = lists.groupBy("token").agg(*print_of, F.count("*").alias("n"), F.min(F.struct("node", "at")).alias("first"))
    one = by_token.groupBy("sum0", "sum1", "n").agg(F.min(F.struct("first.at", "token")).alias("least"), F.count("*").alias("weight")).filter("n > 1")
    return lists.join(one.select(F.col("least.token").alias("token"), "weight").hint("merge"), "token")


def _able(lists: DataFrame, percent: int) -> DataFrame:
    """The postings of nodes whose lists weigh as much as what a partner shares at least."""
    least = F.floor(F.ceil(F.col("size") * percent / 100) / SPARE) + 1
    able = lists.groupBy("node", "size").agg(F.sum("weight").alias("n")).filter(F.col("n") >= least).select("node")
    return lists.join(able.hint("merge"), "node", "left_semi")


def _mixed(lists: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """The postings of lists whose nodes are still in different components, with label; of
    nodes that have enough of them."""
    named = lists.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    both = named.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("token")
    return _able(named.join(both.hint("merge"), "token", "left_semi"), percent)


def _within_lists(apart: DataFrame, sketches: DataFrame, percent: int, best: int | None = None) -> DataFrame:
    """q, node, size: the pairs of different components that meet in a list and are left in
    reach of T. A list is searched inside a task and only such pairs leave it; one longer
    than PART is cut into parts, and each two of them meet in a task of their own. With
    `best`, a node is paired with so many of its part only, a search linear in the lists."""
    lengths = apart.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    rows = apart.join(lengths.hint("merge"), "token").withColumn("parts", F.ceil(F.col("n") / PART).cast("int")).withColumn("p", F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")).cast("int"))
    others = F.sequence(F.lit(0), F.col("parts") - 1) if best is None else F.array("p")
    rows = rows.join(sketches.hint("merge"), "node").select("token", "node", "size", "at", "label", "sketch", "p", F.explode(others).alias("o"))
    rows = rows.select("token", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "node", "size", "at", "label", (F.col("p") > F.col("o")).cast("int").alias("half"), "sketch")
    dealt = rows.repartition(common.shuffle_partitions(apart.sparkSession), "token", "i", "j").sortWithinPartitions("token", "i", "j")
    return dealt.mapInArrow(_search_lists(percent, best), "q long, node long, size int").dropDuplicates(["q", "node"])


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, row_key, n_shingles, component_id, the smallest doc_id
    that links reach, n_links, those verified for its text (at least one if any exists), and
    keeps: whether it has the text that stays of its component (the smallest row_key of the
    smallest doc_id), or takes no part."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark)
    rows = docs.select("doc_id", "text")
    facts = scratch.table(rows.withColumn("row_key", common.row_key()).mapInArrow(_fingerprints(k), "doc_id long, row_key long, node long, n long, token long, sketch binary"))
    top = facts.filter("node is null").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(MAX_LONG).toPandas().sort_values("n", kind="stable")
    long_token = top["token"].to_numpy(dtype=np.int64).view(U)
    by = np.argsort(long_token)
    members = facts.filter("node is not null").select("doc_id", "row_key", "node", F.col("n").alias("n_shingles"))
    named_members = members.filter("doc_id is not null")
    sketches = facts.filter("node is not null and n > 0").groupBy("node").agg(F.first("sketch").alias("sketch"))

    n_posted = members.agg(F.sum(F.least("n_shingles", F.col("n_shingles") * (100 - percent) / 100 + F.col("n_shingles") / SPARE + 2))).first()[0] or 0
    n_buckets = max(BUCKETS_PER_PARTITION * common.shuffle_partitions(spark), int(n_posted * _POST.itemsize) // BUCKET_BYTES)
    sent = rows.filter("doc_id is not null").mapInArrow(_post(k, percent, n_buckets, long_token[by], (by + 1).astype(np.int64)), "bucket int, kind int, n int, nodes int, size int, payload binary")
    shared = scratch.table(sent.groupBy("bucket").applyInArrow(_shared_lists, _POSTING))
    merged = scratch.table(_merged(shared))
    scratch.drop(shared)
    lists = scratch.table(_able(merged, percent))
    scratch.drop(merged)

    ends = lists.groupBy("token").agg(F.min(F.struct("node", "size", "at")).alias("lo"), F.max(F.struct("node", "size", "at")).alias("hi")).filter("lo.node <> hi.node")
    ends = ends.select("token", F.explode(F.array("lo", "hi")).alias("q")).select("token", F.col("q.node").alias("q"), F.col("q.size").alias("q_size"), F.col("q.at").alias("q_at"))
    star = lists.join(ends.hint("merge"), "token").filter("node <> q").filter(_fitting("size", "q_size", "at", "q_at", percent))
    # a pair that meets with both as queries is searched once
    star = star.select("q", "node", "size", "q_size").dropDuplicates(["q", "node"])
    pairs = scratch.table(_reachable(star, sketches, percent))
    links = scratch.table(_searched(rows, named_members, pairs, k, percent))
    labels = scratch.table(components(links))

    apart = scratch.table(_mixed(lists, labels, percent))
    scratch.drop(lists)
    ring = scratch.table(_within_lists(apart, sketches, percent, NEIGHBOURS))
    if not ring.isEmpty():
        links = scratch.table(links.union(_searched(rows, named_members, ring, k, percent)))
        labels = scratch.table(components(links))
        was, apart = apart, scratch.table(_mixed(apart.drop("label"), labels, percent))
        scratch.drop(was)
    pairs = pairs.union(ring).select("q", "node")
    rest = _within_lists(apart, sketches, percent)
    rest = rest.join(pairs.hint("merge"), ["q", "node"], "left_anti").join(pairs.select(F.col("node").alias("q"), F.col("q").alias("node")).hint("merge"), ["q", "node"], "left_anti")
    rest = scratch.table(rest)
    if not rest.isEmpty():
        links = scratch.table(links.union(_searched(rows, named_members, rest, k, percent)))
        labels = scratch.table(components(links))

    degree = links.select(F.explode(F.array("a", "b")).alias("node"), F.when(F.col("a") < F.col("b"), F.struct("a", "b")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b"))).alias("pair")).distinct().groupBy("node").agg(F.count("*").alias("n_links"))
    classes = members.filter("doc_id is not null and n_shingles > 0").groupBy("node").agg(F.min(F.struct("doc_id", "row_key")).alias("rep"))
    classes = classes.join(labels.hint("merge"), "node", "left").join(degree.hint("merge"), "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    least = classes.groupBy("label").agg(F.min("rep").alias("least"))
    named = classes.join(least.hint("merge"), "label").select("node", "least", "n_links")
    full = members.withColumn("key", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("node")))
    out = full.join(named.withColumnRenamed("node", "key").hint("merge"), "key", "left")
    keeps = F.coalesce((F.col("doc_id") == F.col("least.doc_id")) & (F.col("row_key") == F.col("least.row_key")), F.lit(True))
    out = common.materialise(out.select("doc_id", "row_key", "n_shingles", F.coalesce("least.doc_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), keeps.alias("keeps")))
    scratch.drop()
    return out


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group, of those with the smallest doc_id; all columns are kept. Rows
    that share a doc_id are judged each by its own text. Rows with a null doc_id, and those
    with an empty set, stay."""
    key = ["doc_id", "row_key"]
    groups = jaccard_groups(docs, k, percent)
    whole = docs.select(F.struct("*").alias("whole"))
    whole = whole.select(F.col("whole.doc_id").alias("doc_id"), common.row_key(text="whole.text").alias("row_key"), "whole")
    kept = whole.join(groups.filter("not keeps").select(*key).distinct().hint("merge"), key, "left_anti")
    # ids are unique as a rule, so the documents are read once
    again = groups.filter("keeps and n_shingles > 0 and doc_id is not null").groupBy(*key).count().filter("count > 1").select(*key)
    if not again.isEmpty():
        one = kept.join(again, key, "left_semi").groupBy(*key).agg(F.min_by("whole", F.to_json("whole")).alias("whole"))
        kept = kept.join(again, key, "left_anti").unionByName(one)
    return kept.select("whole.*")
