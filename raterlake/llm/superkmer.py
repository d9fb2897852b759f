"""Substring dedup by super-k-mer partitioning.

A window is k consecutive words of one document. Consecutive windows that share a
minimiser (the smallest hash of the m-word tuples inside them) travel as one packed
string to the bucket of that minimiser, so equal windows meet in one bucket while a
word is sent about three times instead of k times. In the bucket the windows are
sorted, equal neighbours are compared byte for byte, and every window that also starts
in a document with a smaller doc_id is reported.

Scale and skew
* Super-k-mers which repeat inside a chunk of rows are settled there against the
  smallest doc_id of the chunk; only that document's copies are sent on. A group of
  copies costs a bucket one row per chunk, not one per copy.
* A minimiser that very many different contexts share would still fill one bucket. A
  sampled count names such minimisers; their windows travel alone, spread by the hash of
  the whole window. The list steers routing only: any list gives the same result.
* There are `BUCKETS_PER_PARTITION` buckets for each of `spark.sql.shuffle.partitions`, and
  more where the counted bytes of all texts, each sent some three times, would put more than
  `BUCKET_BYTES` in one of them.

Defined results: a null or blank text has no words; a row with a null doc_id is never
smaller than another and loses nothing; rows that share a doc_id are not smaller than
each other; equal rows are treated alike; an empty table gives an empty table; columns
besides doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels
from .kernels import U

K = 13
M = 2
BUCKETS_PER_PARTITION = 4
BUCKET_BYTES = 64 << 20
#: One row in so many is read to find minimisers shared by too many contexts.
ROUTING_SAMPLE = 32
MAX_HOT = 4096

_HEAD = np.dtype([("doc", np.int64), ("key", np.int64), ("at", np.int32), ("n", np.int32)])


def _head_bytes(head: np.ndarray) -> bytes:
    """Column by column, doc_id (sorted) as differences: this compresses well."""
    return b"".join((np.diff(head[c], prepend=0) if c == "doc" else head[c]).tobytes() for c in _HEAD.names)


def _head_from(raw: memoryview, n: int) -> np.ndarray:
    head, at = np.zeros(n, dtype=_HEAD), 0
    for c in _HEAD.names:
        head[c] = np.frombuffer(raw, dtype=_HEAD[c], count=n, offset=at)
        at += n * _HEAD[c].itemsize
    head["doc"] = np.cumsum(head["doc"])
    return head


_RANGES = "doc_id long, row_key long, lo int, hi int"
_SENT = "bucket int, kind int, n int, size int, payload binary"


def _super_kmers(batch: pa.RecordBatch, k: int, m: int, hot: np.ndarray):
    """Words of the chunk and, for each super-k-mer, its routing key, first window and last."""
    data, off = kernels.utf8(batch.column("text"))
    w = kernels.find_words(data, off)
    empty = np.zeros(0, dtype=np.int64)
    if len(w.start) < k:
        return w, np.zeros(0, dtype=U), empty, empty
    h = kernels.word_hashes(w)
    least = kernels.running_min(kernels.run_hashes(h, m), k - m + 1)
    key = least
    if len(hot):
        at = np.searchsorted(hot, least)
        is_hot = hot[np.minimum(at, len(hot) - 1)] == least
        if is_hot.any():
            key = np.where(is_hot, kernels.run_hashes(h, k), least)
    fits = np.flatnonzero(kernels.same_row(w.row, k))
    if not len(fits):
        return w, np.zeros(0, dtype=U), empty, empty
    cut = np.ones(len(fits), dtype=bool)
    cut[1:] = (fits[1:] != fits[:-1] + 1) | (key[fits[1:]] != key[fits[:-1]]) | (w.row[fits[1:]] != w.row[fits[:-1]])
    heads = np.flatnonzero(cut)
    first = fits[heads]
    last = fits[np.append(heads[1:], len(fits)) - 1]
    return w, key[first], first, last


def _packed_text(w: kernels.Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one blank, and where each starts and ends."""
    n = w.end - w.start
    start = np.cumsum(n + 1) - (n + 1)
    out = np.full(int((n + 1).sum()), 32, dtype=np.uint8)
    edge = np.zeros(len(w.data) + 1, dtype=np.int8)
    edge[w.start] += 1
    np.subtract.at(edge, w.end, 1)
    take = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    put = np.ones(len(out), dtype=bool)
    put[start + n] = False
    out[put] = w.data[take]
    return out.tobytes(), start, start + n


def _send(k: int, m: int, n_buckets: int, hot: np.ndarray):
    def send(batches):
        for chunk in kernels.chunks(batches):
            docs = chunk.column("doc_id").to_numpy(zero_copy_only=False)
            chunk = chunk.take(pa.array(np.argsort(docs, kind="stable")))
            docs = chunk.column("doc_id").to_numpy(zero_copy_only=False)
            keys = chunk.column("row_key").to_numpy(zero_copy_only=False)
            w, key, first, last = _super_kmers(chunk, k, m, hot)
            if not len(first):
                continue
            text, starts, ends = _packed_text(w)
            lo, hi = starts[first].tolist(), ends[last + k - 1].tolist()
            row, place = w.row[first], w.place()
            parts = [text[a:b] for a, b in zip(lo, hi)]
            seen: dict[bytes, int] = {}
            holder = np.fromiter((seen.setdefault(p, j) for j, p in enumerate(parts)), dtype=np.int64, count=len(parts))
            local = docs[row] > docs[row[holder]]
            bucket = (kernels.mix(key) % U(n_buckets)).astype(np.int64)
            out = []
            if local.any():
                at = np.flatnonzero(local)
                found = np.zeros(len(at), dtype=_HEAD)
                found["doc"], found["key"] = docs[row[at]], keys[row[at]]
                found["at"], found["n"] = place[first[at]], place[last[at]] + k
                raw = _head_bytes(found)
                out.append((int(bucket[at[0]]), 1, len(at), len(raw), kernels.pack(raw)))
            sent = np.flatnonzero(~local)
            sent = sent[np.argsort(bucket[sent], kind="stable")]
            b = bucket[sent]
            edges = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b)) if len(b) else [0]
            for x, y in zip(edges[:-1], edges[1:]):
                at = sent[x:y]
                head = np.zeros(len(at), dtype=_HEAD)
                head["doc"], head["key"], head["at"] = docs[row[at]], keys[row[at]], place[first[at]]
                head["n"] = [len(parts[j]) for j in at.tolist()]
                raw = _head_bytes(head) + b"".join([parts[j] for j in at.tolist()])
                out.append((int(b[x]), 0, len(at), len(raw), kernels.pack(raw)))
            for i in range(0, len(out), 64):
                cols = list(zip(*out[i : i + 64]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary())], names=["bucket", "kind", "n", "size", "payload"])

    return send


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether data[a:a+n_a] equals data[b:b+n_b], for many pairs."""
    same = n_a == n_b
    order = np.flatnonzero(same)
    order = order[np.argsort(n_a[order], kind="stable")]
    lens = n_a[order]
    for n in np.unique(lens).tolist():
        at = order[np.searchsorted(lens, n) : np.searchsorted(lens, n, side="right")]
        step = max(1, (1 << 20) // max(n, 1))
        for i in range(0, len(at), step):
            x, span = at[i : i + step], np.arange(n)
            same[x] = (data[a[x][:, None] + span] == data[b[x][:, None] + span]).all(axis=1)
    return same


def repeated_windows(w: kernels.Words, docs: np.ndarray, k: int) -> np.ndarray:
    """Positions of the windows whose words also start in a row with a smaller doc.

    Windows are sorted by hash, then doc; each is compared byte for byte with the first
    of its run, and the runs where hashes collide are settled by the bytes alone."""
    fits = np.flatnonzero(kernels.same_row(w.row, k))
    if not len(fits):
        return fits
    h = kernels.run_hashes(kernels.word_hashes(w), k)[fits]
    doc = docs[w.row[fits]]
    order = np.lexsort((doc, h))
    h, doc, fits = h[order], doc[order], fits[order]
    begins = np.append(True, h[1:] != h[:-1])
    head = np.flatnonzero(begins)[np.cumsum(begins) - 1]
    later = np.flatnonzero(head != np.arange(len(head)))
    if not len(later):
        return later
    lo, size = w.start[fits], w.end[fits + k - 1] - w.start[fits]
    same = _equal_bytes(w.data, lo[later], lo[head[later]], size[later], size[head[later]])
    hit = doc[later] > doc[head[later]]
    found = later[same & hit]
    if not same.all():
        clash = np.unique(head[later[~same]])
        found = found[~np.isin(head[found], clash)]
        raw, extra, least = w.data.tobytes(), [], {}
        for i in np.flatnonzero(np.isin(head, clash)).tolist():  # in order of hash and doc
            first = least.setdefault(raw[lo[i] : lo[i] + size[i]], doc[i])
            if doc[i] > first:
                extra.append(i)
        found = np.append(found, np.array(extra, dtype=np.int64))
    return np.sort(fits[found])


def _settle(k: int):
    def settle(table: pa.Table) -> pa.Table:
        out, heads, texts = [], [], []
        for kind, n, size, payload in zip(*(table.column(c).to_pylist() for c in ("kind", "n", "size", "payload"))):
            raw = kernels.unpack(payload, size)
            head = _head_from(raw, n)
            if kind == 1:
                out.append(head)
            else:
                heads.append(head)
                texts.append(raw[n * _HEAD.itemsize :])
        if heads:
            head = np.concatenate(heads)
            data = np.frombuffer(b"".join(texts), dtype=np.uint8)
            w = kernels.find_words(data, np.append(0, np.cumsum(head["n"], dtype=np.int64)))
            at = repeated_windows(w, head["doc"], k)
            if len(at):
                cut = np.append(True, (at[1:] != at[:-1] + 1) | (w.row[at[1:]] != w.row[at[:-1]]))
                first = at[np.flatnonzero(cut)]
                last = at[np.append(np.flatnonzero(cut)[1:], len(at)) - 1]
                place = w.place()
                found = np.zeros(len(first), dtype=_HEAD)
                found["doc"], found["key"] = head["doc"][w.row[first]], head["key"][w.row[first]]
                found["at"] = head["at"][w.row[first]] + place[first]
                found["n"] = head["at"][w.row[first]] + place[last] + k
                out.append(found)
        r = np.concatenate(out) if out else np.zeros(0, dtype=_HEAD)
        return pa.table({"doc_id": r["doc"].copy(), "row_key": r["key"].copy(), "lo": r["at"].copy(), "hi": r["n"].copy()})

    return settle


def _hot_minimisers(rows: DataFrame, k: int, m: int, n_buckets: int) -> np.ndarray:
    """Minimisers with more than an eighth of a bucket's fair share of sampled super-k-mers."""
    none = np.zeros(0, dtype=U)

    def count(batches):
        for chunk in kernels.chunks(batches):
            w, key, first, last = _super_kmers(chunk, k, m, none)
            if not len(first):
                continue
            text, starts, ends = _packed_text(w)
            parts = {text[a:b]: key[j] for j, (a, b) in enumerate(zip(starts[first].tolist(), ends[last + k - 1].tolist()))}
            keys, n = np.unique(np.fromiter(parts.values(), dtype=U, count=len(parts)), return_counts=True)
            many = n >= 8
            yield pa.RecordBatch.from_pydict({"key": np.append(keys[many].view(np.int64), 0), "n": np.append(n[many], len(parts)), "total": np.append(np.zeros(many.sum(), dtype=bool), True)})

    sample = rows.filter(F.pmod(F.xxhash64(F.lit("route"), "doc_id"), F.lit(ROUTING_SAMPLE)) == 0)
    counts = sample.mapInArrow(count, "key long, n long, total boolean").groupBy("total", "key").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("total"), F.desc("n"), "key").limit(MAX_HOT + 1).collect()
    total = sum(r.n for r in top if r.total)
    hot = [r.key for r in top if not r.total and r.n * 8 * n_buckets > total]
    return np.sort(np.array(hot, dtype=np.int64).view(U))


def _row_key(docs: DataFrame):
    """Tells apart rows that share a doc_id; a constant, which costs no room, where none do."""
    shared = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    return F.lit(0).cast("long") if shared.isEmpty() else common.row_key()


def repeated_ranges(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """(doc_id, row_key, lo, hi): word ranges, end exclusive, covered by windows that also
    start in a document with a smaller doc_id. Ranges may overlap."""
    spark = docs.sparkSession
    rows = docs.filter("doc_id is not null and text is not null").select("doc_id", _row_key(docs).alias("row_key"), "text")
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(BUCKETS_PER_PARTITION * common.shuffle_partitions(spark), 3 * n_bytes // BUCKET_BYTES)
    hot = _hot_minimisers(rows, k, m, n_buckets)
    sent = rows.mapInArrow(_send(k, m, n_buckets, hot), _SENT)
    return sent.groupBy("bucket").applyInArrow(_settle(k), _RANGES)


def _cut(batches):
    for batch in batches:
        texts, n_words, n_removed = [], [], []
        for text, ranges in zip(batch.column("text"), batch.column("ranges")):
            parts = text.as_buffer().to_pybytes().split() if text.is_valid else []
            n_words.append(len(parts))
            if ranges.is_valid and len(ranges):
                keep = np.zeros(len(parts) + 1, dtype=np.int64)
                flat = ranges.values
                np.add.at(keep, flat.field("lo").to_numpy(), 1)
                np.subtract.at(keep, flat.field("hi").to_numpy(), 1)
                parts = [parts[i] for i in np.flatnonzero(np.cumsum(keep[:-1]) == 0).tolist()]
            n_removed.append(n_words[-1] - len(parts))
            texts.append(b" ".join(parts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["doc_id", "kept_text", "n_words", "n_removed"])


def remove_repeated_windows(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """One row per document: doc_id, kept_text (kept words joined by a blank), n_words, n_removed."""
    ranges = repeated_ranges(docs, k, m).groupBy(F.col("doc_id").alias("r_doc"), F.col("row_key").alias("r_key")).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    rows = docs.select("doc_id", "text", _row_key(docs).alias("row_key"))
    joined = rows.join(ranges, (F.col("doc_id") == F.col("r_doc")) & (F.col("row_key") == F.col("r_key")), "left")
    return joined.select("doc_id", "text", "ranges").mapInArrow(_cut, "doc_id long, kept_text string, n_words long, n_removed long")
