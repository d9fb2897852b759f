"""Quality classifier with naive Bayes support vectors: indicators of n-grams are scaled
by the log-count ratios of the classes, then a linear hinge-loss model is fitted by dual
coordinate descent, and a logistic curve turns its margin into a probability.

N-grams are words, word pairs (A-Z lower-cased) and triples of word shapes (all upper
case, symbols, digits, equal to the word before), hashed into 2^18 cells. Class counts
cover all labelled training rows; the hinge loss is fitted on at most `MAX_FIT` of them
(in expectation; chosen by a hash of doc_id) in one bounded task, and a fifth of these
sets the curve. Labels are joined by broadcast up to `MAX_BROADCAST` labelled rows, by a
shuffle beyond.

Defined results: null and empty texts have no n-gram and get the score of the bias
alone; labels other than 0 and 1 and null ids are ignored; a doc_id with several labels
takes the largest; with fewer than two classes to learn from, every score is the share
of label 1 (0.5 without labels); an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels
from .kernels import U

CELLS = 1 << 18
MAX_FIT = 12_000
MAX_BROADCAST = 1_000_000
SMOOTHING = 1.0
COST = 1.0
PASSES = 12
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SYMBOL[[ord(c) for c in ".,;:'\"-?()"]] = False
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWERCASE = np.zeros(256, dtype=bool)
_LOWERCASE[97:123] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def _per_word(w: kernels.Words, kind: np.ndarray) -> np.ndarray:
    sums = np.append(0, np.cumsum(kind[w.data]))
    return sums[w.end] - sums[w.start]


def cells(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the n-grams in each row, and where each row starts."""
    data, off = kernels.utf8(texts)
    w = kernels.find_words(data, off)
    n = w.end - w.start
    upper, symbols = _per_word(w, _UPPER), _per_word(w, _SYMBOL)
    w.data = kernels.lower_ascii(data)
    h = kernels.word_hashes(w)
    again = np.append(False, (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])) if len(h) else np.zeros(0, dtype=bool)
    plain = _per_word(w, _LOWERCASE)
    shape = (upper > 1) & (upper >= plain)
    shape = shape + 2 * (symbols > 0) + 4 * (symbols == n) + 8 * (_per_word(w, _DIGIT) > 0) + 16 * again
    two, three = kernels.same_row(w.row, 2), kernels.same_row(w.row, 3)
    parts = [(h, w.row), (kernels.run_hashes(h, 2)[two], w.row[: len(two)][two]), (kernels.run_hashes(kernels.mix(shape.astype(U) + U(77)), 3)[three], w.row[: len(three)][three])]
    cell = np.concatenate([(x >> U(46)).astype(np.int64) for x, _ in parts])
    row = np.concatenate([r for _, r in parts])
    both = np.unique(row * CELLS + cell)
    return (both % CELLS).astype(np.int32), np.searchsorted(both // CELLS, np.arange(len(texts) + 1))


@dataclass
class Model:
    weights: np.ndarray  # one per cell, log-count ratio included
    bias: float
    slope: float
    offset: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        cell, first = cells(texts)
        sums = np.append(0.0, np.cumsum(self.weights[cell], dtype=float))
        n = np.diff(first)
        margin = (sums[first[1:]] - sums[first[:-1]]) / np.sqrt(np.maximum(n, 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray, int]], n_cells: int, cost: float = COST, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and bias of least L2-regularised hinge loss over (cells, values, -1 or 1)."""
    w, bias = np.zeros(n_cells), 0.0
    alpha = np.zeros(len(rows))
    norm = [float(x @ x) + 1.0 for _, x, _ in rows]
    rng = np.random.default_rng(0)
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(rows)).tolist():
            cell, x, y = rows[i]
            slope = y * (float(w[cell] @ x) + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost)
            if (step := (new - alpha[i]) * y) != 0:
                w[cell] += step * x
                bias += step
                worst = max(worst, abs(step))
                alpha[i] = new
        if worst < 1e-3:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on smoothed targets."""
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    if not pos or not neg:
        return 1.0, 0.0
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -60, 60)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * (a - 1), (p - t).sum()])
        v = p * (1 - p) + 1e-9
        hess = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum()]])
        step = np.linalg.solve(hess, g)
        scale = min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - scale * step[0], b - scale * step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def _class_counts(batches):
    pos, neg = np.zeros(CELLS, dtype=np.int64), np.zeros(CELLS, dtype=np.int64)
    n = [0, 0]
    for chunk in kernels.chunks(batches):
        y = chunk.column("y").to_numpy(zero_copy_only=False)
        cell, first = cells(chunk.column("text"))
        good = np.repeat(y > 0, np.diff(first))
        pos += np.bincount(cell[good], minlength=CELLS)
        neg += np.bincount(cell[~good], minlength=CELLS)
        n[0] += int((y <= 0).sum())
        n[1] += int((y > 0).sum())
    at = np.flatnonzero(pos + neg)
    yield pa.RecordBatch.from_pydict({"cell": np.append(at, -1).astype(np.int32), "pos": np.append(pos[at], n[1]), "neg": np.append(neg[at], n[0])})


def _train(ratio: np.ndarray):
    def rows_of(table: pa.Table):
        out = []
        for y, raw in zip(table.column("y").to_pylist(), table.column("cells").to_pylist()):
            c = np.frombuffer(raw, dtype=np.int32)
            out.append((c, ratio[c] / np.sqrt(max(len(c), 1)), 1 if y > 0 else -1))
        return out

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        rows, test = rows_of(table.filter(pa.compute.invert(table.column("test")))), rows_of(table.filter(table.column("test")))
        w, bias = dual_coordinate_descent(rows, CELLS)
        test = test or rows
        slope, offset = logistic(np.array([w[c] @ x + bias for c, x, _ in test]), np.array([y for _, _, y in test]))
        return pa.table({"w": pa.array([w.tobytes()], pa.binary()), "bias": [bias], "slope": [slope], "offset": [offset]})

    return train


def _cells_column(batches):
    for chunk in kernels.chunks(batches):
        cell, first = cells(chunk.column("text"))
        raw = [cell[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        for i in range(0, len(raw), 512):
            part = chunk.slice(i, 512)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), part.column("test"), pa.array(raw[i : i + 512], pa.binary())], names=["doc_id", "y", "test", "cells"])


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality") -> Model:
    """Learn `target` of the labelled rows whose held_out is false."""
    y = labels.select("doc_id", F.col(target).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(~common.held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    n_labels = labels.count()
    y = F.broadcast(y) if n_labels <= MAX_BROADCAST else y
    rows = docs.select("doc_id", "text").join(y, "doc_id")
    got = rows.select("text", "y").mapInArrow(_class_counts, "cell int, pos long, neg long").groupBy("cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toPandas()
    total = got[got["cell"] == -1]
    n_pos, n_neg = (int(total["pos"].sum()), int(total["neg"].sum()))
    if not n_pos or not n_neg:
        share = n_pos / (n_pos + n_neg) if n_pos + n_neg else 0.5
        return Model(np.zeros(CELLS), 0.0, 1.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    got = got[got["cell"] >= 0]
    p, q = np.full(CELLS, SMOOTHING), np.full(CELLS, SMOOTHING)
    p[got["cell"].to_numpy()] += got["pos"].to_numpy()
    q[got["cell"].to_numpy()] += got["neg"].to_numpy()
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    share = min(1.0, MAX_FIT / (n_pos + n_neg))
    lot = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20)) / F.lit(1 << 20)
    sample = rows.filter(lot < share).withColumn("test", F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(5)) == 0)
    sample = sample.select("doc_id", "text", "y", "test").mapInArrow(_cells_column, "doc_id long, y int, test boolean, cells binary")
    got = sample.groupBy().applyInArrow(_train(ratio), "w binary, bias double, slope double, offset double").first()
    return Model((np.frombuffer(got.w) * ratio).astype(np.float32), got.bias, got.slope, got.offset)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches):
        for chunk in kernels.chunks(batches):
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(model.scores(chunk.column("text")))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
