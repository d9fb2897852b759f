"""Quality classifier: held-out quality, the dual solver, defined results."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from raterlake.llm import common, nbsvm

from . import data

SF = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = y > 0
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_rows_are_told_apart(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    out = nbsvm.score(docs, nbsvm.fit(docs, labels)).join(labels, "doc_id").filter(common.held_out() & F.col("quality").isNotNull())
    got = out.select("score", "quality").collect()
    s, y = np.array([r.score for r in got]), np.array([r.quality for r in got])
    assert len(got) > 50 and auc(s, y) > 0.8 and ((s >= 0) & (s <= 1)).all()


def test_dual_solver_reaches_the_primal_optimum():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(120):
        y = int(rng.integers(2)) * 2 - 1
        rows.append((np.array([0, 1, 2 + int(rng.integers(5))]), np.array([0.8 * y + rng.normal() * 0.5, rng.normal(), 0.3]), y))
    w, b = nbsvm.dual_coordinate_descent(rows, 8, passes=400)
    primal = lambda w, b: 0.5 * (w @ w + b * b) + nbsvm.COST * sum(max(0.0, 1 - y * (w[c] @ x + b)) for c, x, y in rows)
    best = primal(w, b)
    for _ in range(300):
        assert primal(w + rng.normal(size=8) * 0.02, b + rng.normal() * 0.02) >= best - 1e-3


def test_cells_do_not_depend_on_the_chunk():
    texts = ["A b, c 12 ##", "", "x", "A b, c 12 ##", "é ü"]
    cells, first = nbsvm.cells(pa.array(texts))
    for i, t in enumerate(texts):
        alone, _ = nbsvm.cells(pa.array([t]))
        assert np.array_equal(cells[first[i] : first[i + 1]], alone)


def test_logistic_orders_and_shrinks():
    a, b = nbsvm.logistic(np.array([-2.0, -1, 1, 2, 0.5]), np.array([-1, -1, 1, 1, -1]))
    assert a > 0 and 1 / (1 + np.exp(-(a * 2 + b))) > 0.6 > 1 / (1 + np.exp(-(a * -2 + b)))
    assert nbsvm.logistic(np.array([1.0]), np.array([1])) == (1.0, 0.0)


def test_defined_results(spark):
    df = data.frame(spark, data.awkward(), clash=True)
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 0), (None, 1), (5, 9), (3, None), (11, 1)], "doc_id long, quality int")
    out = nbsvm.score(df, nbsvm.fit(df, labels))
    assert out.count() == df.count() and all(0 <= r.score <= 1 for r in out.collect())
    by = {r.doc_id: r.score for r in out.collect()}
    assert by[1] == by[2] == by[3]
    flat = nbsvm.score(df, nbsvm.fit(df, labels.limit(0)))
    assert {round(r.score, 6) for r in flat.collect()} == {0.5}
    assert nbsvm.score(df.limit(0), nbsvm.fit(df.limit(0), labels)).count() == 0


def test_held_out_labels_are_not_read(spark):
    rng = random.Random(1)
    rows = [(i, data.sentence(rng, 20) + (" good" if i % 2 else " bad"), "en", "a", 1) for i in range(80)]
    df = data.frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    other = labels.withColumn("quality", F.when(common.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = nbsvm.fit(df, labels), nbsvm.fit(df, other)
    assert np.array_equal(a.weights, b.weights) and (a.bias, a.slope, a.offset) == (b.bias, b.slope, b.offset)


def plain_ngrams(text):
    """Words, pairs of words and triples of shapes as plain tuples, by a loop over words."""
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    lower = [w.lower() for w in words]
    shapes = []
    for i, w in enumerate(words):
        letters, capitals = len(re.findall(rb"[A-Za-z]", w)), len(re.findall(rb"[A-Z]", w))
        symbols = len(re.findall(rb"[!#$%&*+/<=>@\[\\\]^_`{|}~]", w))
        shapes.append((capitals > 1 and capitals == letters, symbols > 0, symbols == len(w), bool(re.search(rb"[0-9]", w)), i > 0 and lower[i] == lower[i - 1]))
    return {(w,) for w in lower} | set(zip(lower, lower[1:])) | {("shape", *s) for s in zip(shapes, shapes[1:], shapes[2:])}


def plain_model(rows):
    """rows: (n-grams, label, sets the curve), in order of doc_id. Ratios, weights and margins
    in dictionaries, without cells."""
    counts = {y: Counter(g for grams, label, _ in rows if label == y for g in grams) for y in (0, 1)}
    size = {y: nbsvm.CELLS + sum(counts[y].values()) for y in (0, 1)}
    ratio = {g: math.log((1 + counts[1][g]) / size[1]) - math.log((1 + counts[0][g]) / size[0]) for g in counts[0] | counts[1]}
    vector = lambda grams: {g: ratio[g] / math.sqrt(len(grams)) for g in grams}
    train = [(vector(grams), 2 * y - 1) for grams, y, curve in rows if not curve]
    weight, bias, alpha, rng = Counter(), 0.0, [0.0] * len(train), np.random.default_rng(0)
    for _ in range(nbsvm.PASSES):
        worst = 0.0
        for i in rng.permutation(len(train)):
            x, y = train[i]
            wrong = 1 - y * (sum(weight[g] * v for g, v in x.items()) + bias)
            new = min(nbsvm.COST, max(0.0, alpha[i] + wrong / (sum(v * v for v in x.values()) + 1)))
            for g, v in x.items():
                weight[g] += y * (new - alpha[i]) * v
            bias += y * (new - alpha[i])
            worst, alpha[i] = max(worst, abs(new - alpha[i])), new
        if worst < 1e-3:
            break
    margin = lambda grams: sum(weight[g] * ratio.get(g, 0) for g in grams) / math.sqrt(max(len(grams), 1)) + bias
    held = [(margin(grams), 2 * y - 1) for grams, y, curve in rows if curve]
    slope, offset = nbsvm.logistic(np.array([m for m, _ in held]), np.array([y for _, y in held]))
    return lambda grams: 1 / (1 + math.exp(-(slope * margin(grams) + offset)))


def test_scores_equal_plain_loops(spark):
    rng = random.Random(11)
    good, bad = "the cat sat on a mat 12 times é".split(), "BUY now $$$ *** FREE free 99% <a> cat the".split()
    text = lambda y: " ".join(rng.choice(good if rng.random() < (0.75 if y else 0.3) else bad) for _ in range(rng.randrange(1, 14)))
    rows = [(i, text(i % 2), i % 2) for i in range(90)] + [(90, None, 1), (91, "", 0), (92, " \t ", None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    curve = F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(5)) == 0
    split = {r.doc_id: (r.out, r.curve) for r in docs.select("doc_id", common.held_out().alias("out"), curve.alias("curve")).collect()}
    assert sum(o for o, _ in split.values()) > 5 and sum(c and not o for o, c in split.values()) > 5
    plain = plain_model([(plain_ngrams(t), y, split[i][1]) for i, t, y in rows if y is not None and not split[i][0]])
    got = {r.doc_id: r.score for r in nbsvm.score(docs, nbsvm.fit(docs, labels)).collect()}
    assert len(got) == len(rows) and all(abs(got[i] - plain(plain_ngrams(t))) < 1e-4 for i, t, _ in rows)
    assert max(got.values()) - min(got.values()) > 0.3
