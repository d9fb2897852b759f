"""Language identification: held-out accuracy, defined results, optimiser and calibration."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from raterlake.llm import common, langid

from ..conftest import SF
from . import data


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(common.table(spark, SF, "documents"))


def test_held_out_accuracy_and_calibration(spark, model):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit(docs)
    rows = langid.predict(docs, model).join(docs.filter("lang is not null and text is not null"), "doc_id").filter(common.held_out() & (F.length("text") > 100) & (F.col("lang_pred") != "und"))
    got = rows.select("lang", "lang_pred", "score").collect()
    right = [r.lang == r.lang_pred for r in got]
    assert len(got) > 100 and np.mean(right) > 0.95
    assert abs(np.mean([r.score for r in got]) - np.mean(right)) < 0.08
    assert model.temperature > 0 and 0 < np.mean(model.weights != 0) < 0.9


def test_defined_results(spark, model):
    df = data.frame(spark, data.awkward(), clash=True)
    got = langid.predict(df, model)
    assert got.count() == df.count() and got.columns == ["doc_id", "lang_pred", "score"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, set()).add((r.lang_pred, r.score))
    assert by[1] == by[2] == by[3] == by[7] == {("und", 0.0)}
    assert all(x in model.langs and 0 <= s <= 1 for x, s in by[6] | by[5]) and len(by[None]) == 1
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 3, 7})


def test_empty_table_and_no_labels(spark):
    empty = data.frame(spark, [])
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    none = data.frame(spark, [(i, "some words", None, "a", 1) for i in range(20)])
    assert {tuple(r)[1:] for r in langid.predict(none, langid.fit(none)).collect()} == {("und", 0.0)}


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = [(i, data.sentence(np.random.RandomState(i) and __import__("random").Random(i), 20), "en" if i % 2 else "de", "a", 1) for i in range(60)]
    df = data.frame(spark, rows)
    other = df.withColumn("lang", F.when(common.held_out(), "zz").otherwise(F.col("lang")))
    a, b = langid.fit(df), langid.fit(other)
    assert a.langs == b.langs and np.array_equal(a.weights, b.weights) and a.temperature == b.temperature


def test_counts_in_pieces_equal_the_whole(monkeypatch):
    text = "Ünder the 12 brïdge, " * 50
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "_PIECE", 64)
    pieces = langid.counts(text)
    assert set(whole[0]) <= set(pieces[0]) and abs(int(whole[1].sum()) - int(pieces[1].sum())) < 0.3 * whole[1].sum()


def test_ftrl_finds_a_sparse_solution():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(600):
        y = int(rng.integers(2))
        rows.append((np.array([y, 2 + int(rng.integers(200))]), np.array([0.7, 0.7]), y))
    z, n = np.zeros((2, langid.CELLS)), np.zeros((2, langid.CELLS))
    for _ in range(3):
        langid.ftrl(rows, z, n)
    w = langid._weights(z, n)
    assert w[0, 0] > 0.5 and w[1, 1] > 0.5 and w[0, 1] < -0.5
    assert np.mean(w[:, 300:] != 0) == 0 and np.abs(w[:, 2:202]).max() < np.abs(w[:, :2]).max()


def test_temperature_is_no_end_of_the_grid():
    """Classes that part without error don't make every score certain, and the score of
    logits that are right as often as they say is left alone."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 300)
    apart = np.eye(3)[y] * 5
    t = langid._temperature(apart, y)
    assert langid.GRID[0] < t < langid.GRID[-1]
    p = np.exp(5 / t) / (np.exp(5 / t) + 2)
    assert 0.9 < p < 0.9999
    s = rng.normal(size=(4000, 3)) * 2
    p = np.exp(s) / np.exp(s).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert 0.8 < langid._temperature(s, y) < 1.25


def reference_counts(text):
    """Character 1- to 3-grams by plain loops, as codes of their characters."""
    chars = [c if c.isalpha() else " " for c in text.lower()]
    line = [c for i, c in enumerate(chars) if c != " " or not i or chars[i - 1] != " "]
    codes = [0] + [0 if c == " " else ord(c) for c in line] + [0]
    out = {}
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            gram = codes[i : i + n]
            if n == 1 and not gram[0]:
                continue
            x = 0
            for c in gram:
                x = (x * 0x9E3779B1 + c) % (1 << 64)
            cell = (((x + n) * 0x9E3779B97F4A7C15) % (1 << 64)) >> 49
            out[cell] = out.get(cell, 0) + 1
    return out


def test_features_and_ftrl_equal_plain_loops():
    import math

    rng = np.random.default_rng(5)
    texts = ["Ein Haus, ein Hund!", "the house and the dog", "una casa y un perro 12", "çà et là"]
    for t in texts:
        cells, n = langid.counts(t)
        assert dict(zip(cells.tolist(), n.tolist())) == reference_counts(t)
    idf = rng.random(langid.CELLS) + 1
    rows = [(*langid._vector(langid.counts(t), idf), i % 2) for i, t in enumerate(texts * 3)]
    z, n = np.zeros((2, langid.CELLS)), np.zeros((2, langid.CELLS))
    langid.ftrl(rows, z, n)
    zs, ns = [{}, {}], [{}, {}]

    def weight(k, c):
        if abs(zs[k].get(c, 0.0)) <= langid.L1:
            return 0.0
        return -(zs[k][c] - math.copysign(langid.L1, zs[k][c])) / ((langid.BETA + math.sqrt(ns[k].get(c, 0.0))) / langid.ALPHA + langid.L2)

    for cells, x, y in rows:
        w = [{c: weight(k, c) for c in cells.tolist()} for k in (0, 1)]
        score = [sum(w[k][c] * v for c, v in zip(cells.tolist(), x.tolist())) for k in (0, 1)]
        e = [math.exp(s - max(score)) for s in score]
        for k in (0, 1):
            for c, v in zip(cells.tolist(), x.tolist()):
                g, was = (e[k] / sum(e) - (k == y)) * v, ns[k].get(c, 0.0)
                zs[k][c] = zs[k].get(c, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / langid.ALPHA * w[k][c]
                ns[k][c] = was + g * g
    for k in (0, 1):
        assert all(abs(z[k, c] - v) < 1e-9 for c, v in zs[k].items()) and all(abs(n[k, c] - v) < 1e-9 for c, v in ns[k].items())
