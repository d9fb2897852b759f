"""Periodic runs against a brute-force search, from small alphabets to whole documents."""

from __future__ import annotations

import random

import numpy as np
import pytest

from raterlake.llm import periodic, queries

from ..conftest import SF
from . import data


def brute(words: list, min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs; of the periods of one stretch, the smallest."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def repeats(rng: random.Random, n: int, k: int) -> list[int]:
    out: list[int] = []
    while len(out) < n:
        if out and rng.random() < 0.4:
            a = rng.randrange(len(out))
            out += out[a : a + rng.randint(1, 12)] * rng.randint(1, 4)
        else:
            out.append(rng.randrange(k))
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_core_equals_brute_force(k):
    rng = random.Random(k)
    for turn in range(150):
        text = repeats(rng, rng.randint(1, 70), k)
        if turn % 2:
            text.insert(rng.randrange(len(text) + 1), 1000)
        for least, exponent in ((2, 2), (6, 3), (2, 3)):
            got = [tuple(map(int, r)) for r in zip(*periodic.find_runs(np.array(text + [1001]), least, exponent))]
            assert got == sorted(brute(text, least, exponent), key=lambda r: (r[0], r[2]))


def test_core_on_fibonacci_words_and_powers():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    got = [tuple(map(int, r)) for r in zip(*periodic.find_runs(np.array(b + [7]), 2, 2))]
    assert got == sorted(brute(b, 2, 2), key=lambda r: (r[0], r[2]))
    for n, p in ((5000, 1), (5000, 37), (5000, 1666)):
        text = np.append(np.resize(np.random.default_rng(p).permutation(p), n), 9999)
        assert [x.tolist() for x in periodic.find_runs(text, 24, 3)] == [[0], [n], [p]]


def expected(text: str | None, least: int, exponent: int):
    words = data.split(text)
    runs = brute(words, least, exponent)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return words, runs, " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize(("least", "exponent"), [(24, 3), (6, 3), (5, 2), (16, 4)])
def test_documents_equal_brute_force(spark, least, exponent):
    rng, rows = random.Random(least), []
    for i in range(60):
        parts = [str(w) + ("é" if w % 2 else "") for w in repeats(rng, rng.randint(0, 120), rng.choice([2, 4, 30]))]
        rows.append((i, "".join(w + rng.choice([" ", "\n", "  \t"]) for w in parts), "en", "a", 1))
    out = {r.doc_id: r for r in periodic.collapse_runs(data.frame(spark, rows), least, exponent).collect()}
    for i, text, *_ in rows:
        words, runs, kept = expected(text, least, exponent)
        assert [tuple(r) for r in out[i].runs] == sorted(runs, key=lambda r: (r[0], r[2]))
        assert (out[i].n_words, out[i].collapsed, out[i].n_dropped) == (len(words), kept, len(words) - len(kept.split()))


def test_whole_texts_of_the_table_with_planted_runs(spark):
    docs = queries.with_planted_runs(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    out = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(out) == len(docs) and sum(r.n_runs > 0 for r in out.values()) > 0
    for d in docs:
        words = data.split(d.text)
        if len(words) > 1500:
            continue
        runs = brute(words, 24, 3)
        assert out[d.doc_id].n_runs == len(runs)
        if runs:
            top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))
            assert (out[d.doc_id].start, out[d.doc_id].length, out[d.doc_id].period, out[d.doc_id].exponent_milli) == (*top, 1000 * top[1] // top[2])


def test_long_text_is_one_run(spark):
    rng = random.Random(5)
    period = [f"w{rng.randrange(9000)}" for _ in range(31_000)]
    text = "start " + " ".join(period * 4 + period[:77]) + " end"
    out = periodic.collapse_runs(data.frame(spark, [(1, text, "en", "a", 1)])).first()
    assert [tuple(r) for r in out.runs] == [(1, 4 * 31_000 + 77, 31_000)] and out.collapsed == "start " + " ".join(period) + " end"


def test_defined_results(spark):
    rows = data.awkward()
    out = periodic.collapse_runs(data.frame(spark, rows, clash=True)).collect()
    assert sorted((str(r.doc_id), r.collapsed) for r in out) == sorted((str(r[0]), expected(r[1], 24, 3)[2] if r[1] is None or len(r[1]) < 5000 else " ".join(data.split(r[1]))) for r in rows)
    assert periodic.collapse_runs(data.frame(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.collapse_runs(data.frame(spark, rows), min_exponent=1)
