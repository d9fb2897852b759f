"""Repeated windows against brute force, whatever the routing."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from raterlake.llm import common, superkmer

from ..conftest import SF, same
from . import data


def brute(rows, k):
    least, out = {}, []
    docs = [(doc, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for doc, text, *_ in rows]
    for doc, words in docs:
        for i in range(len(words) - k + 1):
            s = tuple(words[i : i + k])
            if doc is not None:
                least[s] = min(least.get(s, doc), doc)
    for doc, words in docs:
        gone = {j for i in range(len(words) - k + 1) if doc is not None and least[tuple(words[i : i + k])] < doc for j in range(i, i + k)}
        out.append((str(doc), len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone)))
    return sorted(out)


def result(df, k=13):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in superkmer.remove_repeated_windows(df, k).collect())


@pytest.mark.parametrize("seed, k", [(1, 13), (2, 5), (3, 3)])
def test_equals_brute_force(spark, seed, k):
    rows = data.copies(seed, 120)
    want = brute(rows, k)
    assert result(data.frame(spark, rows), k) == want and sum(r[2] for r in want) > 50


def test_routing_changes_nothing(spark, monkeypatch):
    rows = data.copies(7, 120)
    df = data.frame(spark, rows)
    want = brute(rows, 5)
    every = np.sort(np.unique(np.concatenate([superkmer._super_kmers(b, 5, 2, np.zeros(0, np.uint64))[1] for b in df.select("text").toArrow().to_batches()])))
    for hot in (np.zeros(0, np.uint64), every, every[::2]):
        monkeypatch.setattr(superkmer, "_hot_minimisers", lambda *a, hot=hot: hot)
        assert result(df, 5) == want


def test_hash_collisions_are_settled_by_the_words(spark, monkeypatch):
    rows = data.copies(5, 40)
    text = "".join(r[1] + "\n" for r in rows)
    raw = np.frombuffer(text.encode(), np.uint8)
    off = np.append(0, np.cumsum([len(r[1].encode()) + 1 for r in rows]))
    w = superkmer.kernels.find_words(raw, off)
    docs = np.array([r[0] for r in rows])
    want = superkmer.repeated_windows(w, docs, 4).tolist()
    real = superkmer.kernels.run_hashes
    monkeypatch.setattr(superkmer.kernels, "run_hashes", lambda *a: real(*a) % np.uint64(5))
    assert superkmer.repeated_windows(w, docs, 4).tolist() == want and want


def test_defined_results(spark):
    rows = data.awkward()
    got = result(data.frame(spark, rows, clash=True))
    assert got == brute(rows, 13)
    assert result(data.frame(spark, [])) == []


def test_query_equals_sql(spark, duck):
    from raterlake.llm import queries

    same(queries.op8_substring_dedup(spark, SF), duck, queries.oracle_sql()["op8_substring_dedup"])
    assert common.table(spark, SF, "documents").count() == queries.op8_substring_dedup(spark, SF).count()
