"""The stages, each judged on its own input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from raterlake.llm import common

from ..conftest import SF
from . import data
from .test_decontam import brute as contaminated
from .test_line_dedup import brute as repeated
from .test_tjoin import shingles


@pytest.fixture(scope="module")
def staged(spark):
    docs, out = common.table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = common.materialise(stage(spark, docs, SF))
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_stages(spark, staged):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "mixing"]
    columns = common.table(spark, SF, "documents").columns
    assert all(after.columns == columns for n, (_, after) in staged.items() if n != "mixing")
    assert all(0 < after.count() <= before.count() for before, after in staged.values())
    whole = sorted(map(str, corpus_pipeline.run(spark, SF).collect()))
    assert whole == sorted(map(str, staged["mixing"][1].collect()))


def test_language_stage_keeps_plain_documents(staged):
    before, after = staged["language_id"]
    plain = before.filter("length(text) > 200 and lang is not null")
    kept = plain.join(after.select("doc_id"), "doc_id", "left_semi").count()
    assert kept >= 0.99 * plain.count()


def test_line_stage(staged):
    before, after = staged["line_dedup"]
    want = repeated([tuple(r) for r in before.collect()], 1, 5)
    lost = {k[0] for k, (n, gone) in want.items() if n and n == gone}
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == lost
    again = repeated([tuple(r) for r in after.collect()], 1, 5)
    assert sum(g for _, g in again.values()) < 0.1 * sum(g for _, g in want.values())


def test_join_stage_leaves_no_near_duplicates(staged):
    before, after = staged["ngram_jaccard_join"]
    sets = [(r.doc_id, shingles(r.text, 5)) for r in after.collect()]
    assert not [(a, b) for i, (a, s) in enumerate(sets) for b, r in sets[:i] if s and r and min(len(s), len(r)) >= 0.8 * max(len(s), len(r)) and 100 * len(s & r) >= 80 * len(s | r)]
    full = {r.doc_id: shingles(r.text, 5) for r in before.collect()}
    kept = {r.doc_id for r in after.collect()}
    for d in full.keys() - kept:  # each that went has a near duplicate
        assert any(100 * len(full[d] & s) >= 80 * len(full[d] | s) for e, s in full.items() if e != d)


def test_decontamination_stage(spark, staged):
    before, after = staged["benchmark_decontamination"]
    items = [tuple(r) for r in common.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    want = {r.doc_id for r in before.collect() if contaminated(r.text, items)}
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == want


def test_mixing_stage_keeps_all(staged):
    before, after = staged["mixing"]
    assert after.count() == before.count() and after.columns[: len(before.columns)] == before.columns
    assert after.select("mix_slot", "mix_place").distinct().count() == after.count()


def test_awkward_rows_pass_every_stage(spark):
    docs = data.frame(spark, data.awkward(), clash=True)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0
        docs = common.materialise(stage(spark, docs, SF))
    assert docs.filter(F.col("text").isNull()).count() == 0
