"""Texts longer than a chunk of rows (3 MB) go through whole, with the results of short ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from raterlake.llm import common, decontam, langid, nbsvm, pii, quality_rules

from ..conftest import SF
from . import data, test_quality_rules, test_superkmer, test_tjoin

WORDS = 720_000


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(8)
    out = "\n".join(data.sentence(rng, 15) for _ in range(WORDS // 15))
    assert len(out) > 3 << 20
    return out


@pytest.fixture(scope="module")
def rows(long_text):
    part = long_text[: int(len(long_text) * 0.9)].rsplit(" ", 1)[0]
    small = data.sentence(random.Random(9), 40)
    return [(5, long_text + " one more", "en", "a", 1), (2, long_text, "en", "a", 1), (9, part, "en", "a", 1), (7, small, "en", "b", 1), (3, small + " end", "en", "b", 1), (1, None, None, None, None)]


def test_windows_of_long_texts(spark, rows):
    got = test_superkmer.result(data.frame(spark, rows))
    assert got == test_superkmer.brute(rows, 13)
    assert {r[0]: r[2] for r in got} == {"1": 0, "2": 0, "3": 0, "5": WORDS, "7": 40, "9": len(rows[2][1].split())}


def test_links_of_long_texts(spark, rows):
    assert test_tjoin.result(data.frame(spark, rows), 4, 85) == test_tjoin.brute(rows, 4, 85)


def test_counts_of_long_texts(spark, rows):
    got = test_quality_rules.facts(quality_rules.judge(data.frame(spark, rows[1:5])))
    assert got == sorted((str(r[0]), *test_quality_rules.brute(r[1])) for r in rows[1:5])


def test_spans_at_the_end_of_a_long_text(spark, long_text):
    text = "é" + long_text + " mail jo@example.com or jo at example dot org"
    [row] = pii.detect(data.frame(spark, [(1, text, "en", "a", 1)])).collect()
    at = text.index("jo@")
    assert row.n_email >= 1 and f"email:{at}:{at + 14}" in row.spans.split(",") and f"email:{text.index('jo at')}:{len(text)}" in row.spans.split(",")


def test_passages_at_the_end_of_a_long_text(spark, long_text):
    item = data.sentence(random.Random(10), 20)
    docs = [(1, long_text + "\n" + item, "en", "a", 1), (2, long_text, "en", "a", 1), (3, item, "en", "a", 1)]
    got = decontam.contamination(data.frame(spark, docs), spark.createDataFrame([(77, item)], "item_id long, text string"))
    assert {r.whole.doc_id: list(r.item_ids) for r in got.collect()} == {1: [77], 2: [], 3: [77]}


def test_long_copies_are_judged_like_short_ones(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    langs, quality = langid.fit(docs), nbsvm.fit(docs, labels)
    some = [r.text for r in docs.filter(F.length("text") > 400).orderBy("doc_id").limit(3).collect()]
    rows = [(n, "\n".join([t] * (1 + n // 10 * (3_300_000 // len(t)))), "en", "a", 1) for i, t in enumerate(some) for n in (i, 10 + i)]
    df = data.frame(spark, rows)
    lang = {r.doc_id: r.lang_pred for r in langid.predict(df, langs).collect()}
    score = {r.doc_id: r.score for r in nbsvm.score(df, quality).collect()}
    assert all(lang[i] == lang[10 + i] and abs(score[i] - score[10 + i]) < 0.1 for i in range(3))
