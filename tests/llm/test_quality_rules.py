"""Base counts against plain Python; the divergence rule on made-up languages."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from raterlake.llm import common, quality_rules

from ..conftest import SF
from . import data

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def facts(df):
    return sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect())


def test_base_counts(spark):
    rng = random.Random(1)
    rows = [(i, (data.sentence(rng, rng.randint(6, 20)) + rng.choice(["\n", " \n \n", " # | "])) * rng.randint(1, 4) + data.sentence(rng, 9), "en", "a", 1) for i in range(80)]
    rows += [r for r in data.awkward() if r[0] not in (6, 8)] + [(900, "a " * 500, "en", "a", 1), (901, "\x0b\x0c\r a b   c", "en", "a", 1)]
    got = facts(quality_rules.judge(data.frame(spark, rows, clash=True)))
    assert got == sorted((str(r[0]), *brute(r[1])) for r in rows)


def test_base_counts_of_the_driver_table(spark):
    docs = common.table(spark, SF, "documents")
    got = quality_rules.judge(docs)
    assert facts(got) == sorted((str(r.doc_id), *brute(r.text)) for r in docs.collect())
    kept = got.filter("not base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert kept > 0.9


def test_long_texts(spark):
    rows = [r for r in data.awkward() if r[0] in (6, 8)]
    assert facts(quality_rules.judge(data.frame(spark, rows))) == sorted((str(r[0]), *brute(r[1])) for r in rows)


def test_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.0, 0.25, 0.75]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    got = spark.range(1).select(quality_rules.distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
    assert abs(got - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-12


def test_odd_documents_are_dropped_and_plain_ones_kept(spark):
    rng = random.Random(3)
    plain = [(i, ". ".join(data.sentence(rng, 12) + " the of and" for _ in range(10)), "en", "a", 1) for i in range(60)]
    odd = [(100, "QX#7 " * 200 + " ".join(f"{i}X{i * 7}" for i in range(100)), "en", "a", 1), (101, " ".join(f"<{i}> | {i * 31}" for i in range(200)), "en", "a", 1)]
    kept = {r.doc_id for r in quality_rules.judge(data.frame(spark, plain + odd)).filter("kept").collect()}
    assert kept == {r[0] for r in plain}


def test_empty_table(spark):
    assert quality_rules.judge(data.frame(spark, [])).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_thousands_of_languages(spark, monkeypatch, broadcast):
    """References are a table: many languages neither grow an expression nor need a broadcast."""
    if not broadcast:
        monkeypatch.setattr(quality_rules, "MAX_BROADCAST", 10)
    rng = random.Random(3)
    rows = [(i, data.sentence(rng, 60), f"l{i % 5000}", "a", 1) for i in range(5500)]
    out = quality_rules.judge(data.frame(spark, rows)).collect()
    assert len(out) == 5500 and all(r.word_distance is not None and r.char_distance is not None for r in out)
    lone = [r for r in out if r.lang == "l4000"]
    assert [round(r.word_distance, 9) for r in lone] == [0.0] and lone[0].kept  # the only document of a language is its reference
