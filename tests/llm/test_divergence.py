"""The audit of sources against plain loops over exact integers."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from raterlake.llm import divergence

from . import data

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows: list[tuple], min_docs: int = 10, top: int = 10) -> list[tuple]:
    held, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
        sources[lang].add(source)
    out = []
    for lang, names in sources.items():
        kept = sorted((t for t, n in held[lang].items() if n >= min_docs), key=str.encode)
        v, whole = len(kept), Counter()
        share = lambda c, n: 1 + 1_000_000_000 * (c + 2) // (n + 2 * v)  # noqa: B023, E731
        for s in names:
            whole.update({t: counts[lang, s][t] for t in kept})
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        p = {s: {t: share(counts[lang, s][t], sum(counts[lang, s][x] for x in kept)) for t in kept} for s in names}
        for s in names:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode()) for o in names if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, i) for i, (value, item) in enumerate(found, 1)]
    return sorted(out)


def result(df) -> list[tuple]:
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def corpus(seed: int, n: int, n_sources: int) -> list[tuple]:
    rng, rows = random.Random(seed), []
    words = [a + b for a in data.WORDS for b in ("", "Ä", "日本", "x", "🙂")] + ["The", "THE", "the", "don't", "e-mail", "naïve"]
    for i in range(n):
        source = rng.choice(["hot"] * 3 + [f"s{k}" for k in range(n_sources)] + [None])
        text = rng.choice([" ", "1", "_", ","]).join(rng.choice(words[: rng.choice([5, 30, len(words)])]) for _ in range(rng.randint(0, 40)))
        rows.append((i, rng.choice([text, text, text, text, text, None]), rng.choice(["en", "de", None, "rare"]) if rng.random() < 0.9 else "zz", source, 1))
    return rows


@pytest.mark.parametrize(("chunk", "block"), [(1 << 14, 64), (16, 64), (8, 3)])
def test_equals_plain_loops(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "SOURCES", block)
    rows = corpus(chunk + block, 400, 9)
    assert result(divergence.audit(data.frame(spark, rows, clash=True))) == brute(rows)


def test_groups_without_terms_and_languages_without_vocabulary(spark):
    rows = [(i, "alpha beta", "en", "a", 1) for i in range(12)] + [(20, None, "en", "b", 1), (21, "12 34", "en", "c", 1), (22, "einmal", "de", "x", 1), (23, "zweimal", "de", "y", 1), (24, "solo", "fr", "only", 1)]
    out = result(divergence.audit(data.frame(spark, rows)))
    assert out == brute(rows)
    assert [r for r in out if r[0] == "de"] == [("de", "x", "pair", "y", 0, 1), ("de", "y", "pair", "x", 0, 1)] and not [r for r in out if r[0] == "fr"]


def test_shares_stay_exact_beyond_64_bits():
    import numpy as np

    for count, total, v in ((10**12, 3 * 10**12, 7), (5, 9 * 10**15 - 1000, 3), (0, 0, 1), (9 * 10**14, 9 * 10**14, 1)):
        assert divergence.shares(np.array([count]), np.array([total]), v).tolist() == [1 + 10**9 * (count + 2) // (total + 2 * v)]


def test_repeated_rows_and_empty_tables(spark):
    rows = data.awkward()
    rows += [(i, f"een twee drie {'vier' if i % 2 else ''}", "nl", f"s{i % 3}", 1) for i in range(40)]
    assert result(divergence.audit(data.frame(spark, rows, clash=True))) == brute(rows)
    assert divergence.audit(data.frame(spark, rows).limit(0)).count() == 0
