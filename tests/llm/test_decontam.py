"""Spaced seeds against a brute-force comparison of all windows."""

from __future__ import annotations

import itertools
import random
import re

from raterlake.llm import decontam

from . import data


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(text, items):
    found = set()
    doc = tokens(text)
    for item_id, item in items:
        it = tokens(item)
        if item_id is None or len(it) < 5:
            continue
        span = min(decontam.WINDOW, len(it))
        need = span - decontam.tolerance(span)
        for i in range(len(doc) - span + 1):
            if any(sum(a == b for a, b in zip(doc[i : i + span], it[j : j + span])) >= need for j in range(len(it) - span + 1)):
                found.add(item_id)
                break
    return sorted(found)


def test_every_way_to_change_three_of_thirteen_leaves_a_mask():
    for changed in itertools.combinations(range(13), 3):
        same = [i not in changed for i in range(13)]
        assert any(all(same[s + i] for i, c in enumerate(m) if c == "1") for m in decontam.MASKS for s in range(13 - len(m) + 1))


def test_tolerance():
    assert [decontam.tolerance(n) for n in (5, 6, 13, 20)] == [0, 0, 3, 3]


def test_equals_brute_force(spark):
    rng = random.Random(2)
    items = [(i, data.sentence(rng, rng.choice([5, 8, 13, 20, 40]))) for i in range(25)]
    docs = []
    for i in range(150):
        words = data.sentence(rng, rng.randint(0, 60)).split()
        if rng.random() < 0.7:
            part = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
                part[rng.randrange(len(part))] = "other"
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() if rng.random() < 0.2 else w for w in part]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(words), "en", "a", 1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute(text, items) for i, text, *_ in docs}
    got = {r.whole.doc_id: list(r.item_ids) for r in decontam.contamination(data.frame(spark, docs), bench).collect()}
    assert got == want and 20 < sum(map(bool, want.values())) < 140


def test_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, data.sentence(rng, 15)) for i in range(20)]
    docs = data.frame(spark, [(i, data.sentence(rng, 5) + " " + items[i % 20][1], "en", "a", 1) for i in range(30)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    run = lambda: sorted((r.whole.doc_id, r.n_overlaps, tuple(r.item_ids)) for r in decontam.contamination(docs, bench).collect())
    one = run()
    monkeypatch.setattr(decontam, "BLOCK_TOKENS", 60)
    assert run() == one and all(n > 0 for _, n, _ in one)


def test_defined_results(spark):
    df = data.frame(spark, data.awkward(), clash=True)
    bench = spark.createDataFrame([(1, "another text under the same id"), (2, None), (None, "another text under the same id"), (3, ""), (1, "another text under the same id")], "item_id long, text string")
    out = decontam.contamination(df, bench)
    assert out.count() == df.count() and [r.whole.text for r in out.filter("n_overlaps > 0").collect()] == ["another text under the same id"]
    kept = decontam.remove_contaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == df.count() - 1
    assert decontam.remove_contaminated(df, bench.limit(0)).count() == df.count()
    assert decontam.remove_contaminated(df.limit(0), bench).count() == 0


def test_a_phrase_that_thousands_of_items_share():
    """Its hits are verified in slices; what is found is the same as item by item."""
    import pyarrow as pa

    rng = random.Random(12)
    phrase = data.sentence(rng, 12)
    items = [f"{data.sentence(rng, 8)} {phrase} {data.sentence(rng, 8)}" for _ in range(2000)]
    text = " ".join(f"{phrase} {data.sentence(rng, 3)}" for _ in range(80)) + " " + items[77]
    index = decontam.Index.of(list(range(2000)), items)
    sizes = [len(r) for r, _, _ in decontam.hits(*_hashed(text), index)]
    assert max(sizes) <= decontam.SLICE and sum(sizes) > 100_000
    some = rng.sample(range(2000), 40) + [77]
    found = decontam._found(pa.array([text, "clean words"]), index)
    assert [i in found[0] for i in some] == [bool(brute(text, [(i, items[i])])) for i in some] and not found[1]


def _hashed(text):
    import pyarrow as pa

    w = decontam._tokens(pa.array([text]))
    return decontam.kernels.word_hashes(w), w.row


def test_items_without_an_id(spark):
    bench = spark.createDataFrame([(None, "these nine words stand in no other text here")], "item_id long, text string")
    docs = data.frame(spark, [(1, "so: these nine words stand in no other text here!", "en", "a", 1), (2, "clean", "en", "a", 1)])
    assert sorted((r.whole.doc_id, r.n_overlaps, r.item_ids) for r in decontam.contamination(docs, bench).collect()) == [(1, 1, []), (2, 0, [])]
