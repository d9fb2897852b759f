"""Pfair schedules: deviation below one block at every slot, and whole mixes."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest

from raterlake.llm import pfair

from . import data


@pytest.mark.parametrize("seed", range(12))
def test_schedules_are_fair(seed):
    rng = random.Random(seed)
    shares = {f"s{i}": rng.random() ** rng.choice([1, 4]) for i in range(rng.randint(1, 12))}
    period = rng.choice([60, 100, 997])
    weights = pfair.integer_weights(shares, period)
    assert sum(weights.values()) == period and min(weights.values()) >= 1
    order, done = pfair.schedule(weights), dict.fromkeys(weights, 0)
    for slot, name in enumerate(order):
        i, w = done[name], weights[name]
        assert i * period // w <= slot < -((-(i + 1) * period) // w)  # released, and in time
        done[name] += 1
        for k in weights:
            assert abs(done[k] - Fraction(weights[k] * (slot + 1), period)) < 1
    assert done == weights


def test_weights_follow_the_shares():
    w = pfair.integer_weights({"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}, 1000)
    assert abs(w["a"] - 500) <= 2 and abs(w["b"] - 300) <= 2 and w["d"] == 1
    assert pfair.integer_weights({f"s{i}": 1 for i in range(30)}, 10) == {f"s{i}": 1 for i in range(30)}
    assert pfair.target_shares({"a": 4, "b": 100, "c": 400}, {"a": 0.7, "zz": 0.3}) == pytest.approx({"a": 0.7, "b": 0.1, "c": 0.2})


def test_mix_is_whole_and_fair(spark):
    rng = random.Random(1)
    rows = [(i, data.sentence(rng, 3), "en", rng.choice(["big"] * 6 + ["small", None]), 1) for i in range(1500)]
    df = data.frame(spark, rows, clash=False)
    out = pfair.mix(df, {"big": 0.5, "small": 0.2}, block=8, period=50).collect()
    assert len(out) == len(rows) and {r.doc_id for r in out} == set(range(1500))
    places = {(r.mix_slot, r.mix_place) for r in out}
    assert len(places) == len(rows)  # no two documents at one place
    owner = {}
    for r in out:
        assert owner.setdefault(r.mix_slot, r.source) == r.source  # a slot holds one source
    for source in ("big", "small", None):
        n = sum(r.source == source for r in out)
        blocks = {}
        for r in out:
            if r.source == source:
                blocks.setdefault(r.mix_block, []).append(r.mix_place)
        assert sorted(blocks) == list(range(-(-n // 8)))
        assert all(sorted(p) == list(range(8)) for b, p in blocks.items() if b < n // 8)
    horizon = out[0].mix_horizon
    assert {r.mix_horizon for r in out} == {horizon} and horizon > 10
    done = dict.fromkeys(["big", "small", None], 0)
    target = {"big": 0.5, "small": 0.2, None: 0.3}
    for slot in range(horizon):
        done[owner[slot]] += 1
        assert all(abs(done[k] - target[k] * (slot + 1)) < 1 + 0.05 * (slot + 1) for k in done)


def test_small_buckets_give_places_to_all(spark, monkeypatch):
    monkeypatch.setattr(pfair, "BUCKET", 16)
    rows = [(i, "same", "en", "a", 1) for i in range(300)]
    out = pfair.mix(data.frame(spark, rows), block=4).collect()
    assert len({(r.mix_slot, r.mix_place) for r in out}) == 300


def test_defined_results(spark):
    df = data.frame(spark, data.awkward(), clash=True)
    out = pfair.mix(df)
    assert out.count() == df.count() and out.columns[: len(df.columns) - 1] == [c for c in df.columns if c != "mix_slot"]
    assert len({(r.mix_slot, r.mix_place) for r in out.collect()}) == df.count()
    assert pfair.mix(df.limit(0)).count() == 0
    assert pfair.mix(data.frame(spark, [(1, "a", "en", None, 1)])).first().mix_slot == 0


def test_thousands_of_sources(spark):
    """A source per host: small tables instead of an expression that grows with their number."""
    rng = random.Random(5)
    rows = [(i, f"text {i}", "en", f"host{rng.randrange(5000)}.example", 1) for i in range(9000)]
    out = pfair.mix(data.frame(spark, rows), block=2, period=1000).collect()
    assert len(out) == 9000 and len({(r.mix_slot, r.mix_place) for r in out}) == 9000
    owner = {}
    assert all(owner.setdefault(r.mix_slot, r.source) == r.source for r in out)


def brute_schedule(weights):
    """Earliest deadline first by looking at every source in every slot."""
    period, done, slots = sum(weights.values()), dict.fromkeys(weights, 0), []
    for slot in range(period):
        ready = []
        for name, w in weights.items():
            i = done[name]
            if i < w and i * period // w <= slot:
                ready.append((-((-(i + 1) * period) // w), (i + 1) * period % w == 0, -w, name))
        done[min(ready)[3]] += 1
        slots.append(min(ready)[3])
    return slots


@pytest.mark.parametrize("seed", range(6))
def test_schedule_equals_a_search_of_all_sources(seed):
    rng = random.Random(seed)
    weights = pfair.integer_weights({f"s{i}": rng.random() ** 3 for i in range(rng.randint(1, 20))}, rng.choice([20, 60, 97, 300]))
    assert pfair.schedule(weights) == brute_schedule(weights)


def test_the_query_puts_every_block_in_its_slot(spark, monkeypatch):
    """The registered query against slots worked out by plain loops, from the places it gives."""
    from raterlake.llm import queries

    from ..conftest import SF

    monkeypatch.setattr(pfair, "BUCKET", 16)
    monkeypatch.setattr(pfair, "RANGE", 2)
    rows = queries.op9_source_mixing(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()
    assert sorted((r.doc_id, r.source) for r in rows) == sorted(map(tuple, docs))
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + 1
    blocks = {s: -(-n // pfair.BLOCK) for s, n in sizes.items()}
    weights = pfair.integer_weights(pfair.target_shares(blocks), pfair.PERIOD)
    order = brute_schedule(weights)
    slots = {s: [i for i, x in enumerate(order) if x == s] for s in weights}
    places = {}
    for r in rows:
        places.setdefault(r.source, []).append(r.mix_block * pfair.BLOCK + r.mix_place)
        assert r.mix_slot == slots[r.source][r.mix_block % weights[r.source]] + len(order) * (r.mix_block // weights[r.source])
    assert all(sorted(p) == list(range(sizes[s])) for s, p in places.items())
    ends = [slots[s][(n - 1) % weights[s]] + len(order) * ((n - 1) // weights[s]) + 1 for s, n in blocks.items()]
    assert {r.mix_horizon for r in rows} == {min(ends)}
