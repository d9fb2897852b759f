"""Hand-made cases with known results."""

from __future__ import annotations

import hashlib
import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from raterlake import schema
from raterlake.errors import EngineError
from raterlake.functions import ids, jsons, numbers, seeds
from raterlake.operators import export, leak, ledger, panel, planning, rater, references, scoring, screening, status
from raterlake.operators import trials as trial_ops


def one(df):
    return df.collect()[0][0]


# ---------------------------------------------------------------- functions


def test_seeds(spark):
    want = int(hashlib.sha256(b"7:order:main/p1-m1/r1").hexdigest()[:8], 16) & 0x7FFFFFFF
    assert seeds.derive(7, "order", "main/p1-m1/r1") == want
    assert one(spark.range(1).select(seeds.derived(7, "order", F.lit("main/p1-m1/r1")))) == want


def test_shuffle_is_a_permutation_and_depends_on_the_seed_only(spark):
    df = spark.range(40).select(F.col("id").alias("seed"), F.lit(17).alias("n"), seeds.shuffled(F.col("id"), F.lit(17)).alias("p"))
    got = {r.seed: list(r.p) for r in df.collect()}
    assert all(sorted(p) == list(range(17)) for p in got.values()) and len({tuple(p) for p in got.values()}) > 30
    assert got == {r.seed: list(r.p) for r in df.repartition(7).collect()}


@pytest.mark.parametrize("text, want", [("1.250000", "1.25"), ("5", "5"), ("0.000", "0"), ("100", "100"), (None, "none"), ("-0.00", "0"), ("0.000001", "0.000001")])
def test_usd(spark, text, want):
    assert one(spark.createDataFrame([(text,)], "x string").select(numbers.usd(numbers.money("x")))) == want


def test_money_refuses_other_text(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("abc",)], "x string").select(numbers.money("x")).collect()


def test_rates(spark):
    row = spark.range(1).select(numbers.invalid_rate(F.lit(0), F.lit(0)).alias("a"), numbers.invalid_rate(F.lit(3), F.lit(1)).alias("b"), numbers.pass_ratio(F.lit(0), F.lit(0)).alias("c")).first()
    assert row.a is None and row.b == 0.25 and row.c == 0.0


def test_small_functions(spark):
    row = spark.range(1).select(
        numbers.likert(F.lit(0.999), 5).alias("top"), numbers.likert(F.lit(0.0), 5).alias("low"), numbers.encoded_bytes(F.lit(4), True).alias("b64"), numbers.encoded_bytes(F.lit(4), False).alias("raw"),
        numbers.frame_rate(F.lit("30000/1001")).alias("ntsc"), numbers.frame_rate(F.lit("0/0")).alias("none"), numbers.frame_rate(F.lit("25")).alias("pal"),
        numbers.backoff(F.lit(3), 2.0, 60.0, F.lit(1.0)).alias("third"), numbers.backoff(F.lit(9), 2.0, 60.0, F.lit(0.0)).alias("capped"), numbers.is_price(F.lit("1.5")).alias("price"), numbers.is_price(F.lit("1e5")).alias("power"),
    ).first()
    assert (row.top, row.low, row.b64, row.raw, row.none, row.pal, row.third, row.capped, row.price, row.power) == (5, 1, 8, 4, None, 25.0, 8.0, 30.0, True, False)
    assert abs(row.ntsc - 29.97003) < 1e-4


def test_names(spark):
    df = spark.createDataFrame([("s12",), ("s0",), ("t1",), (None,)], "x string").select("x", ids.run_number("x").alias("n"), ids.test_name_problem("x").alias("p"))
    assert {r.x: (r.n, r.p) for r in df.collect()} == {"s12": (12, "reserved_run_id"), "s0": (0, None), "t1": (0, None), None: (0, "empty")}
    texts = ["p10-m1", "p2-m1", "*", "p2-m10", "p2-m2", "a"]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "x string").orderBy(ids.natural_key("x")).collect()]
    assert got == ["*", "a", "p2-m1", "p2-m2", "p2-m10", "p10-m1"]


def test_condition_parts(spark):
    df = spark.createDataFrame([(" speed = fast=er ",), ("x",), ("=a",), ("a=",)], "x string").select(ids.condition_parts("x").alias("p"))
    assert [tuple(r.p) if r.p else None for r in df.collect()] == [("speed", "fast=er"), None, None, None]


def test_canonical_json(spark):
    assert jsons.canonical({"b": [1, {"z": None, "a": "é"}], "a": True}) == '{"a":true,"b":[1,{"a":"é","z":null}]}'
    assert one(spark.createDataFrame([('{"b": 1, "a": 2}',)], "x string").select(jsons.stamp(F.col("x")))) == hashlib.sha256(b'{"a":2,"b":1}').hexdigest()


# ---------------------------------------------------------------- validation

ITEMS = [("t", "like", "likert", 5, None, 0), ("t", "pick", "pairwise", None, ["A", "B"], 1), ("t", "why", "free_text", None, None, 2)]
ITEM_SCHEMA = "instrument string, item_id string, type string, points int, options array<string>, pos int"
GOOD = '{"like": 3, "pick": "A", "why": "so"}'


@pytest.mark.parametrize(
    "raw, want",
    [
        (GOOD, None), (f"```json\n{GOOD}\n```", None), (f"  {GOOD}\n", None), (f"{GOOD} {GOOD}", "not_json"), (f"so: {GOOD}", "not_json"), (None, "not_json"), ("", "not_json"), ("[1]", "not_object"), ("4", "not_object"), ("NaN", "not_json"),
        (f"```\n{GOOD}\n```\n```\n{GOOD}\n```", "not_json"), ('{"like": 3, "like": 3, "pick": "A", "why": "so"}', "duplicate_item"), ('{"like": 3, "pick": "A", "why": "so", "z": 1}', "unknown_item"), ('{"like": 3, "z": 1}', "unknown_item"),
        ('{"like": 3, "pick": "A"}', "missing_item"), ('{"like": true, "pick": "A", "why": "so"}', "wrong_type:like"), ('{"like": 3.0, "pick": "A", "why": "so"}', "wrong_type:like"), ('{"like": "3", "pick": "A", "why": "so"}', "wrong_type:like"),
        ('{"like": 6, "pick": "A", "why": "so"}', "out_of_range:like"), ('{"like": 0, "pick": "C", "why": "so"}', "out_of_range:like"), (f'{{"like": {"9" * 60}, "pick": "A", "why": "so"}}', "out_of_range:like"), ('{"like": 3, "pick": "a", "why": "so"}', "bad_choice:pick"),
        ('{"like": 3, "pick": 1, "why": "so"}', "wrong_type:pick"), ('{"like": 3, "pick": "A", "why": " \\n"}', "empty_text:why"), ('{"like": 3, "pick": "A", "why": null}', "wrong_type:why"), ('{"why": {"a": 1, "a": 2}, "like": 1, "pick": "A"}', "wrong_type:why"),
    ],
)
def test_validation_truth_table(spark, raw, want):
    df = spark.createDataFrame([("t", raw)], "instrument string, raw string")
    row = scoring.validated(df, spark.createDataFrame(ITEMS, ITEM_SCHEMA)).first()
    assert row.problem == want and (row.answers is None) == (want is not None)


# ---------------------------------------------------------------- trials


def attempts(spark, rows):
    full = [(r.get("t", "x"), r.get("n", 1), 5, r.get("handle"), r.get("sent"), None, r.get("category"), r.get("valid"), None, r.get("answer")) for r in rows]
    return spark.createDataFrame(full, "trial_id string, attempt int, seed long, handle string, sent_at string, answered_at string, category string, valid boolean, invalid_reason string, answer_json string")


def settles(spark, state, rows, retries=1, transient=1):
    trials = spark.createDataFrame([("x", "t", state)], "trial_id string, test string, state string")
    return trial_ops.settlement(trials, attempts(spark, rows), retries, transient).first().settles_to


OK, BAD, SLOW = {"category": "ok", "valid": True}, {"category": "ok", "valid": False}, {"category": "transient"}
OPEN = {"handle": "h", "sent": "now"}


@pytest.mark.parametrize(
    "state, rows, want",
    [
        ("sent", [], None), ("sent", [OK | {"n": 1}], "valid"), ("sent", [BAD | {"n": 1}], None), ("sent", [BAD | {"n": 1}, BAD | {"n": 2}], "invalid"), ("sent", [SLOW | {"n": 1}, SLOW | {"n": 2}], "failed"),
        ("sent", [BAD | {"n": 1}, SLOW | {"n": 2}], None), ("sent", [BAD | {"n": 1}, SLOW | {"n": 2}, {"n": 3}], "failed"), ("sent", [BAD | {"n": 1}, SLOW | {"n": 2}, OPEN | {"n": 3}], None), ("planned", [{"n": 3}], "failed"),
        ("sent", [{"n": 1}, {"n": 2}, BAD | {"n": 3}], "invalid"), ("sent", [{"n": 1}, {"n": 2}, SLOW | {"n": 3}], "failed"), ("sent", [OPEN | {"n": 1}], None), ("valid", [OK], "-"),
    ],
)
def test_settlement_truth_table(spark, state, rows, want):
    if want == "-":
        trials = spark.createDataFrame([("x", "t", state)], "trial_id string, test string, state string")
        assert trial_ops.settlement(trials, attempts(spark, rows)).count() == 0
    else:
        assert settles(spark, state, rows) == want


def test_answer_is_the_highest_valid_attempt(spark):
    a = attempts(spark, [OK | {"n": 1, "answer": "1"}, OK | {"n": 2, "answer": "2"}, BAD | {"n": 3}])
    assert tuple(trial_ops.chosen_answer(a).first())[1::2] == (2, "2")


def test_running_sum_equals_a_single_window(spark):
    rng = random.Random(1)
    rows = [(i, Decimal(rng.randint(-500, 900)) / 100) for i in rng.sample(range(10_000), 700)]
    got = {r.k: r.s for r in ledger.running_sums(spark.createDataFrame(rows, "k long, v decimal(18,2)"), ["k"], "v", "s").collect()}
    total, want = Decimal(0), {}
    for k, v in sorted(rows):
        total += v
        want[k] = total
    assert got == want


# ---------------------------------------------------------------- scoring


def test_fidelity_is_strict_at_the_midpoint_and_reverses(spark):
    keys = spark.createDataFrame([("a", "warm", False, 5), ("b", "warm", True, 5)], "item_id string, construct string, reversed boolean, points int")
    poles = spark.createDataFrame([("x", "warm", "high"), ("y", "warm", "high"), ("z", "warm", "low"), ("w", "warm", "low")], "agent_id string, construct string, pole string")
    answers = spark.createDataFrame([("x", "a", 4), ("x", "b", 2), ("y", "a", 3), ("y", "b", 3), ("z", "a", 1), ("z", "b", 9)], "agent_id string, item_id string, value int")
    got = {r.agent_id: (r.score, r.n, r.matches) for r in scoring.fidelity_constructs(answers, keys, poles).collect()}
    assert got == {"x": (4.0, 2, True), "y": (3.0, 2, False), "z": (1.0, 1, True), "w": (None, 0, False)}
    planned = spark.createDataFrame([("warm", 4)], "construct string, planned int")
    short = {r.agent_id: (r.insufficient, r.matched) for r in scoring.fidelity_scores(answers, keys, poles, planned).collect()}
    assert short == {"x": (0, 1), "y": (0, 0), "z": (1, 0), "w": (1, 0)}


CHECKS = [(0, "pick", "q", True, ["b", "a"], "a"), (1, "rate", "r", False, ["a", "b"], "b"), (2, "rate", "r", False, ["c"], "4"), (3, "rate", "r", False, ["d"], "4")]
CHECK_SCHEMA = "pos int, instrument string, item_id string, pairwise boolean, clips array<string>, expected string"


def test_perception_units(spark):
    trials = [
        ("m1", 1, "pick", ["a", "b"], "q", "a", "string", "valid"), ("m1", 1, "pick", ["b", "a"], "q", "b", "string", "valid"), ("m1", 1, "rate", ["a"], "r", "2", "int", "valid"), ("m1", 1, "rate", ["b"], "r", "3", "int", "valid"),
        ("m1", 1, "rate", ["c"], "r", "4", "int", "valid"), ("m1", 1, "rate", ["d"], "r", "4", "int", "invalid"), ("m2", 1, "rate", ["a"], "r", "3", "int", "valid"), ("m2", 1, "rate", ["b"], "r", "3", "int", "valid"),
    ]
    t = spark.createDataFrame(trials, "model_id string, repeat int, instrument string, clip_ids array<string>, item_id string, answer string, kind string, state string")
    checks = spark.createDataFrame(CHECKS, CHECK_SCHEMA)
    got = {(r.model_id, r.instrument): (r.passed, r.units, r.outcome) for r in scoring.perception_scores(t, checks, 0.6).collect()}
    assert got == {("m1", "pick"): (1, 2, "fail"), ("m1", "rate"): (2, 3, "pass"), ("m2", "pick"): (0, 2, "fail"), ("m2", "rate"): (0, 3, "fail")}
    assert {r.instrument: r.n_pair_checks for r in scoring.pair_check_counts(checks).collect()} == {"pick": 1, "rate": 1}
    shapes = scoring.perception_shapes(checks).collect()
    assert sorted((r.instrument, tuple(r.clip_ids), r.position) for r in shapes if r.instrument == "pick") == [("pick", ("a", "b"), 1), ("pick", ("b", "a"), 2)]
    assert len(shapes) == 6


# ---------------------------------------------------------------- screening

RUNS = [("s1", "perception", "t", "complete"), ("s2", "fidelity", None, "complete"), ("s3", "perception", "t", "complete"), ("s4", "perception", "t", "open")]


def gate(spark, results, needed=("look",)):
    runs = spark.createDataFrame(RUNS, "run_id string, kind string, screening_test string, status string")
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(results)], "pos long, run_id string, model_id string, agent_id string, instrument string, outcome string, settings_hash string, instrument_hash string, pair_checks int")
    settings = spark.createDataFrame([("m1", "S"), ("m2", "S")], "model_id string, cur_settings string")
    stamps = spark.createDataFrame([("look", "I"), ("fidelity", "I")], "instrument string, cur_instrument string")
    agents = spark.createDataFrame([("p1", "m1"), ("p2", "m1"), ("p1", "m2")], "persona_id string, model_id string")
    needed = spark.createDataFrame([(n, i) for i, n in enumerate(needed)], "instrument string, pos int")
    return {r.agent_id: r.reason for r in screening.eligibility(agents, needed, rows, runs, settings, stamps).collect()}


def look(run, model, outcome, s="S", i="I"):
    return (run, model, None, "look", outcome, s, i, 2)


def fid(agent, outcome, s="S", i="I"):
    return ("s2", agent.split("-")[1], agent, "fidelity", outcome, s, i, None)


def test_gate(spark):
    every = [fid("p1-m1", "pass"), fid("p2-m1", "fail"), fid("p1-m2", "pass")]
    assert gate(spark, [look("s1", "m1", "pass"), look("s1", "m2", "pass"), *every]) == {"p1-m1": None, "p2-m1": "fidelity_fail", "p1-m2": None}
    # a newer stale row does not hide an older one that still counts; an open run never counts
    assert gate(spark, [look("s1", "m1", "pass"), look("s3", "m1", "fail", "old"), look("s4", "m2", "pass"), *every])["p1-m1"] is None
    assert gate(spark, [look("s4", "m2", "pass"), *every])["p1-m2"] == "perception_missing"
    # a fail comes before everything, stale before missing
    assert gate(spark, [look("s1", "m1", "pass"), look("s3", "m1", "fail"), look("s1", "m2", "pass", i="old"), *every]) == {"p1-m1": "perception_fail", "p2-m1": "perception_fail", "p1-m2": "screening_stale"}
    assert gate(spark, [look("s1", "m1", "pass"), look("s1", "m2", "pass"), fid("p1-m1", "pass", s="old")]) == {"p1-m1": "screening_stale", "p2-m1": "fidelity_missing", "p1-m2": "fidelity_missing"}


def test_supersession_equals_the_rule_played_through(spark):
    rng = random.Random(3)
    for _ in range(4):
        runs = [(f"s{n}", rng.choice(["a", "b"]), None, "complete") for n in range(1, 8)]
        keys = {r[0]: {(rng.choice("xyz"), rng.choice("mn")) for _ in range(rng.randint(0, 3))} for r in runs}
        rows = [(i, run, m, None, x, "pass", "S", "I", 1) for i, (run, x, m) in enumerate((run, x, m) for run, k in keys.items() for x, m in sorted(k))]
        rdf = spark.createDataFrame(runs, "run_id string, kind string, screening_test string, status string")
        df = spark.createDataFrame(rows, "pos long, run_id string, model_id string, agent_id string, instrument string, outcome string, settings_hash string, instrument_hash string, pair_checks int")
        want = {}
        for n, (run, kind, _, _) in enumerate(runs):  # runs complete in the order of their numbers
            for old, old_kind, _, _ in runs[:n]:
                later = set().union(*(keys[r] for r, k, _, _ in runs[: n + 1] if k == old_kind and int(r[1:]) > int(old[1:])))
                if old not in want and kind == old_kind and keys[old] <= later:
                    want[old] = run
        got = {r.run_id: r.superseded_by for r in screening.supersession(df, rdf).collect() if r.superseded}
        assert got == want


# ---------------------------------------------------------------- planning


def test_plan_of_3072_trials(spark):
    clips = spark.createDataFrame([(c, i) for i, c in enumerate(["c2", "c10", "c1", "c3"])], "clip_id string, pos int")
    instruments = spark.createDataFrame([("rate", False, False, 0), ("pick", True, False, 1)], "instrument string, pairwise boolean, self_report boolean, pos int")
    shapes = planning.canonical_shapes(clips, instruments)
    assert shapes.count() == 4 + 12
    pairs = [tuple(r.clip_ids) for r in shapes.filter("position = 1").orderBy("place").collect()]
    assert pairs == [tuple(sorted(p)) for p in itertools.combinations(["c2", "c10", "c1", "c3"], 2)]
    personas = spark.range(1, 65).select(F.concat(F.lit("p"), "id").alias("id"))
    sessions = planning.sessions("main", personas, spark.createDataFrame([("m1", 0)], "model_id string, pos int"), 3, 1)
    variants = spark.createDataFrame([("rate", ["a", "b"]), ("pick", ["a"])], "instrument string, variants array<string>")
    plan = planning.plan_trials(sessions, shapes, variants)
    assert plan.count() == 3072 and plan.select("session_id").distinct().count() == 192 and plan.select("trial_id").distinct().count() == 3072
    row = plan.filter("persona_id = 'p1' and repeat = 2").orderBy("trial_index").collect()
    order = seeds.deal(16, random.Random(seeds.derive(1, "order", "main/p1-m1/r2")))
    by_place = {r.place: tuple(r.clip_ids) for r in shapes.collect()}
    assert [tuple(r.clip_ids) for r in row] == [by_place[k] for k in order]
    assert {r.prompt_variant for r in row if r.instrument == "rate"} == {"b"}


def test_fractions(spark):
    assert [planning.profiles(spark, f).count() for f in ("1", "1/2", "1/4")] == [32, 16, 8]
    half = {r.alias for r in planning.aliases(spark, "1/2").collect()}
    assert len(half) == 15 and "O=CEAN" in half
    quarter = {r.alias for r in planning.aliases(spark, "1/4").collect()}
    assert len(quarter) == 7 and all(a.count("=") == 3 for a in quarter) and "O=CA=EN=OCEAN" in quarter


QUOTAS = {"age_band": ["x", "y", "z"], "gender": ["w", "m"], "cultural_region": ["e", "n", "s"], "robot_experience": ["none", "some"]}


def test_panel_quotas(spark):
    df = panel.generate(spark, 1, QUOTAS, ["low", "high"], "1", 2)
    rows = sorted(df.collect(), key=lambda r: r.number)
    assert [r.id for r in rows] == [f"p{i + 1}" for i in range(128)] and [r.nars for r in rows[:2]] == ["low", "high"]
    for q, levels in QUOTAS.items():
        for band in ("low", "high"):
            n = [sum(r[q] == level and r.nars == band for r in rows) for level in levels]
            assert sum(n) == 64 and max(n) - min(n) <= 1
    for a, b in zip(rows[0::4], rows[2::4]):  # the two copies of a profile in the first band
        assert [a[t] for t in schema.TRAITS] == [b[t] for t in schema.TRAITS] and [a[q] for q in QUOTAS] != [b[q] for q in QUOTAS]
    assert rows == sorted(panel.generate(spark, 1, QUOTAS, ["low", "high"], "1", 2).collect(), key=lambda r: r.number)
    assert panel.quota_gaps(df, spark.createDataFrame([("gender", "w"), ("gender", "q")], "attribute string, level string")).count() == 2


def test_cards_and_cues(spark):
    wording = {"demographic": "You are {gender}, {age_band}, {cultural_region}, {robot_experience}.", "level_phrases": {q: {v: v.upper() for v in QUOTAS[q]} for q in QUOTAS}, "traits": {t: {"high": f"{t} up", "low": f"{t} down"} for t in schema.TRAITS}, "nars": {"low": "calm", "high": "tense"}}
    df = panel.generate(spark, 1, QUOTAS, None, "1/4").withColumn("card", panel.card(wording))
    first = df.filter("number = 1").first().card
    assert first.startswith("You are ") and first.count("\n") == 6 and first.endswith("\n") and "{" not in first
    sentences = spark.createDataFrame([(f"{t} {w}", t, p) for t in schema.TRAITS for w, p in (("up", "high"), ("down", "low"))], "sentence string, construct string, pole string")
    assert panel.card_cues(df, sentences).count() == 8 * 5


def test_cost_and_media(spark):
    trials = spark.createDataFrame([("x", "t", "m1", ["a"], 400), ("y", "t", "m1", ["a", "b"], 401)], "trial_id string, test string, model_id string, clip_ids array<string>, chars int")
    clips = spark.createDataFrame([("a", 2.5, 10), ("b", 3.0, 20)], "clip_id string, duration_s double, size_bytes long")
    prices = spark.createDataFrame([("m1", "alpha", "1.25", "5", "263", "4", 100)], "model_id string, provider string, input_usd string, output_usd string, media_rate string, chars_per_token string, max_output_tokens long")
    tokens = {r.trial_id: r.tokens_in for r in planning.trial_estimates(trials, clips, prices).collect()}
    assert tokens == {"x": 658 + 100, "y": 1447 + 101}
    row = planning.cost_estimate(trials, clips, prices, 2, 3).first()
    want = (Decimal(758 + 1548) * Decimal("1.25") + 200 * 5) / 1_000_000
    assert (row.expected, row.worst_case, row.trials, row.providers) == (want, want * 6, 2, "alpha")
    shapes = spark.createDataFrame([("rate", False, ["a"], ["a", "b"]), ("pick", True, [], ["a", "b"])], "instrument string, pairwise boolean, practice array<string>, targets array<string>")
    limits = spark.createDataFrame([("m1", 0, 5.5, 27, True)], "model_id string, pos int, max_seconds double, max_bytes long, base64 boolean")
    got = {(r.instrument, r.limit): (r.total, list(r.picked), r.exceeds) for r in planning.media_worst_case(shapes, clips, limits).collect()}
    assert got == {("rate", "max_seconds"): (5.5, ["b"], False), ("rate", "max_bytes"): (44.0, ["b"], True), ("pick", "max_seconds"): (5.5, ["b", "a"], False), ("pick", "max_bytes"): (44.0, ["b", "a"], True)}


# ---------------------------------------------------------------- reports


def test_leak_report_equals_all_pairs(spark):
    rng = random.Random(5)
    clips = [(f"c{i}", rng.uniform(1, 9), rng.choice([640, 656]), rng.choice([25.0, 25.005, 30.0]), None if i % 5 == 0 else rng.uniform(-25, -20)) for i in range(40)]
    key = [(f"c{i}", f, rng.choice(levels), i) for i in range(44) for f, levels in (("speed", ["fast", "slow", "mid"]), ("one", ["only"]))]
    df = leak.leak_report(spark.createDataFrame(key, "clip_id string, factor string, level string, pos long"), spark.createDataFrame(clips, "clip_id string, duration_s double, width int, fps double, loudness_lufs double"), {"duration_s": 0.5, "width": 9.0, "fps": 9.0, "loudness_lufs": 0.5})
    by_id = {c[0]: dict(zip(("duration_s", "width", "fps", "loudness_lufs"), c[1:])) for c in clips}
    for r in df.collect():
        values = {}
        for c, f, level, _ in key:
            if f == r.factor and c in by_id and by_id[c][r.metric] is not None:
                values.setdefault(level, []).append(by_id[c][r.metric])
        mean = lambda v: sum(v) / len(v)
        own, others = values[r.level], [v for k, v in values.items() if k != r.level]
        exact = r.metric in leak.EXACT
        diffs = [abs(a - b) for v in others for a in own for b in v] if exact else [abs(mean(own) - mean(v)) for v in others]
        assert r.n == len(own) and (r.max_diff is None) == (not diffs)
        if diffs:
            assert abs(r.max_diff - max(diffs)) < 1e-9 and r.flagged == (r.max_diff > r.tolerance)


def test_csv_bytes(spark, tmp_path):
    df = spark.createDataFrame([(' a "b", c\nd ', None, ""), ("é", "x", "1")], "p string, q string, r string")
    export.write_together(spark, {"tidy": df}, str(tmp_path / "out"), single_file=True)
    [part] = (tmp_path / "out/tidy").glob("part-*")
    assert part.read_text() == 'p,q,r\n" a ""b"", c\nd ",,\né,x,1\n'
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["tidy"]


def test_export_refusals(spark):
    t = spark.createDataFrame([("a", "valid"), ("b", "sent")], "test string, state string")
    for test, kind, code in (("a", "screening", "screening_not_exportable"), ("zz", "main", "nothing_to_export"), ("b", "main", "sessions_running")):
        with pytest.raises(EngineError) as err:
            export.check_exportable(t, test, kind)
        assert err.value.code == code
    export.check_exportable(t, "a", "main")


def test_empty_tables(spark):
    t = spark.createDataFrame([], schema.TABLES["trials"])
    led = spark.createDataFrame([], schema.TABLES["ledger"])
    assert status.status_rollup(t, led).count() == 0
    assert ledger.committed(led).first()[0] == 0 and ledger.current_ceiling(spark.createDataFrame([], schema.TABLES["ceiling_changes"])).first()[0] is None
    assert references.duplicates(t, ["trial_id"]).count() == 0


def test_offline_rater(spark):
    a = spark.range(300).select(F.concat(F.lit("t"), "id").alias("trial_id"), F.lit(1).alias("attempt"), F.col("id").alias("seed"), F.lit("t").alias("instrument"))
    items = spark.createDataFrame(ITEMS, ITEM_SCHEMA)
    got = rater.rated(a, items)
    checked = scoring.validated(got.withColumn("instrument", F.lit("t")), items)
    assert checked.filter("problem is not null").count() == 0
    kinds = {r.category: r.n for r in rater.rated(a, items, {"refused": 0.5}, 0.3).groupBy("category").agg(F.count("*").alias("n")).collect()}
    assert set(kinds) == {"ok", "refused"} and 100 < kinds["refused"] < 200
    broken = scoring.validated(rater.rated(a, items, {}, 1.0).withColumn("instrument", F.lit("t")), items)
    assert {r.problem for r in broken.select("problem").distinct().collect()} == {"not_json"}
