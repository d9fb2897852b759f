"""Ceilings, pushes, persona screenings, digests, reports, instruments and copies on small tables."""

from __future__ import annotations

import hashlib
import json
import random
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from raterlake.errors import EngineError
from raterlake.functions import texts
from raterlake.functions.jsons import canonical
from raterlake.operators import copies, ledger, planning, push, registry, requests, scoring, study
from raterlake.operators import trials as trial_ops
from raterlake.plans import driverdata
from raterlake.sources import tables

from .conftest import SF


def frame(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


REQUEST = "study string, seq int, given string, expected_usd decimal(38,12), committed_usd decimal(38,12), fresh boolean, uncapped_ok boolean"


def folded(rows):
    """The rule one request after the other."""
    held, out = {}, {}
    for s, seq, given, expected, committed, fresh, uncapped in sorted(rows, key=lambda r: (r[0], r[1])):
        amount = None
        if given is not None:
            try:
                amount = Decimal(given.strip())
            except ArithmeticError:
                pass
            if amount is None or not amount.is_finite() or amount <= 0:
                out[s, seq] = ("invalid_ceiling", None, None)
                continue
        ceiling = amount if given is not None else held.get(s)
        if amount is not None and committed > amount:
            refusal = "over_ceiling"
        elif ceiling is None and not uncapped:
            refusal = "ceiling_required"
        elif fresh and ceiling is not None and committed + expected > ceiling:
            refusal = "over_ceiling"
        else:
            refusal = None
        accepted = refusal is None and amount is not None
        out[s, seq] = (refusal, ceiling, held.get(s) if accepted else None)
        if accepted:
            held[s] = amount
    return out


@pytest.mark.parametrize("seed", range(3))
def test_ceilings_equal_the_fold(spark, seed):
    rng = random.Random(seed)
    given = [None, None, "5", "50.5", " 100 ", "1e2", "1_000", "+20", "0", "-1", "abc", "", "1e", "Infinity", "NaN", ".5", "7.", "1.2.3"]
    rows = [(rng.choice("ab"), i, rng.choice(given), Decimal(rng.randint(0, 60)), Decimal(rng.randint(0, 60)), rng.random() < 0.5, rng.random() < 0.3) for i in range(200)]
    out = ledger.ceiling_decisions(frame(spark, rows, REQUEST)).collect()
    assert {(r.study, r.seq): (r.refusal, r.ceiling_usd, r.previous_usd) for r in out} == folded(rows)


def test_pushes_by_content(spark):
    known = frame(spark, [("same", "1"), ("edited", "1"), ("gone", "1"), ("other", "1")], "name string, sha256 string")
    stored = frame(spark, [("same", "1"), ("edited", "2"), ("other", "1"), ("loose", "9"), ("fits", "5")], "name string, sha256 string")
    rows = [(1, "same", "1"), (2, "edited", "1"), (3, "gone", "1"), (4, "other", "2"), (5, "loose", "1"), (6, "fits", "5"), (7, "new", "1"), (8, "new", "1"), (9, "new", "2"), (10, "same", "1")]
    out = push.by_content(frame(spark, rows, "pos int, name string, sha256 string"), known, stored).collect()
    assert {r.pos: (r.outcome, r.code) for r in out} == {
        1: ("same", None), 2: ("refused", "test_exists"), 3: ("refused", "test_exists"), 4: ("refused", "test_exists"), 5: ("refused", "test_exists"),
        6: ("new", None), 7: ("new", None), 8: ("same", None), 9: ("refused", "test_exists"), 10: ("same", None),
    }


def test_pushed_tests_are_refused_in_order(spark):
    pushed = [
        (1, "good", "pilot", "a", ["c1"], ["c2"]), (2, "Bad", "pilot", "a", ["c9"], []), (3, "lost", "pilot", "a", ["c1", "c9"], ["c8"]), (4, "drill", "pilot", "a", ["c1"], ["c8"]),
        (5, "clash", "main", "a", ["c3"], []), (6, "held", "pilot", "h", ["c9"], []), (7, "held", "pilot", "x", ["c9"], []), (8, "lost", "pilot", "b", ["c1"], []), (9, "fine", "screening", "a", ["c3"], []),
    ]
    registered = frame(spark, [("held", "pilot", "h")], "name string, kind string, sha256 string")
    stored, clips = frame(spark, [("held", "h")], "name string, sha256 string"), frame(spark, [("c1",), ("c2",), ("c3",)], "clip_id string")
    used = frame(spark, [("held", "c3", "target"), ("held", "c1", "practice")], "test string, clip_id string, role string")
    df = frame(spark, pushed, "pos int, name string, kind string, sha256 string, targets array<string>, practice array<string>")
    out = push.pushed_tests(df, registered, stored, clips, used)
    assert {r.pos: (r.outcome, r.code) for r in out.collect()} == {
        1: ("new", None), 2: ("refused", "bad_test_name"), 3: ("refused", "unknown_clip"), 4: ("refused", "bad_practice"), 5: ("refused", "clip_kind_overlap"),
        6: ("same", None), 7: ("refused", "test_exists"), 8: ("new", None), 9: ("new", None),
    }
    assert sorted(r.name for r in push.registered_after(out, registered).collect()) == ["fine", "good", "held", "lost"]
    again = push.pushed_tests(df.filter("pos in (1, 8, 9)"), push.registered_after(out, registered), stored.union(out.filter("outcome = 'new'").select("name", "sha256")), clips, used)
    assert {r.outcome for r in again.collect()} == {"same"}  # a push that is repeated changes nothing


def test_conditions_after_a_push(spark):
    kind = "clip_id string, factor string, level string, pos long"
    out = push.conditions_after(frame(spark, [("c1", "f", "new", 1), ("c1", "f", "newest", 2)], kind), frame(spark, [("c1", "f", "old", 9), ("c2", "f", "stays", 8)], kind))
    assert {r.clip_id: r.level for r in out.collect()} == {"c1": "newest", "c2": "stays"}
    assert [tuple(r) for r in push.repeated_clips(frame(spark, [("a",), ("a",), ("b",)], "sha256 string")).collect()] == [("a", 2)]


KEYS = [("self", "i0", "openness", False, None, 5), ("self", "i1", "openness", True, None, 5), ("self", "i2", "neuroticism", False, None, 5), ("bands", "r0", "nars", False, "s1", 7), ("bands", "r1", "nars", True, "s2", 7)]


def screened(spark, trials, answers, settings=(("s1", "m1", "h"),)):
    return scoring.persona_results(
        frame(spark, trials, "run_id string, trial_id string, agent_id string, persona_id string, model_id string, instrument string, state string"), frame(spark, answers, "trial_id string, item_id string, value int"),
        frame(spark, KEYS, "instrument string, item_id string, construct string, reversed boolean, subscale string, points int"),
        frame(spark, [("p1", "openness", "high"), ("p1", "neuroticism", "low"), ("p1", "nars", "low"), ("p2", "openness", "low"), ("p2", "neuroticism", "high")], "persona_id string, construct string, pole string"),
        frame(spark, list(settings), "run_id string, model_id string, settings_hash string"), frame(spark, [("s1", "stamp")], "run_id string, instrument_hash string"), 0.6, draft=True,
    )


def trial(n, persona, instrument, state="valid", run="s1"):
    return (run, f"t{n}", f"{persona}-m1", persona, "m1", instrument, state)


def test_persona_screening_scores_by_its_own_plan(spark):
    trials = [trial(1, "p1", "self"), trial(2, "p1", "self", "invalid"), trial(3, "p1", "bands"), trial(4, "p2", "self"), trial(5, "p2", "self", "failed"), trial(6, "p2", "self", "refused")]
    answers = [("t1", "i0", 5), ("t1", "i1", 1), ("t1", "i2", 3), ("t3", "r0", 2), ("t3", "r1", 5), ("t4", "i0", 1), ("t4", "i1", None), ("t4", "i2", 9), ("t2", "i0", 1)]
    out = {r.agent_id: r for r in screened(spark, trials, answers).collect()}
    one, two = out["p1-m1"], out["p2-m1"]
    assert (one.matched, one.total, one.insufficient, one.outcome, one.problem, one.settings_hash, one.instrument_hash) == (2, 3, 0, "pass", None, "h", "stamp")
    detail = json.loads(one.detail)
    assert canonical(detail) == one.detail and detail["draft"] is True and detail["insufficient_data"] is False
    assert detail["checks"]["openness"] == {"expected": 4, "insufficient_data": False, "match": True, "midpoint": 3.0, "n": 2, "pole": "high", "score": 5.0}
    assert detail["checks"]["neuroticism"]["match"] is False and detail["checks"]["nars"]["subscales"] == {"s1": 2.0, "s2": 3.0} and detail["checks"]["nars"]["match"] is True
    # p2 was to answer openness six times and did once: too few to match
    assert (two.matched, two.total, two.insufficient, two.outcome) == (0, 2, 2, "fail") and json.loads(two.detail)["checks"]["openness"]["expected"] == 6


def test_persona_screening_waits_for_all_trials(spark):
    trials = [trial(1, "p1", "self"), trial(2, "p2", "self", "sent"), trial(3, "p1", "self", run="s2"), trial(4, "p1", "self", "planned", run="s3")]
    out = screened(spark, trials, [], [("s2", "m1", "h")]).collect()
    assert [(r.run_id, r.outcome) for r in out] == [("s2", "fail")]
    assert screened(spark, [], []).count() == 0


def test_persona_screening_without_stamps_or_panel(spark):
    out = screened(spark, [trial(1, "p1", "self"), trial(2, "p9", "self")], [], []).collect()
    assert {r.agent_id: (r.problem, r.outcome, r.detail) for r in out} == {"p1-m1": ("no_settings_stamp", None, None), "p9-m1": ("no_settings_stamp", None, None)}
    assert {r.agent_id: r.problem for r in screened(spark, [trial(2, "p9", "self")], []).collect()} == {"p9-m1": "panel_mismatch"}


def test_digests_follow_the_plan(spark):
    rows = [(f"t{i}", test, f"p{p}", "m1", r, i, f"{test}:{i}é" * (i % 7)) for i, (test, p, r) in enumerate((t, p, r) for t in ("a", "b") for p in (10, 2, 1) for r in (2, 1))]
    random.Random(1).shuffle(rows)
    trials = frame(spark, [r[:6] for r in rows], "trial_id string, test string, persona_id string, model_id string, repeat int, trial_index int").repartition(5)
    texts = frame(spark, [(r[0], r[6]) for r in rows] + [("t999", "unused")], "trial_id string, request string")
    out = {r.test: (r.requests, r.requests_sha256) for r in requests.plan_digests(trials, texts, trial_ops.plan_order()).collect()}
    for test in "ab":
        mine = sorted((int(r[2][1:]), r[4], r[5], r[6]) for r in rows if r[1] == test)
        assert out[test] == (len(mine), hashlib.sha256("".join(x[-1] for x in mine).encode()).hexdigest())
    assert requests.plan_digests(trials.limit(0), texts, trial_ops.plan_order()).count() == 0


def test_nested_status_documents(spark):
    trials = frame(spark, [("x1", "a", "m2", "p10-m2", "p10", "valid", 2, "ok"), ("x2", "a", "m10", "p2-m10", "p2", "failed", 1, "transient"), ("x3", "a", "m2", "p9-m2", "p9", "invalid", 1, "ok")], "trial_id string, test string, model_id string, agent_id string, persona_id string, state string, attempt int, last_category string")
    spent = frame(spark, [("x1", Decimal("0.5"), None), ("x2", Decimal("0.5"), Decimal("0.250"))], "trial_id string, reserved_usd decimal(38,12), actual_usd decimal(38,12)")
    tests = frame(spark, [("a", None), ("b", "ceiling"), ("c", "errors")], "name string, paused_reason string")
    changes = frame(spark, [(1, Decimal("5")), (2, Decimal("7.50"))], "seq long, ceiling_usd decimal(38,12)")
    people = frame(spark, [("p10", "x", None), ("p2", "y", "q"), ("p9", "x", "q")], "id string, nars string, gender string")
    out = {r.test: json.loads(r.document) for r in study.status_reports(trials, spent, tests, changes, people, ("nars", "gender")).collect()}
    assert set(out) == {"a", "b", "c", None}
    whole = out[None]
    assert [(r["test"], r["model"], r["agent"]) for r in whole["rows"]] == [("a", "*", "*"), ("a", "m2", "*"), ("a", "m2", "p9-m2"), ("a", "m2", "p10-m2"), ("a", "m10", "*"), ("a", "m10", "p2-m10"), ("b", "*", "*"), ("c", "*", "*")]
    assert whole["rows"][0] == {"test": "a", "model": "*", "agent": "*", "planned": 0, "sent": 0, "valid": 1, "invalid": 1, "refused": 0, "failed": 1, "trials": 3, "retried": 1, "invalid_rate": 0.5, "cost_usd": "0.75", "paused": None}
    assert (whole["committed"], whole["ceiling"], whole["state"], whole["paused"]) == ("0.75", "7.5", "paused", [{"test": "b", "reason": "ceiling"}, {"test": "c", "reason": "errors"}])
    tally = whole["by_persona_attribute"]
    assert list(tally) == ["a", "b", "c"] and list(tally["a"]["persona_nars"]) == ["y", "x"] and list(tally["a"]["persona_gender"]) == ["q", ""] and tally["b"] == {"persona_nars": {}, "persona_gender": {}}
    assert tally["a"]["persona_nars"]["y"] == {"trials": 1, "invalid": 0, "refused": 0, "failed": 1, "failed_fatal": 0, "failed_transient": 1, "failed_exhausted": 0}
    assert out["b"]["test"] == "b" and [r["test"] for r in out["b"]["rows"]] == ["b"] and list(out["b"]["by_persona_attribute"]) == ["b"] and out["b"]["paused"] == whole["paused"]
    lost = study.status_reports(trials, spent, tests, changes.limit(0), people.filter("id <> 'p9'"), ("nars",)).filter("test is null").first()
    assert json.loads(lost.document)["by_persona_attribute"] is None and json.loads(lost.document)["ceiling"] is None


def test_status_documents_in_parts(spark):
    """The parts of a document, digested one after the other, are its text; a row of the rollup is a part."""
    trials = frame(spark, [(f"x{i}", "ab"[i % 2], f"m{i % 3}", f"p{i}-m{i % 3}", f"p{i}", "valid", 1, "ok") for i in range(60)], "trial_id string, test string, model_id string, agent_id string, persona_id string, state string, attempt int, last_category string")
    spent, tests = frame(spark, [("x1", Decimal("0.5"), None)], "trial_id string, reserved_usd decimal(38,12), actual_usd decimal(38,12)"), frame(spark, [("a", None), ("b", "ceiling")], "name string, paused_reason string")
    given = (trials, spent, tests, frame(spark, [(1, Decimal("5"))], "seq long, ceiling_usd decimal(38,12)"), frame(spark, [(f"p{i}", "é") for i in range(60)], "id string, nars string"), ("nars",))
    parts = study.status_report_parts(*given)
    got = {r.test: (r.characters, r.sha256) for r in requests.text_digests(parts, [F.col("at"), F.col("key")]).collect()}
    assert got == {r.test: (len(r.document), hashlib.sha256(r.document.encode()).hexdigest()) for r in study.status_reports(*given).collect()}
    assert {r.test: r.n for r in parts.filter("at = 1").groupBy("test").agg(F.count("*").alias("n")).collect()} == {"a": 34, "b": 34, None: 68}
    assert study.status_report_parts(trials.limit(0), spent, tests.limit(0), *given[3:]).count() == 0


def test_instruments_are_resolved_by_precedence(spark):
    wanted = frame(spark, [("s1", 0, "own"), ("s1", 1, "shared"), ("s1", 2, "none"), ("s2", 0, "shared"), ("s3", 0, "odd"), ("s3", 1, "weird")], "study string, pos int, name string")
    user = frame(spark, [("s1", "own", "own"), ("s2", "shared", "shared"), ("s3", "odd", "even"), ("s9", "none", "none")], "study string, name string, document_name string")
    builtin = frame(spark, [("shared", "shared"), ("weird", "wyrd")], "name string, document_name string")
    out = {(r.study, r.name): (r.source, r.problem) for r in registry.resolved_instruments(wanted, user, builtin).collect()}
    assert out == {
        ("s1", "own"): ("user", None), ("s1", "shared"): ("builtin", None), ("s1", "none"): (None, "unknown_instrument"), ("s2", "shared"): ("user", "shadows_builtin"),
        ("s3", "odd"): ("user", "name_differs"), ("s3", "weird"): ("builtin", "name_differs"),
    }


def test_questionnaires_are_checked_in_item_order(spark):
    instruments = frame(spark, [(n, n != "plain") for n in ("good", "plain", "keyless", "foreign", "flat", "taken", "empty")], "instrument string, self_report boolean")
    items = [("good", 0, "g", "nars", "s1"), ("plain", 0, "p", "nars", "s1"), ("keyless", 0, "k0", "nars", "s1"), ("keyless", 1, "k1", None, None), ("keyless", 2, "k2", "openness", None), ("foreign", 0, "f", "openness", None), ("flat", 0, "l", "nars", "s9"), ("taken", 0, "b1", "nars", "s2"), ("taken", 1, "a1", "nars", "s2")]
    out = registry.self_report_problems(instruments, frame(spark, items, "instrument string, pos int, item_id string, construct string, subscale string"), frame(spark, [("b1",), ("a1",), ("b1",)], "item_id string"))
    assert {r.instrument: r.problem for r in out.collect()} == {"good": None, "plain": "no_self_report", "keyless": "no_key:k1", "foreign": "other_construct:f", "flat": "no_subscale", "taken": "item_ids_taken:a1,b1", "empty": "no_subscale"}


def test_stamps_and_exclusions(spark):
    stamps = frame(spark, [("t", 1, "m1", "i", "a", "b"), ("t", 2, "m1", "i", "c", "b"), ("t", 1, "m2", "i", "d", "e")], "test string, pos int, model_id string, instrument string, settings_hash string, instrument_hash string")
    assert registry.stamp_map(stamps).first().stamps == {"m1/i": "c/b", "m2/i": "d/e"}
    out = registry.exclusions_in_order(frame(spark, [("t", 2, "p1-m1", "x"), ("t", 1, "p9-m1", "y")], "test string, pos int, agent_id string, reason string")).first()
    assert [tuple(e) for e in out.excluded] == [("p9-m1", "y"), ("p1-m1", "x")]
    variants = frame(spark, [("i", "default", "D"), ("i", "x", "X")], "instrument string, variant string, text string")
    wanted = frame(spark, [(1, "i", None), (2, "i", "x"), (3, "i", "gone"), (4, "j", None)], "n int, instrument string, prompt_variant string")
    assert {r.n: r.wording for r in registry.resolved_variants(wanted, variants).collect()} == {1: "D", 2: "X", 3: None, 4: None}


def test_frames_are_equal_as_multisets(spark):
    rows = [(1, "a", None), (1, "a", None), (None, None, 2.5), (3, "é", 0.0)]
    one, other = (frame(spark, r, "a int, b string, c double") for r in (rows, rows[::-1]))
    assert copies.differences(one, other.repartition(3)).count() == 0
    out = copies.differences(one, frame(spark, [rows[0], rows[2], (4, "x", None)], "a int, b string, c double")).collect()
    assert sorted((r.a, r.more) for r in out) == [(1, 1), (3, 1), (4, -1)]
    digests = {copies.table_digest(df).first().digest for df in (one, other.repartition(4))}
    assert len(digests) == 1 and copies.table_digest(one.limit(3)).first().digest not in digests
    assert {r.b: r.digest for r in copies.table_digest(one.filter("b is not null"), ["b"]).collect()}.keys() == {"a", "é"}


def test_source_hash_is_that_of_the_canonical_text(spark):
    names = {'a "q".md': "1", "é.md": "2", "index.json": "3"}
    rows = [(2, "s1", "p1-m1", 0.75, None), (1, "s2", None, 1.0, "d"), (10, "s1", "p2", 0.1, "é")]
    files, results = frame(spark, list(names.items()), "name string, sha256 string"), frame(spark, rows, "pos int, run_id string, agent_id string, score double, detail string")
    body = {"panel": names, "results": [dict(zip(("run_id", "agent_id", "score", "detail"), r[1:])) for r in sorted(rows)]}
    expected = hashlib.sha256(canonical(body).encode()).hexdigest()
    assert copies.source_hash(files, results, "pos").first().source_hash == expected
    same = copies.copied_panel(files, files.repartition(2), files, results, "pos").first()
    assert (same.same_frame, same.source_hash) == (True, expected)
    other = copies.copied_panel(files, files.limit(1), files, results, "pos").first()
    assert (other.same_frame, other.source_hash) == (False, None)
    empty = copies.source_hash(files, results.limit(0), "pos").first().source_hash
    assert empty == hashlib.sha256(canonical({"panel": names, "results": []}).encode()).hexdigest()


def test_dry_run_says_what_opening_would_do(spark):
    trials = frame(spark, [("x1", "a", "s", "p1-m1", "p1", "m1", 1, 1, "i"), ("x2", "a", "s", "p1-m1", "p1", "m1", 1, 2, "i")], "trial_id string, test string, session_id string, agent_id string, persona_id string, model_id string, repeat int, trial_index int, instrument string")
    texts = frame(spark, [("x1", "one", None), ("x2", None, "unknown_clip")], "trial_id string, request string, problem string")
    estimates = frame(spark, [("a", Decimal(3), Decimal(18), "alpha")], "test string, expected decimal(38,12), worst_case decimal(38,12), providers string")
    asked = estimates.select("test", F.lit("s").alias("study"), F.lit(1).alias("seq"), F.lit("2").alias("given"), F.col("expected").alias("expected_usd"), F.lit(0).alias("committed_usd"), F.lit(True).alias("fresh"), F.lit(False).alias("uncapped_ok"))
    out = study.dry_run(trials, texts, estimates, ledger.ceiling_decisions(asked), frame(spark, [("a", "p2-m1", "fidelity_fail")], "test string, agent_id string, reason string"), frame(spark, [("a", "ceiling")], "name string, paused_reason string")).first()
    assert (out.trials, out.requests, out.unrendered, out.requests_sha256, out.would_refuse, out.excluded, out.paused) == (2, 1, 1, hashlib.sha256(b"one").hexdigest(), "over_ceiling", 1, "ceiling")


def test_places_in_plan_order(spark):
    rng = random.Random(3)
    rows = [(f"{test}{i}", test, f"p{rng.randint(1, 12)}", f"m{rng.choice([1, 2, 10])}", rng.randint(1, 2), i % 4) for test in ("a", "b", "c") for i in range(50)]
    df = frame(spark, rows, "trial_id string, test string, persona_id string, model_id string, repeat int, trial_index int").repartition(6)
    got = {(r.test, r.place): r.trial_id for r in trial_ops.plan_places(df).collect()}
    for test in "abc":
        mine = sorted((r for r in rows if r[1] == test), key=lambda r: (int(r[2][1:]), int(r[3][1:]), r[4], r[5], r[0]))
        assert [got[test, i] for i in range(1, 51)] == [r[0] for r in mine]


def test_scoring_keys_of_documents(spark):
    doc = {"items": [{"id": "a", "points": 5}, {"id": "b"}, {"id": "c", "points": 7}, {"id": "d", "points": 5}], "keys": {"a": {"construct": "openness", "reversed": True}, "b": {"construct": "x", "reversed": False}, "c": {"construct": "nars", "reversed": False, "subscale": "s2"}, "z": {}}}
    df = frame(spark, [("i", json.dumps(doc)), ("none", json.dumps({"items": [{"id": "a", "points": 5}]})), ("broken", "{")], "instrument string, json string")
    assert sorted(map(tuple, registry.scoring_keys(df).collect())) == [("i", 0, "a", "openness", True, None, 5), ("i", 2, "c", "nars", False, "s2", 7)]


def test_scoring_keys_leave_large_documents(spark):
    """20,000 keys are met once each, not once per item; documents of one name stay apart, and a text given twice counts twice."""
    n = 20_000
    item = lambda i: {"id": f"i{i}", "points": 5}
    large = json.dumps({"items": [item(i) for i in range(n)], "keys": {f"i{i}": {"construct": "openness", "reversed": i % 2 == 0} for i in range(n)}})
    one, two = json.dumps({"items": [item(1), item(1)], "keys": {"i1": {"construct": "a"}}}), json.dumps({"items": [item(1), item(2)], "keys": {"i2": {"construct": "b"}}})
    got = registry.scoring_keys(frame(spark, [("large", large), ("same", one), ("same", two), ("same", two)], "instrument string, json string"))
    start = time.monotonic()
    rows = got.groupBy("instrument", "construct").count().collect()
    assert time.monotonic() - start < 30
    assert sorted(map(tuple, rows)) == [("large", "openness", n), ("same", "a", 2), ("same", "b", 2)]


def test_scoring_keys_of_documents_in_any_order(spark):
    """A document whose keys come in another order at each reading, as lists do that are collected over a shuffle."""
    doc = {"items": [{"id": f"i{i}", "points": 5} for i in range(40)], "keys": {f"i{i}": {"construct": "openness", "reversed": i % 2 == 0} for i in range(40)}}

    @F.udf("string")
    def reordered(text):
        found = json.loads(text)
        return json.dumps(found | {"keys": dict(random.SystemRandom().sample(list(found["keys"].items()), len(found["keys"])))})

    df = frame(spark, [("i", json.dumps(doc))], "instrument string, json string").select("instrument", reordered.asNondeterministic()("json").alias("json"))
    rows = registry.scoring_keys(df).collect()
    assert sorted(map(tuple, rows)) == sorted(("i", i, f"i{i}", "openness", i % 2 == 0, None, 5) for i in range(40))


def test_instrument_documents_in_one_order(spark, tmp_path):
    """A brand's document says its parts in the order of their keys, however they arrive."""
    parts = spark.read.parquet(f"{SF}/part.parquet")
    texts = []
    for name, order in (("up", F.col("p_partkey")), ("down", F.desc("p_partkey"))):
        parts.orderBy(order).coalesce(1).write.parquet(str(tmp_path / name / "part.parquet"))
        texts.append(sorted(map(tuple, driverdata.instrument_documents(spark, str(tmp_path / name)).collect())))
    assert texts[0] == texts[1]


def test_pauses(spark):
    t = tables.study(spark, tests=frame(spark, [("a", "main"), ("b", "main")], "name string, kind string"))
    paused = study.set_pause(t, "a", "ceiling")
    assert {r.name: r.paused_reason for r in paused["tests"].collect()} == {"a": "ceiling", "b": None}
    assert {r.name: r.paused_reason for r in study.set_pause(paused, "a", None)["tests"].collect()} == {"a": None, "b": None}
    with pytest.raises(EngineError, match="unknown_test"):
        study.set_pause(t, "z", "ceiling")


def test_persona_results_complete_their_runs(spark):
    t = tables.study(spark, screening_runs=frame(spark, [("s1", "fidelity", None, "complete"), ("s2", "fidelity", None, "open"), ("s10", "fidelity", None, "open")], "run_id string, kind string, screening_test string, status string"))
    t = tables.with_rows(t, "screening_results", frame(spark, [(1, "s1", "fidelity", "m1", "p1-m1", "pass")], "pos long, run_id string, instrument string, model_id string, agent_id string, outcome string"))
    rows = [(r, "m1", a, "fidelity", "pass", 1.0, 0.8, "h", "i", "{}", None) for r, a in (("s10", "p1-m1"), ("s2", "p10-m1"), ("s2", "p2-m1"))]
    results = frame(spark, rows, "run_id string, model_id string, agent_id string, instrument string, outcome string, score double, threshold double, settings_hash string, instrument_hash string, detail string, problem string")
    after, superseded = study.complete_persona_runs(t, results)
    assert superseded == {"s2": [], "s10": ["s1"]}
    assert {r.run_id: r.status for r in after["screening_runs"].collect()} == {"s1": "complete", "s2": "complete", "s10": "complete"}
    assert [r.agent_id for r in after["screening_results"].filter("run_id = 's2'").orderBy("pos").collect()] == ["p2-m1", "p10-m1"]
    with pytest.raises(EngineError, match="panel_mismatch"):
        study.complete_persona_runs(t, results.withColumn("problem", F.lit("panel_mismatch")))


def test_contrasts_of_a_full_fraction_cancel(spark):
    for fraction, n in (("1/2", 16), ("1/4", 8)):
        rows = planning.profiles(spark, "1")
        inside = planning.in_fraction(rows, fraction)
        assert sorted(r.profile for r in inside.collect()) == sorted(r.profile for r in planning.profiles(spark, fraction).collect()) and inside.count() == n
        assert {r.contrast for r in planning.alias_contrasts(rows, fraction).collect()} == {0}
    lone = frame(spark, [("high", "low", "low", "high", "high")], "openness string, conscientiousness string, extraversion string, agreeableness string, neuroticism string")
    assert planning.in_fraction(lone, "1/2").count() == 1
    out = {r.alias: r.contrast for r in planning.alias_contrasts(lone, "1/2").collect()}
    assert out["O=CEAN"] == 1 and out["C=OEAN"] == -1 and set(out.values()) == {1, -1}


def test_utc_texts_of_late_years(spark):
    df = spark.range(1).select(F.explode(F.array(F.lit(253402300799123), F.lit(253402300800000), F.lit(599946042000004))).alias("ms"))
    got = df.select(texts.utc_seconds(F.timestamp_millis("ms")), texts.utc_millis(F.timestamp_millis("ms"))).collect()
    assert sorted(map(tuple, got)) == [
        ("10000-01-01T00:00:00Z", "10000-01-01T00:00:00.000Z"), ("20981-07-13T22:20:00Z", "20981-07-13T22:20:00.004Z"), ("9999-12-31T23:59:59Z", "9999-12-31T23:59:59.123Z"),
    ]
