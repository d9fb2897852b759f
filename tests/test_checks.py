"""Plan and check rules, schemas, card sentences, report texts and study guards."""

from __future__ import annotations

import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from raterlake.errors import EngineError
from raterlake.functions import texts
from raterlake.functions.jsons import canonical
from raterlake.operators import checks, export, planning, study
from raterlake.sources import tables

ITEM = "instrument string, item_id string, type string, points int, options array<string>, pos int"


@pytest.fixture
def plans(spark):
    make = spark.createDataFrame
    return {
        "tests": make([("good",), ("bare",), ("new",), ("one",), ("twice",), ("both",), ("few",), ("none",)], "test string"),
        "listed": make([("good", "rate", 0), ("good", "pick", 1), ("bare", "rate", 0), ("new", "rate", 0), ("new", "odd", 1), ("one", "pick", 0), ("twice", "rate", 0), ("both", "rate", 0), ("few", "rate", 0), ("few", "pick", 1)], "test string, instrument string, pos int"),
        "instruments": make([("rate", False), ("pick", True)], "instrument string, pairwise boolean"),
        "targets": make([(t, c) for t in ("good", "twice", "both", "few") for c in ("c1", "c2")] + [("one", "c1")], "test string, clip_id string"),
        "practice": make(
            [("good", 0, "rate", ["p1"]), ("good", 1, "pick", ["p1", "p2"]), ("twice", 1, "rate", ["p3", "p3"]), ("twice", 2, "rate", ["c1"]), ("both", 0, "rate", ["p1", "c2", "c1"]), ("both", 1, "rate", ["p1", "p1"]), ("few", 0, "rate", ["p1"])],
            "test string, pos long, instrument string, clips array<string>",
        ),
    }


def test_the_first_problem_of_a_plan(plans):
    got = {r.test: (r.code, r.detail) for r in checks.plan_problems(**plans, needed=1).collect()}
    assert got == {
        "good": (None, None), "none": ("bad_pairing", "no target clip"), "bare": ("bad_pairing", "no target clip"), "new": ("unknown_instrument", "odd"), "one": ("bad_pairing", "pick needs two target clips"),
        "twice": ("bad_practice", "practice[1] lists a clip twice"), "both": ("bad_practice", "practice[0] has the target c2"), "few": ("bad_practice", "pick has 0 of 1 examples"),
    }


def test_plans_without_anything(plans):
    empty = {k: v.limit(0) for k, v in plans.items()}
    assert checks.plan_problems(**empty, needed=1).count() == 0
    assert {r.code for r in checks.plan_problems(**{**empty, "tests": plans["tests"]}, needed=1).collect()} == {"bad_pairing"}


def test_problems_of_checks(spark):
    items = spark.createDataFrame([("rate", "like", "likert", 5, None, 0), ("rate", "few", "likert", 2, None, 1), ("rate", "why", "free_text", None, None, 2), ("rate", "ab", "pairwise", None, ["A", "B"], 3), ("pick", "better", "pairwise", None, ["A", "B"], 0), ("pick", "like", "likert", 5, None, 1)], ITEM)
    rows = [
        ("rate", "like", ["c1"], "5", "int", None), ("rate", "like", ["c1"], "5", "int", "duplicates"), ("rate", "like", ["c1"], "5", "string", "bad_expected"), ("rate", "like", ["c1"], "4", "int", "contradicts"),
        ("rate", "like", ["c2"], "6", "int", "bad_expected"), ("rate", "like", ["c2"], None, None, "bad_expected"), ("rate", "like", ["c1", "c2"], "c2", "string", None), ("rate", "like", ["c2", "c1"], "c2", "string", "duplicates"),
        ("rate", "like", ["c1", "c2"], "c3", "string", "expected_not_shown"), ("rate", "like", ["c1", "c2"], None, None, "expected_not_shown"), ("rate", "few", ["c1", "c2"], "c1", "string", "too_few_points"), ("rate", "why", ["c1", "c2"], "c1", "string", "needs_likert"),
        ("rate", "why", ["c1"], "x", "string", "free_text"), ("rate", "ab", ["c1"], "A", "string", None), ("rate", "ab", ["c2"], "C", "string", "bad_expected"), ("rate", "gone", ["c1"], "1", "int", "unknown_item"), ("odd", "like", ["c1"], "1", "int", "unknown_instrument"),
        (None, "like", ["c1"], "1", "int", "unknown_instrument"), ("pick", "like", ["c1", "c2"], "c1", "string", "item_not_pairwise"), ("pick", "better", ["c1"], "A", "string", "needs_two_clips"), ("pick", "better", ["c1", "c2"], "c1", "string", None), ("rate", "like", ["c7"], "5", "int", "unknown_clip"),
    ]
    given = spark.createDataFrame([("t", n, *r[:5]) for n, r in enumerate(rows)], "test string, pos long, instrument string, item_id string, clips array<string>, expected string, kind string")
    targets = spark.createDataFrame([("t", c) for c in ("c1", "c2", "c3")], "test string, clip_id string")
    got = {r.pos: (r.problem, r.first) for r in checks.check_problems(given, items, targets).collect()}
    assert [got[n][0] for n in range(len(rows))] == [r[5] for r in rows]
    assert {n: f for n, (_, f) in got.items() if f is not None} == {1: 0, 3: 0, 7: 6}
    assert checks.check_problems(given.limit(0), items, targets).count() == 0


def test_schemas_are_canonical(spark):
    items = spark.createDataFrame([("i", 'b"]', "likert", 7, None, 0), ("i", "é", "pairwise", None, ["A", 'q"'], 1), ("i", "a", "free_text", None, None, 2)], ITEM)
    [row] = checks.answer_schemas(items).collect()
    want = {"type": "object", "properties": {'b"]': {"type": "integer", "minimum": 1, "maximum": 7}, "é": {"type": "string", "enum": ["A", 'q"']}, "a": {"type": "string", "minLength": 1}}, "required": ['b"]', "é", "a"], "additionalProperties": False}
    assert json.loads(row.schema) == want and row.schema == canonical(want)


def test_what_is_stale(spark):
    rows = spark.createDataFrame([("m2", "x", True, False, 1), ("m1", "x", True, True, 2), ("m2", "y", True, True, 0), ("m3", "z", False, False, 3)], "model_id string, instrument string, settings_changed boolean, instrument_changed boolean, pos int")
    got = {tuple(r) for r in checks.stale_summary(rows, F.col("pos")).collect()}
    assert got == {("model", "m2", 2, 0), ("model", "m1", 1, 2), ("instrument", "x", 1, 2), ("instrument", "y", 1, 0)}


def test_sentences(spark):
    rows = {
        "You like quiet rooms.": None, "": "empty", " x": "not_one_line", "x ": "not_one_line", "a b": "not_one_line", "a\x1cb": "not_one_line", "a\nb": "not_one_line",
        "A HIGH place": "label:high", "highly slow": None, "An open-mindedness": "label:open-mindedness", "Extraverted": "label:extraverted", "Neurotic, low": "label:neurotic", "NARS": "label:nars", "highé": None, "ſ": None,
    }
    df = spark.createDataFrame([(k,) for k in rows] + [(None,)], "text string").select("text", texts.sentence_problem("text").alias("p"))
    assert {r.text: r.p for r in df.collect()} == {**rows, None: "empty"}


def test_numbers_and_times_as_text(spark):
    values = {0.0: "0.0", 12.0: "12.0", 0.00012: "0.0001", 1e-9: "0.0", -3.25: "-3.25", 1e12: "1000000000000.0", 2.123456: "2.1235"}
    df = spark.createDataFrame([(k,) for k in values] + [(None,)], "x double").select("x", texts.four_decimals("x").alias("t"))
    assert {r.x: r.t for r in df.collect()} == {**values, None: ""}
    rng = random.Random(4)
    hard = [2.00005, -0.00001, 1e20, 1e16, 9999999999999998.0, 1e11, 123456789012.34567, 4.5e11, 449999999999.99994, 8.41e21, 2e23, 1e300, 5e-324, -0.0, 0.00005, -4.9999999999999996e-05, 0.03125, 0.09375, 2.5, float("inf"), float("-inf"), float("nan"), 1.7976931348623157e308]
    hard += [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-6, 18) for _ in range(3000)] + [rng.randrange(1 << 20) / (1 << rng.randint(0, 12)) for _ in range(2000)] + [rng.randrange(10**6) / 10**4 + 0.00005 for _ in range(1000)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(hard)], "i int, x double").select("i", texts.four_decimals("x").alias("t")).collect()
    assert [(hard[r.i], r.t) for r in got if r.t != repr(round(hard[r.i], 4))] == []
    times = [datetime(2024, 7, 1, 23, 30, 5, tzinfo=timezone.utc), datetime(1971, 10, 31, 6, 57, 54, tzinfo=timezone.utc), datetime(2050, 1, 1, tzinfo=timezone.utc), datetime(1960, 2, 29, 12, tzinfo=timezone.utc)]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.createDataFrame([(int(t.timestamp()),) for t in times] + [(None,)], "s long").select(texts.utc_seconds(F.timestamp_seconds("s")).alias("t")).collect()
        cells = export.as_text(spark.range(1).select(F.timestamp_millis(F.lit(-1)).alias("a"), F.timestamp_millis(F.lit(1719876605007)).alias("b"), F.lit(None).cast("timestamp").alias("c"))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [r.t for r in rows] == ["2024-07-01T23:30:05Z", "1971-10-31T06:57:54Z", "2050-01-01T00:00:00Z", "1960-02-29T12:00:00Z", None]
    assert tuple(cells) == ("1969-12-31T23:59:59.999Z", "2024-07-01T23:30:05.007Z", "")


def test_kept_agents_keep_their_seeds(spark):
    people, models = spark.createDataFrame([("p1",), ("p2",)], "id string"), spark.createDataFrame([("m1", 0)], "model_id string, pos int")
    planned = planning.sessions("t", people, models, 2, 7)
    kept = planning.kept_agents(planned, spark.createDataFrame([("p2-m1",), ("p2-m1",), ("p9-m1",)], "agent_id string"))
    assert sorted(map(tuple, kept.select("session_id", "order_seed").collect())) == sorted(map(tuple, planned.filter("persona_id = 'p2'").select("session_id", "order_seed").collect()))


def test_abandoned_runs_and_panels_in_use(spark):
    t = tables.study(spark)
    study.check_panel_free(t)
    with pytest.raises(EngineError, match="screening_not_open"):
        study.abandon_run(t, "fidelity")
    rows = [("s1", "fidelity", None, "complete"), ("s2", "fidelity", None, "open"), ("s3", "perception", "t", "open")]
    t = tables.with_rows(t, "screening_runs", spark.createDataFrame(rows, "run_id string, kind string, screening_test string, status string"))
    t, first = study.abandon_run(t, "fidelity")
    t, second = study.abandon_run(t, "perception", "t")
    assert (first, second) == ("s2", "s3")
    assert {r.run_id: r.status for r in t["screening_runs"].collect()} == {"s1": "complete", "s2": "abandoned", "s3": "abandoned"}
    with pytest.raises(EngineError, match="screening_not_open"):
        study.abandon_run(t, "perception", "t")
    result = lambda run: spark.createDataFrame([(run, "i", "m1", "a")], "run_id string, instrument string, model_id string, agent_id string")
    t = tables.with_rows(t, "screening_results", result("s3"))
    t = tables.with_rows(t, "trials", spark.createDataFrame([("x", "p0")], "trial_id string, persona_id string"))
    study.check_panel_free(t)
    t = tables.with_rows(t, "screening_results", result("s1"))
    with pytest.raises(EngineError, match="panel_in_use"):
        study.check_panel_free(t)


RUN = "run_id string, kind string, screening_test string, status string"
RESULT = "pos long, instrument string, model_id string, agent_id string, outcome string"


def test_completed_runs_supersede(spark):
    t = tables.study(spark)
    t = tables.with_rows(t, "screening_runs", spark.createDataFrame([(f"s{i}", "fidelity", None, "open") for i in (1, 2, 3)], RUN))
    rows = lambda *agents: spark.createDataFrame([(n, "fidelity", "m1", a, "pass") for n, a in enumerate(agents)], RESULT)
    t, one = study.complete_run(t, "s1", rows("p1-m1", "p2-m1"))
    t, two = study.complete_run(t, "s2", rows("p1-m1"))
    t, three = study.complete_run(t, "s3", rows("p2-m1"))
    assert (one, two, three) == ([], [], ["s1"])
    assert {r.run_id: (r.status, r.superseded_by) for r in t["screening_runs"].collect()} == {"s1": ("complete", "s3"), "s2": ("complete", None), "s3": ("complete", None)}
    with pytest.raises(EngineError, match="screening_not_open"):
        study.complete_run(t, "s3", rows("p2-m1"))


def test_pushed_clips_and_registered_tests(spark):
    t = tables.study(spark)
    clips = lambda *names: spark.createDataFrame([(n, 1.0) for n in names], "clip_id string, duration_s double")
    texts_of = lambda *rows: spark.createDataFrame(list(rows), "clip_id string, text string")
    t = study.push_clips(t, clips("c1", "c2"), texts_of(("c1", "speed = fast"), ("c2", "speed=slow")))
    t = study.push_clips(t, clips("c3"), texts_of(("c3", "speed=slow")))
    assert sorted(map(tuple, t["blinding_key"].collect())) == [("c1", "speed", "fast", 1), ("c2", "speed", "slow", 1), ("c3", "speed", "slow", 2)]
    for code, names, rows in [("bad_condition", ["c4"], [("c4", "speed")]), ("unknown_clip", ["c4"], [("c9", "a=b")]), ("repeated_condition", ["c4"], [("c4", "a=b"), ("c4", "a=c")]), ("duplicate_key", ["c1"], [("c1", "a=b")])]:
        with pytest.raises(EngineError, match=code):
            study.push_clips(t, clips(*names), texts_of(*rows))
    assert t["clips"].count() == t["blinding_key"].count() == 3

    use = lambda *rows: spark.createDataFrame(list(rows), "clip_id string, role string")
    t = study.register_test(t, "one", "main", use(("c1", "target"), ("c3", "practice")))
    for code, name, kind, rows in [
        ("bad_test_name", "s1", "main", [("c2", "target")]), ("unknown_clip", "two", "main", [("c8", "target")]), ("clip_kind_overlap", "two", "pilot", [("c1", "target")]), ("duplicate_key", "one", "main", [("c2", "target")]),
    ]:
        with pytest.raises(EngineError, match=code):
            study.register_test(t, name, kind, use(*rows))
    t = study.register_test(t, "two", "pilot", use(("c3", "target"), ("c1", "practice")))
    assert t["tests"].count() == 2 and t["test_clips"].count() == 4
    with pytest.raises(EngineError, match="duplicate_key"):  # the second table refuses, so the first isn't changed either
        study.register_test(t, "three", "main", use(("c2", "target"), ("c2", "practice")))
    assert t["tests"].count() == 2 and t["test_clips"].count() == 4


def test_copied_panels(spark):
    source, target = tables.study(spark), tables.study(spark)
    source = tables.with_rows(source, "personas", spark.createDataFrame([("p1",), ("p2",)], "id string"))
    source = tables.with_rows(source, "screening_runs", spark.createDataFrame([(f"s{i}", "fidelity", None, "complete" if i > 1 else "abandoned") for i in (1, 2, 3)], RUN))
    rows = [(0, "s1", "fidelity", "m1", "p1-m1", "pass"), (0, "s2", "fidelity", "m1", "p1-m1", "fail"), (0, "s3", "fidelity", "m1", "p2-m1", "pass")]
    source = tables.with_rows(source, "screening_results", spark.createDataFrame(rows, "pos long, run_id string, instrument string, model_id string, agent_id string, outcome string"))
    make = spark.createDataFrame
    cards, frame = make([("p1.md", "1")], "name string, sha256 string"), lambda *levels: make([(x,) for x in levels], "level string")
    with pytest.raises(EngineError, match="frame_differs"):
        study.copy_panel(source, target, "../a", (frame("x", "y"), frame("x", "x")))
    target = study.copy_panel(source, target, "../a", (frame("x", "y"), frame("y", "x")), cards)
    assert {len(r.source_hash) for r in target["screening_results"].collect()} == {64}
    assert {(r.run_id, r.agent_id, r.outcome, r.source_study) for r in target["screening_results"].collect()} == {("s1", "p1-m1", "fail", "../a"), ("s2", "p2-m1", "pass", "../a")}
    assert target["personas"].count() == 2 and {r.run_id for r in target["screening_runs"].collect()} == {"s1", "s2"}
    with pytest.raises(EngineError, match="panel_in_use"):
        study.copy_panel(source, target, "../a")


def test_opened_and_resumed_tests(spark):
    t, make = tables.study(spark), spark.createDataFrame
    models = make([("m1", 0), ("m2", 1)], "model_id string, pos int")
    shapes = planning.canonical_shapes(make([("c1", 0), ("c2", 1)], "clip_id string, pos int"), make([("rate", False, False, 0)], "instrument string, pairwise boolean, self_report boolean, pos int"))
    variants = make([("rate", ["a"])], "instrument string, variants array<string>")
    run = lambda t, name, agents=None: study.open_test(t, name, models, shapes, variants, 2, 7, agents)
    with pytest.raises(EngineError, match="unknown_test"):
        run(t, "one")
    t = tables.with_rows(t, "tests", make([("one", "main"), ("two", "main")], "name string, kind string"))
    with pytest.raises(EngineError, match="nothing_to_plan"):
        run(t, "one")
    t = tables.with_rows(t, "personas", make([("p1",), ("p2",)], "id string"))
    t, summary = run(t, "one")
    assert [(r.trials, r.sessions, r.agents) for r in summary.collect()] == [(16, 8, 4)]
    t, summary = run(t, "two", make([("p2-m1",)], "agent_id string"))
    assert [(r.trials, r.agents) for r in summary.collect()] == [(4, 1)]
    with pytest.raises(EngineError, match="already_planned"):
        run(t, "one")

    first = "two/p2-m1/r1/t1"
    t = tables.with_rows(t, "attempts", make([(first, 1, 5, datetime(2024, 1, 1), "transient")], "trial_id string, attempt int, seed long, sent_at timestamp, category string"))
    line = lambda seed, body="s": make([(first, 1, "s", seed, "m1", body)], "trial_id string, attempt int, request_sha256 string, seed long, model_id string, body_sha256 string")
    for reason, archive in [("sent_without_request", line(5).limit(0)), ("seed_differs", line(6)), ("hash_differs", line(5, "x"))]:
        with pytest.raises(EngineError, match=reason):
            study.resume_test(t, "two", archive)
    assert [(r["class"], r.n) for r in study.resume_test(t, "two", line(5)).collect()] == [("new_attempt", 4)]


def test_perception_runs_are_scored(spark):
    t, make = tables.study(spark), spark.createDataFrame
    t = tables.with_rows(t, "screening_runs", make([("s1", "perception", "t", "open")], RUN))
    checks_ = make([(0, "rate", "v", False, ["c1", "c2"], "c1"), (1, "rate", "v", False, ["c3"], "4")], "pos int, instrument string, item_id string, pairwise boolean, clips array<string>, expected string")
    rows = [("m1", 1, "rate", [c], "v", a, "int", "valid") for c, a in (("c1", "5"), ("c2", "2"), ("c3", "4"))] + [("m2", 1, "rate", ["c3"], "v", "4", "int", "valid")]
    trials = make(rows, "model_id string, repeat int, instrument string, clip_ids array<string>, item_id string, answer string, kind string, state string")
    stamps = lambda *models: make([(m, "rate", "h", "i") for m in models], "model_id string, instrument string, settings_hash string, instrument_hash string")
    with pytest.raises(EngineError, match="trials_running"):
        study.score_perception_run(t, "s1", trials.withColumn("state", F.lit("sent")), checks_, stamps("m1", "m2"))
    with pytest.raises(EngineError, match="no_stamp"):
        study.score_perception_run(t, "s1", trials, checks_, stamps("m1"))
    t, superseded = study.score_perception_run(t, "s1", trials, checks_, stamps("m1", "m2", "m3"))
    assert superseded == []
    got = {r.model_id: (r.outcome, r.score, r.pair_checks, r.detail, r.pos) for r in t["screening_results"].collect()}
    assert got == {"m1": ("pass", 1.0, 1, '{"passed":2,"units":2}', 1), "m2": ("fail", 0.5, 1, '{"passed":1,"units":2}', 2), "m3": ("fail", 0.0, 1, '{"passed":0,"units":2}', 3)}


def test_sessions_of_one_file_are_spread_before_they_become_trials(spark):
    shapes = spark.createDataFrame([("rate", ["c1"], None, None, 0), ("rate", ["c2"], None, None, 1)], "instrument string, clip_ids array<string>, pair_id string, position int, place int")
    people = spark.createDataFrame([(f"p{i}",) for i in range(30)], "id string")
    planned = planning.sessions("t", people, spark.createDataFrame([("m1", 0)], "model_id string, pos int"), 2, 5).coalesce(1)
    variants = spark.createDataFrame([("rate", ["a", "b"])], "instrument string, variants array<string>")
    for shuffle in (False, True):
        out = planning.plan_trials(planned, shapes, variants, shuffle)
        assert out.select(F.spark_partition_id().alias("task")).distinct().count() == 4
        rows = out.collect()
        assert len({r.trial_id for r in rows}) == len(rows) == 120 and all(r.prompt_variant == "ab"[r.repeat - 1] for r in rows)


def test_trials_without_a_second_clip_do_not_meet_in_one_task(spark):
    trials = spark.createDataFrame([(f"o{i}", None, ["c1"] if i % 9 else []) for i in range(200)] + [("x", "p", ["c1", "c2"]), ("c1", None, ["c7"])], "trial_id string, pair_id string, clip_ids array<string>")
    key = spark.createDataFrame([("c1", "f", "a", 0), ("c2", "f", "b", 1), ("o5", "f", "z", 2)], "clip_id string, factor string, level string, pos bigint")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = export.condition_cells(trials, key, ["f"]).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    got = {r.trial_id: (r.f, r.f_a, r.f_b) for r in rows}
    assert len(rows) == 202 and got["x"] == (None, "a", "b") and got["c1"] == (None, None, None)
    assert all(got[f"o{i}"] == (("a" if i % 9 else None), None, None) for i in range(200))
    assert len({r.task for r in rows if r.f_a is None}) == 4
