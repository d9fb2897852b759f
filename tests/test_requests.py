"""Requests, prompts, usage, event folds and the registry on small fixtures."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from raterlake.functions.jsons import canonical
from raterlake.operators import events, references, registry, requests

ITEM = "struct<anchors:struct<high:string,low:string>,id:string,options:array<string>,points:int,text:string,type:string>"


@pytest.fixture
def rendered(spark):
    pair = lambda *options: [(None, f"i{n}", list(o), None, "Which?", "pairwise") for n, o in enumerate(options)]
    likert = [(("very", None), "like", None, 5, 'é "q"', "likert")]
    variants = {"default": "Go.\n"}
    rows = [("rate", "Look", likert, '{"type": "object", "a": [1, 2.5, null]}', variants), ("pick", "Look", pair("AB", "AB"), "{}", variants), ("mixed", "Look", pair("AB", "XY"), "{}", variants), ("odd", "Look", likert, "{}", variants)]
    instruments = spark.createDataFrame(rows, f"instrument string, instructions string, items array<{ITEM}>, schema string, variants map<string,string>")
    examples = spark.createDataFrame([("rate", 5, ["c2"], '{"like": 2}'), ("rate", 3, ["c1"], '{"z": "é", "like": 1}'), ("rate", 9, ["c1"], "{}"), ("odd", 0, ["nowhere"], "{}")], "instrument string, pos int, clips array<string>, answer string")
    clips = spark.createDataFrame([(f"c{i}", f"s{i}") for i in (1, 2, 3)], "clip_id string, sha256 string")
    cards = spark.createDataFrame([("p", "Card")], "persona_id string, card string")
    trials = [
        ("one", "rate", "p", "default", ["c3"]), ("none", "rate", "p", "default", []), ("two", "pick", "p", "default", ["c2", "c1"]), ("mixed", "mixed", "p", "default", ["c2", "c1"]), ("odd", "odd", "p", "default", []),
        ("lost", "rate", "p", "default", ["c9"]), ("variant", "rate", "p", "other", ["c1"]), ("three", "rate", "p", "default", ["c1", "c2", "c3"]), ("who", "rate", "q", "default", ["c1"]), ("what", "x", "p", "default", ["c1"]),
    ]
    t = spark.createDataFrame(trials, "trial_id string, instrument string, persona_id string, prompt_variant string, clip_ids array<string>")
    return {r.trial_id: r for r in requests.rendered(t, cards, instruments, examples, clips, 2).collect()}


def test_every_trial_has_a_row_with_its_reason(rendered):
    problems = {k: r.problem for k, r in rendered.items()}
    assert problems == {
        "one": None, "none": None, "two": None, "mixed": "pair_without_labels", "odd": "unknown_clip", "lost": "unknown_clip", "variant": "unknown_prompt_variant",
        "three": "too_many_clips", "who": "unknown_persona", "what": "unknown_instrument",
    }
    assert all((r.request is None) == (r.parts is None) == (r.problem is not None) for r in rendered.values())


def test_requests_are_canonical_json(rendered):
    got = json.loads(rendered["one"].request)
    assert rendered["one"].request == canonical(got)
    assert got["clips"] == [{"clip_id": "c3", "sha256": "s3"}] and got["response_schema"] == {"type": "object", "a": [1, 2.5, None]}
    assert got["practice"] == [{"answer": {"z": "é", "like": 1}, "clips": [{"clip_id": "c1", "sha256": "s1"}]}, {"answer": {"like": 2}, "clips": [{"clip_id": "c2", "sha256": "s2"}]}]
    assert got["items"] == [{"anchors": {"high": "very", "low": None}, "id": "like", "options": None, "points": 5, "text": 'é "q"', "type": "likert"}]
    assert got["prompt"] == "Go.\n" and got["persona_card"] == "Card"
    assert list(rendered["one"].clip_ids) == ["c1", "c2", "c3"]
    assert json.loads(rendered["two"].request)["practice"] == []


def test_prompts_keep_the_order_of_parts(rendered):
    flat = lambda k: [p.text if p.kind == "text" else (p.clip_id, p.sha256, p.role) for p in rendered[k].parts]
    assert flat("one")[:9] == ["Card", "Look", "Practice example 1:", ("c1", "s1", "practice"), 'Intended answer: {"like":1,"z":"é"}', "Practice example 2:", ("c2", "s2", "practice"), 'Intended answer: {"like":2}', "Video to rate:"]
    assert flat("one")[9:11] == [("c3", "s3", "target"), "Go.\n"] and flat("none")[8] == "Go.\n"
    assert flat("two")[2:6] == ["Video A:", ("c2", "s2", "target"), "Video B:", ("c1", "s1", "target")]
    assert flat("two")[-1] == "Response schema: {}" and flat("two")[-2].startswith('Items: [{"anchors":null,"id":"i0","options":["A","B"]')


def test_usage_and_codes(spark):
    rows = [('{"prompt_token_count": 5, "prompt_tokens_details": [{"modality": "text", "token_count": 2}, {"modality": "TEXT"}]}', '{"prompt_tokens": 7, "completion_tokens_details": {"reasoning_tokens": 3}}'), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(requests.usage_by_modality(F.col("a")).alias("a"), requests.usage_by_details(F.col("b")).alias("b"), requests.error_code(F.lit("Data_Inspection.Failed")).alias("c")).collect()
    assert got[0].a.asDict() == {"input_tokens": 5, "output_tokens": 0, "text_tokens": 2, "video_tokens": 0, "audio_tokens": 0, "thoughts_tokens": 0}
    assert (got[0].b.input_tokens, got[0].b.output_tokens, got[0].b.text_tokens, got[0].b.reasoning_tokens) == (7, 0, None, 3)
    assert got[1].a is None and got[1].b is None and got[0].c == "datainspectionfailed"


def test_event_folds(spark):
    e = spark.createDataFrame([("t", 1, "sent"), ("t", 2, "valid"), ("t", 3, "sent"), ("t", 4, "failed"), ("u", 1, "planned"), ("u", 2, "sent")], "trial_id string, seq int, state string")
    assert {tuple(r) for r in events.states_now(e).collect()} == {("t", "valid"), ("u", "sent")}
    e = spark.createDataFrame([("t", 1, 1, 5.0, None), ("t", 1, 2, None, 3.0), ("t", 1, 3, None, None), ("t", 1, 4, 9.0, None), ("t", 2, 1, 1.0, None)], "trial_id string, attempt int, seq int, reserved_usd double, actual_usd double")
    assert {tuple(r) for r in events.ledger_now(e).collect()} == {("t", 1, 5.0, 3.0), ("t", 2, 1.0, None)}
    assert events.attempts_now(e.limit(0), ["actual_usd"]).collect() == []


def test_registry(spark):
    tests = spark.createDataFrame([("a", "main", ["x", "y"]), ("b", "screening", ["z"]), ("c", "pilot", ["y", "s"])], "name string, kind string, instruments array<string>")
    clips = spark.createDataFrame([("a", "c2", "target"), ("a", "c1", "target"), ("a", "c3", "practice")], "test string, clip_id string, role string")
    got = {r.name: [tuple(c) for c in r.clips] for r in registry.tests_with_clips(tests, clips).collect()}
    assert got == {"a": [("target", "c1"), ("target", "c2"), ("practice", "c3")], "b": [], "c": []}
    one = lambda v: spark.createDataFrame([(v,)], "instrument string")
    assert [(r.instrument, list(r.tests)) for r in registry.needed_instruments(tests, one("s"), one("x")).collect()] == [("y", ["a", "c"])]
    items = lambda *v: spark.createDataFrame([(x,) for x in v], "item_id string")
    assert [r.item_id for r in registry.shared_items(items("a", "b"), items("b", "c")).collect()] == ["b"]
    stamps = spark.createDataFrame([("t", "m1", "x"), ("t", "m1", "x"), ("u", "m1", "x")], "test string, model_id string, instrument string")
    gone = spark.createDataFrame([("t", "a", "m2", "x"), ("v", "b", "m1", "x")], "test string, agent_id string, model_id string, instrument string")
    assert {tuple(r) for r in registry.gate_decisions(stamps, gone).collect()} == {("t", 1, 1, 1), ("u", 1, 0, 0), ("v", 0, 1, 1)}


def test_natural_ranks_over_many_ranges(spark):
    names = [f"{p}{i}" for i in range(1, 60) for p in ("a", "b")]
    rows = spark.createDataFrame([(n,) for n in names[::-1] + names[:9]], "name string")
    want = [f"a{i}" for i in range(1, 60)] + [f"b{i}" for i in range(1, 60)]
    assert {r.name: r["rank"] for r in references.natural_ranks(rows, "name").collect()} == {n: i + 1 for i, n in enumerate(want)}


def test_digest_of_many_chunks(spark, monkeypatch):
    """Chunks and ranges end anywhere; leads stand between the parts only, and tests may be null."""
    texts = {t: [f"{t}{i}é" * (i % 5) for i in range(400)] for t in (None, "a", "b")}
    rows = [(t, ", ", x, i == 0, i) for t, xs in texts.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "test string, lead string, text string, opens boolean, at int").repartition(7)
    for chunk in (1, 300, 1 << 22):
        monkeypatch.setattr(requests, "CHUNK", chunk)
        got = {r.test: (r.parts, r.characters, r.sha256) for r in requests.text_digests(df, [F.col("at")], 5).collect()}
        want = {t: xs[0] + ", ".join(xs[1:]) for t, xs in texts.items()}
        assert got == {t: (400, len(w), hashlib.sha256(w.encode()).hexdigest()) for t, w in want.items()}


def test_no_task_gathers_a_test(spark):
    """The texts of a test are sorted in as many tasks as the plan asks for, and are compressed where they meet."""
    df = spark.range(1000).select(F.lit("t").alias("test"), F.lit("").alias("lead"), F.repeat(F.lit("x"), 10_000).alias("text"), F.lit(False).alias("opens"), "id")
    plan = requests.text_digests(df, [F.col("id")], 9)._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan and "data#" in plan.split("hashpartitioning(test")[0]


def test_clip_lists_are_looked_up_once(spark):
    """Rows that show one clip have no second one; they don't meet in a task by its absence."""
    rows = spark.createDataFrame([(i, ["c1"] if i % 2 else ["c1", "c9"]) for i in range(20)] + [(20, []), (21, None)], "i int, clip_ids array<string>")
    clips = spark.createDataFrame([("c1", "h1")], "clip_id string, sha256 string")
    out = {r.i: r.refs for r in requests._with_refs(rows, "clip_ids", clips).collect()}
    assert len(out) == 22 and [tuple(x) for x in out[1]] == [("c1", "h1")] and [tuple(x) for x in out[0]] == [("c1", "h1"), ("c9", None)] and out[20] == []
    plan = requests._with_refs(rows, "clip_ids", clips)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan  # the lists, each once


def test_usage_reports_are_parsed_once(spark):
    """However many of a report's counts are asked for."""
    df = spark.createDataFrame([('{"prompt_token_count":3}', '{"prompt_tokens":4}'), (None, None)], "m string, d string").select(requests.usage_by_modality(F.col("m")).alias("a"), requests.usage_by_details(F.col("d")).alias("b"))
    total = df.agg(*[F.sum(c) for c in ("a.input_tokens", "a.output_tokens", "a.text_tokens", "a.video_tokens", "b.input_tokens", "b.output_tokens")])
    assert tuple(total.first()) == (3, 0, 0, 0, 4, 0)
    assert total._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 2
