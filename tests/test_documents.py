"""Documents against their rules, and what they refer to."""

from __future__ import annotations

import copy
import json

import pytest

from raterlake.operators import documents
from raterlake.sources import files

TEST = {
    "schema_version": 1, "test": "t1", "kind": "pilot", "instruments": ["a", "b"], "clips": ["c_aaaaaaaa"], "practice": [{"instrument": "a", "clips": ["c_aaaaaaab"], "answer": {"x": 1, "y": "s"}}],
    "session": {"repeats": 2},
}
MODEL = {"id": "m1", "provider": "fake", "model": "x-1", "max_output_tokens": 5, "limits": {"max_seconds": 1.5, "max_bytes": 10}}
STUDY = {
    "schema_version": 1, "seed": 5, "instruments": ["a"], "models": [MODEL], "thresholds": {"persona_fidelity_min": 0.8, "invalid_rate_max": 1, "leak_tolerance": {"duration_s": 1, "loudness_lufs": 0.5}},
    "personas": {"quotas": {k: ["x", "y"] for k in ("age_band", "gender", "cultural_region", "robot_experience")}},
}
INSTRUMENT = {"schema_version": 1, "name": "i", "version": "1", "instructions": "x", "prompt_variants": {"default": "d"}, "items": [{"id": "a", "type": "likert", "text": "t", "points": 5, "anchors": {"low": "l", "high": "h"}}]}
PRICE = {"input_usd_per_mtok": "1.25", "output_usd_per_mtok": "5", "media_tokens_per_s": "0", "chars_per_token": "4"}


def changed(base: dict, path: str = "", value: object = None) -> str:
    """The document with the value at a path replaced, or dropped for `DROP`."""
    doc = copy.deepcopy(base)
    at, *keys = doc, *path.split(".")
    for k in keys[:-1]:
        at = at[int(k) if isinstance(at, list) else k]
    if path:
        last = int(keys[-1]) if isinstance(at, list) else keys[-1]
        if value == "DROP":
            del at[last]
        else:
            at[last] = value
    return json.dumps(doc)


CASES = [
    ("test", TEST, "", None, None),
    ("test", TEST, "kind", "DROP", "kind: field required"),
    ("test", TEST, "kind", "x", "kind: input should be 'pilot', 'screening' or 'main'"),
    ("test", TEST, "kind", 3, "kind: input should be 'pilot', 'screening' or 'main'"),
    ("test", TEST, "schema_version", 2, "schema_version: input should be 1"),
    ("test", TEST, "schema_version", "1", "schema_version: input should be 1"),
    ("test", TEST, "test", "-x\n", "test: string should match pattern '^[A-Za-z0-9][A-Za-z0-9_-]*$'"),
    ("test", TEST, "test", "x\n", "test: string should match pattern '^[A-Za-z0-9][A-Za-z0-9_-]*$'"),
    ("test", TEST, "instruments", [], "instruments: list should have at least 1 item after validation, not 0"),
    ("test", TEST, "instruments", ["a", "b", "b", "a"], "instruments: duplicate instrument 'b'"),
    ("test", TEST, "instruments", {"a": 1}, "instruments: input should be a valid list"),
    ("test", TEST, "instruments", None, "instruments: input should be a valid list"),
    ("test", TEST, "models", None, None),
    ("test", TEST, "models", [], "models: must list at least one model id, or be omitted for all"),
    ("test", TEST, "models", ["m1", "m0"], "models.1: string should match pattern '^m[1-9][0-9]*$'"),
    ("test", TEST, "clips", ["x", 3], "clips.0: string should match pattern '^c_[a-z2-7]{8}$'; clips.1: input should be a valid string"),
    ("test", TEST, "colour", {"deep": [1]}, "colour: extra inputs are not permitted"),
    ("test", TEST, "session", [1], "session: input should be a mapping"),
    ("test", TEST, "session.repeats", 0, "session.repeats: input should be greater than or equal to 1"),
    ("test", TEST, "session.repeats", 2.0, "session.repeats: input should be a valid integer"),
    ("test", TEST, "session.repeats", True, "session.repeats: input should be a valid integer"),
    ("test", TEST, "session.retry", {}, "session.retry: extra inputs are not permitted"),
    ("test", TEST, "practice.0.clips", ["c_aaaaaaaa"] * 3, "practice.0.clips: list should have at most 2 items after validation, not 3"),
    ("test", TEST, "practice.0.answer", {"x": 1.5, "y": None}, "practice.0.answer.x: input should be a text or an integer; practice.0.answer.y: input should be a text or an integer"),
    ("test", TEST, "practice.0", {"clips": ["c_aaaaaaaa"]}, "practice.0.instrument: field required; practice.0.answer: field required"),
    ("test", TEST, "checks", [{"instrument": "a", "item": "i", "clips": ["c_aaaaaaaa"], "expected": 3}], "checks: only allowed in a kind: screening Test"),
    ("test", TEST, "checks", [{"instrument": "a", "item": "i", "clips": ["c_aaaaaaaa", "c_aaaaaaaa"], "expected": 3}], "checks.0.clips: duplicate clip 'c_aaaaaaaa'"),
    ("study", STUDY, "", None, None),
    ("study", STUDY, "seed", 2**63 - 1, None),
    ("study", STUDY, "seed", 2**63, "seed: input should be less than 9223372036854775808"),
    ("study", STUDY, "models.0.max_output_tokens", 0, "models.0.max_output_tokens: input should be greater than 0"),
    ("study", STUDY, "models.0.limits.max_seconds", "1", "models.0.limits.max_seconds: input should be a valid number"),
    ("study", STUDY, "models.0.limits.max_seconds", 2, None),
    ("study", STUDY, "models.0.settings", {"temperature": 0}, "models.0.settings.temperature: input should be greater than 0"),
    ("study", STUDY, "models.0.settings", {"fps": 1}, "models.0: settings.fps: only allowed for provider: gemini"),
    ("study", STUDY, "models.0.settings", {"fps": None, "seed_supported": True}, "models.0: settings.seed_supported: not allowed for provider: fake"),
    ("study", STUDY, "models.0.model", " ", "models.0.model: must be a pinned model version, not empty"),
    ("study", STUDY, "models.0.model", "x-Latest", "models.0.model: is not pinned; name an exact model version"),
    ("study", STUDY, "models.0.provider", "qwen", "models.0: settings.base_url: required for provider: qwen"),
    ("study", STUDY, "models.0", {**MODEL, "provider": "gemini", "fake": {}}, "models.0: fake: only allowed for provider: fake"),
    ("study", STUDY, "models.0", {**MODEL, "provider": "qwen", "settings": {"base_url": "https://x.AliyunCS.com./v1"}, "limits": {"max_seconds": 1, "max_bytes": 9_900_001}}, "models.0: limits: hosted qwen (Model Studio) takes a Clip only inline as a base64 string under 10 MB: set max_bytes <= 9900000 and inline_base64: true"),
    ("study", STUDY, "models.0", {**MODEL, "provider": "qwen", "settings": {"base_url": "https://myaliyuncs.com/v1"}, "limits": {"max_seconds": 1, "max_bytes": 9_900_001}}, None),
    ("study", STUDY, "models", [MODEL, {**MODEL, "model": "y"}], "models: duplicate model id 'm1'"),
    ("study", STUDY, "media", {"height": 481}, "media.height: must be even (H.264 yuv420p needs an even frame height)"),
    ("study", STUDY, "session", {"retry": {"backoff_max_s": 1}}, "session.retry: backoff_max_s must be at least backoff_initial_s"),
    ("study", STUDY, "thresholds.invalid_rate_max", 1.01, "thresholds.invalid_rate_max: input should be less than or equal to 1"),
    ("study", STUDY, "personas.quotas.gender", ["w", " "], "personas.quotas.gender: levels must be non-empty strings"),
    ("study", STUDY, "personas.nars_bands", ["low", "low"], "personas.nars_bands: duplicate band 'low'"),
    ("prices", {"schema_version": 1, "models": {"m1": PRICE}}, "", None, None),
    ("prices", {"schema_version": 1, "models": {"m1": PRICE}}, "models.m1.input_usd_per_mtok", 1.25, 'models.m1.input_usd_per_mtok: must be a non-negative decimal string, for example "0.30"'),
    ("prices", {"schema_version": 1, "models": {"m1": PRICE}}, "models.m1.chars_per_token", "0.00", 'models.m1.chars_per_token: must be a decimal string greater than 0, for example "4"'),
    ("prices", {"schema_version": 1, "models": {"m1": PRICE}}, "models", {"x": PRICE}, "models.x: string should match pattern '^m[1-9][0-9]*$'"),
    ("prices", {"schema_version": 1, "models": {"m1": PRICE}}, "models.m1.extra", 1, "models.m1.extra: extra inputs are not permitted"),
    ("instrument", INSTRUMENT, "", None, None),
    ("instrument", INSTRUMENT, "items.0.points", None, "items.0: likert item needs 'points'"),
    ("instrument", INSTRUMENT, "items.0.points", 12, "items.0.points: input should be less than or equal to 11"),
    ("instrument", INSTRUMENT, "items.0.type", "free_text", "items.0: free_text item takes no 'points' or 'anchors'"),
    ("instrument", INSTRUMENT, "items.0", {"id": "a", "type": "pairwise", "text": "t", "options": ["A", "A"]}, "items.0: pairwise 'options' must be two distinct labels, e.g. [A, B]"),
    ("instrument", INSTRUMENT, "items", [INSTRUMENT["items"][0], {"id": "b", "type": "pairwise", "text": "t"}], "items: an Instrument is either all pairwise items or has none"),
    ("instrument", INSTRUMENT, "prompt_variants", {"x": "y"}, "prompt_variants: must contain a 'default' variant"),
    ("instrument", INSTRUMENT, "instructions", "", "instructions: string should have at least 1 character"),
    ("instrument", INSTRUMENT, "keys", {"a": {"construct": "nars", "reversed": False}}, "keys.a: subscale: required for construct nars (s1, s2 or s3)"),
    ("instrument", INSTRUMENT, "keys", {"z": {"construct": "openness", "reversed": False}}, "keys: not an item of this Instrument"),
    ("instrument", INSTRUMENT, "self_report", True, "keys: a self_report Instrument must key every item"),
]


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(str(i), kind, changed(base, path, value)) for i, (kind, base, path, value, _) in enumerate(CASES)]
    rows += [("list", "test", "[1]"), ("broken", "study", "{"), ("null", "prices", None), ("text", "test", '"x"')]
    found = documents.problems(spark.createDataFrame(rows, "doc_id string, doc_kind string, json string"))
    return {r.doc_id: r.problem for r in documents.summaries(found).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(judged, i):
    assert judged.get(str(i)) == CASES[i][4]


def test_documents_that_are_none(judged):
    assert (judged["list"], judged["broken"], judged["null"], judged["text"]) == ("input should be a mapping", "not a JSON document", "not a JSON document", "input should be a mapping")


def test_no_documents(spark):
    assert documents.problems(spark.createDataFrame([], "doc_id string, doc_kind string, json string")).count() == 0


def test_yaml_documents(spark, tmp_path):
    for name, text in {"a": "schema_version: 1\nmodels: {m1: {input_usd_per_mtok: '1'}}\n", "b": "a: 1\na: 2\n", "c": "# nothing\n", "d": "- 1\n", "e": "a: [1\n", "f": "schema_version: 1\nmodels: {}\nday: 2024-05-01\n"}.items():
        (tmp_path / f"{name}.yaml").write_text(text)
    rows = files.yaml_documents(files.whole_texts(spark, str(tmp_path))).collect()
    got = {r.path.rsplit("/", 1)[1][0]: r for r in rows}
    assert {k for k, r in got.items() if r.problem is None} == {"a", "f"} and json.loads(got["a"].json) == {"schema_version": 1, "models": {"m1": {"input_usd_per_mtok": "1"}}}
    assert got["c"].problem == "file is empty" and got["d"].problem == "top level must be a mapping, got list" and "repeated key" in got["b"].problem and got["e"].problem.startswith("invalid YAML")
    df = spark.createDataFrame([(r.path, "prices", r.json) for r in rows if r.problem is None], "doc_id string, doc_kind string, json string")
    lines = {r.doc_id.rsplit("/", 1)[1][0]: r.problem for r in documents.summaries(documents.problems(df)).collect()}
    assert lines["f"] == "day: extra inputs are not permitted" and lines["a"].startswith("models.m1.output_usd_per_mtok: field required")


def test_prices_match_models(spark):
    make = lambda rows: spark.createDataFrame(rows, "study string, model_id string")
    out = documents.price_problems(make([("a", "m1"), ("a", "m2"), ("b", "m1"), ("b", "m1")]), make([("a", "m2"), ("a", "m3"), ("b", "m1")]))
    assert sorted(map(tuple, out.collect())) == [("a", "m1", "field required (a Model of the study)"), ("a", "m3", "not a Model id of the study")]


def test_references_of_tests(spark):
    make = spark.createDataFrame
    out = documents.reference_problems(
        make([("t", 0, "on"), ("t", 1, "off"), ("t", 2, "self"), ("t", 3, "none")], "test string, pos int, instrument string"), make([("on", True, False), ("off", False, False), ("self", True, True)], "name string, enabled boolean, self_report boolean"),
        make([("t", 0, "m1"), ("t", 1, "m9")], "test string, pos int, model_id string"), make([("m1",)], "model_id string"), make([("t", 0, "on"), ("t", 1, "else")], "test string, pos int, instrument string"),
    )
    assert [(r.code, r.field) for r in sorted(out.collect(), key=lambda r: r.place)] == [("unknown_instrument", "instruments.1"), ("instrument_not_allowed", "instruments.2"), ("unknown_instrument", "instruments.3"), ("config_invalid", "models.1"), ("unknown_instrument", "practice.1")]


def test_documents_of_one_file_are_spread_before_they_are_taken_apart(spark):
    docs = spark.createDataFrame([(f"d{i}", "test", changed(TEST, "kind", "poll")) for i in range(40)], "doc_id string, doc_kind string, json string").coalesce(1)
    found = documents.problems(docs)
    assert found.rdd.getNumPartitions() == 4 and found.count() == 40
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    # one shuffle, of the texts: below the rows of nodes and below the join of a document's problems
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.rindex("Generate explode")
