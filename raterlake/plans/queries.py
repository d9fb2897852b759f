"""The registered queries: each applies operators to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, jsons, numbers, seeds, texts
from ..operators import checks, copies, documents, events, export, leak, ledger, panel, planning, push, rater, references, registry, requests, scoring, screening, status, study
from ..operators import trials as trial_ops
from ..schema import ATTRITION_COUNTS, TRAITS, TRIAL_STATES
from ..sources import files, tables
from . import driverdata as d

STUDY_SEED = 7
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _cost(name: str):
    return F.col(name).cast("decimal(28,4)").alias(name)


def _rate(name: str):
    return F.round(name, 6).alias(name)


@query
def status_rollup(spark, sf):
    out = status.status_rollup(d.trials(spark, sf), d.attempts(spark, sf))
    return out.select("test", "model", "agent", *TRIAL_STATES, "trials", "retried", _cost("cost_usd"), _rate("invalid_rate"))


@query
def status_zero_tests(spark, sf):
    tests = spark.createDataFrame([("t1", None), ("t2", "ceiling"), ("t9", "ceiling")], "name string, paused_reason string")
    out = status.status_rollup(d.trials(spark, sf), d.attempts(spark, sf), tests)
    return out.filter("agent = '*' and model = '*'").select("test", "model", "agent", "trials", "paused", _cost("cost_usd"), _rate("invalid_rate"))


@query
def state_counts(spark, sf):
    return status.state_counts(d.trials(spark, sf))


@query
def invalid_rates_by_agent(spark, sf):
    return status.invalid_rates(d.trials(spark, sf), "agent_id").select("test", "key", "valid", "invalid", "refused", "failed", _rate("rate"))


@query
def invalid_rates_by_model(spark, sf):
    return status.invalid_rates(d.trials(spark, sf), "model_id").select("test", "key", "valid", "invalid", "refused", "failed", _rate("rate"))


@query
def plan_summary(spark, sf):
    return status.plan_summary(d.trials(spark, sf))


@query
def running_trials(spark, sf):
    return status.running(d.trials(spark, sf))


@query
def committed_spend(spark, sf):
    return ledger.committed(d.attempts(spark, sf)).select(_cost("committed_usd"))


@query
def cost_by_group(spark, sf):
    return ledger.cost_by_group(d.attempts(spark, sf), d.trials(spark, sf), ["test", "model_id", "instrument"]).select("test", "model_id", "instrument", _cost("cost_usd"))


@query
def current_ceiling(spark, sf):
    return ledger.current_ceiling(d.ceiling_changes(spark, sf))


@query
def cost_footer(spark, sf):
    out = study.cost_footer(d.attempts(spark, sf), d.ceiling_changes(spark, sf))
    return out.select(_cost("committed_usd"), _cost("ceiling_usd"), _cost("left_usd"))


@query
def status_document(spark, sf):
    return study.status_document(status.status_rollup(d.trials(spark, sf), d.attempts(spark, sf)))


@query
def ceiling_history(spark, sf):
    return ledger.ceiling_history(d.ceiling_changes(spark, sf))


def _sequenced(spark, sf):
    """A ledger whose reservations happened in order of trial and attempt."""
    return d.attempts(spark, sf).select((F.substring("trial_id", 2, 20).cast("bigint") * 1000 + F.col("attempt")).alias("seq"), "trial_id", "attempt", "reserved_usd", "actual_usd")


@query
def running_committed(spark, sf):
    return ledger.running_committed(_sequenced(spark, sf)).select("seq", "step", _cost("delta"), _cost("committed"))


@query
def over_ceiling_points(spark, sf):
    return ledger.over_ceiling(_sequenced(spark, sf), d.CEILING).select("seq", "trial_id", "attempt", _cost("committed"))


@query
def chosen_answer(spark, sf):
    return trial_ops.chosen_answer(d.answered(spark, sf))


@query
def exported_attempt(spark, sf):
    return trial_ops.exported_attempt(d.trials(spark, sf), d.answered(spark, sf)).select("trial_id", "state", "exported_attempt", "seed", "category", "answer_json")


@query
def budget_counts(spark, sf):
    return trial_ops.budget_counts(d.attempts(spark, sf))


@query
def settlement(spark, sf):
    return trial_ops.settlement(d.trials(spark, sf), d.attempts(spark, sf))


@query
def resume_classes(spark, sf):
    return trial_ops.resume_classes(d.trials(spark, sf), d.attempts(spark, sf))


@query
def attempt_seeds(spark, sf):
    return trial_ops.attempt_seeds(d.attempts(spark, sf), STUDY_SEED)


@query
def attempt_outcomes(spark, sf):
    return d.attempts(spark, sf).groupBy("category", trial_ops.outcome(F.col("category"), F.col("valid")).alias("outcome")).agg(F.count("*").alias("n"))


@query
def missing_attempts(spark, sf):
    """Trials that name an attempt which was never answered."""
    return trial_ops.orphans(d.trials(spark, sf), d.attempts(spark, sf).filter("category = 'ok'"))


@query
def next_run_number(spark, sf):
    return trial_ops.next_run_number(d.trials(spark, sf).select("test"), d.runs(spark).select("run_id"))


@query
def attrition_by_persona(spark, sf):
    return status.attrition_by_persona(d.trials(spark, sf))


@query
def status_by_attribute(spark, sf):
    return status.attrition_by_attribute(d.trials(spark, sf), d.personas(spark, sf), d.ATTRIBUTES)


@query
def attrition_sidecar(spark, sf):
    out = export.attrition_sidecar(d.trials(spark, sf), d.personas(spark, sf), d.blinding_key(spark, sf), d.ATTRIBUTES)
    return out.select("dimension", "attribute", "value", *ATTRITION_COUNTS)


TOLERANCE = {"duration_s": 1.0, "size_bytes": 500.0, "loudness_lufs": 0.5, "width": 0.0, "height": 0.0, "fps": 0.01}


@query
def leak_report(spark, sf):
    out = leak.leak_report(d.blinding_key(spark, sf), d.clips(spark, sf), TOLERANCE)
    return out.select("factor", "metric", "level", "n", F.round("mean", 4).alias("mean"), F.round("max_diff", 4).alias("max_diff"), "tolerance", "flagged")


@query
def leak_flags(spark, sf):
    out = leak.leak_report(d.blinding_key(spark, sf), d.clips(spark, sf), TOLERANCE)
    return out.groupBy("factor", "metric").agg(F.count_if("flagged").alias("flagged"), F.count("*").alias("levels"))


@query
def blinding_pivot(spark, sf):
    key = d.blinding_key(spark, sf)
    return export.blinding_wide(key, export.factors_of(key))


@query
def export_condition_cells(spark, sf):
    key = d.blinding_key(spark, sf)
    return export.condition_cells(d.trials(spark, sf), key, export.factors_of(key))


def _tidy(spark, sf):
    rows = export.tidy_rows(d.trials(spark, sf), d.answered(spark, sf), d.items(spark), d.personas(spark, sf), d.blinding_key(spark, sf), d.ATTRIBUTES)
    return rows.filter("status not in ('planned', 'sent')").drop("item_pos", "timestamp")


@query
def tidy_export_single(spark, sf):
    return _tidy(spark, sf).filter("pair_id is null").drop("clip_id_a", "clip_id_b", "pair_id", "brand_a", "brand_b", "type_a", "type_b", "position", "exclusion_reason", "protocol_lock")


@query
def tidy_export_pairwise(spark, sf):
    return _tidy(spark, sf).filter("pair_id is not null").drop("clip_id", "brand", "type", "exclusion_reason", "protocol_lock")


@query
def current_results(spark, sf):
    return screening.current_results(d.results(spark, sf), d.runs(spark)).select("run_id", "run_no", "model_id", "agent_id", "instrument", "outcome", "pos")


@query
def supersession(spark, sf):
    return screening.supersession(d.results(spark, sf), d.runs(spark))


@query
def latest_counting_rows(spark, sf):
    return screening.latest_counting(d.results(spark, sf), d.runs(spark), d.settings(spark), d.stamps(spark))


@query
def coverage_gaps(spark, sf):
    return screening.coverage_gaps(d.results(spark, sf), d.runs(spark), d.needed(spark), d.settings(spark), d.stamps(spark))


def _gate(spark, sf):
    needed = d.needed(spark).filter("instrument in ('view', 'error')")
    return screening.eligibility(d.agents(spark), needed, d.results(spark, sf), d.runs(spark), d.settings(spark), d.stamps(spark))


@query
def eligibility_gate(spark, sf):
    return _gate(spark, sf)


@query
def exclusion_counts(spark, sf):
    return screening.exclusion_counts(_gate(spark, sf))


@query
def stamp_drift(spark, sf):
    rows = d.results(spark, sf).filter("agent_id is null").groupBy("model_id", "instrument").agg(F.max_by("settings_hash", "pos").alias("settings_hash"), F.max_by("instrument_hash", "pos").alias("instrument_hash"))
    now = d.settings(spark).crossJoin(F.broadcast(d.stamps(spark))).select("model_id", "instrument", F.col("cur_settings").alias("settings_hash"), F.col("cur_instrument").alias("instrument_hash"))
    return screening.stamp_drift(rows, now)


@query
def panel_import_renumber(spark, sf):
    return screening.renumbered(d.results(spark, sf), d.runs(spark)).select("run_id", "new_run_id", "model_id", "agent_id", "instrument", "outcome")


def _shapes(spark):
    clips = spark.createDataFrame([("c9", 0), ("c10", 1), ("c2", 2), ("c7", 3)], "clip_id string, pos int")
    instruments = spark.createDataFrame([("rate", False, False, 0), ("pick", True, False, 1), ("self", False, True, 2)], "instrument string, pairwise boolean, self_report boolean, pos int")
    return planning.canonical_shapes(clips, instruments)


@query
def pairs_plan(spark, sf):
    """The pairs that instruments of two clips show of one clip per length."""
    out = planning.canonical_shapes(d.clip_per_length(spark, sf), d.listed_instruments(spark, sf))
    return out.filter("pair_id is not null").select("instrument", F.array_join("clip_ids", "|").alias("clips"), "pair_id", "position", "place")


def _sessions(spark, sf):
    models = spark.createDataFrame([("m1", 0), ("m2", 1)], "model_id string, pos int")
    return planning.sessions("main", d.personas(spark, sf), models, 3, STUDY_SEED)


def _variants(spark):
    return spark.createDataFrame([("rate", ["first", "second"]), ("pick", ["only"]), ("self", ["a", "b", "c"])], "instrument string, variants array<string>")


@query
def plan_trials_canonical(spark, sf):
    out = planning.plan_trials(_sessions(spark, sf), _shapes(spark), _variants(spark), shuffle=False)
    return out.withColumn("clips", F.array_join("clip_ids", "|")).drop("clip_ids")


@query
def plan_trials_shuffled(spark, sf):
    out = planning.plan_trials(_sessions(spark, sf), _shapes(spark), _variants(spark))
    return out.withColumn("clips", F.array_join("clip_ids", "|")).drop("clip_ids")


@query
def prompt_variant_rotation(spark, sf):
    out = planning.plan_trials(_sessions(spark, sf), _shapes(spark), _variants(spark), shuffle=False)
    return out.groupBy("instrument", "repeat", "prompt_variant").agg(F.count("*").alias("n"))


@query
def order_seeds(spark, sf):
    return _sessions(spark, sf).select("session_id", "order_seed")


@query
def fractional_profiles(spark, sf):
    """The profiles of each fraction, and how many personas of the panel have them."""
    held = d.card_panel(spark, sf).groupBy(*TRAITS).agg(F.count("*").alias("personas"))
    out = None
    for f in planning.GENERATORS:
        rows = planning.profiles(spark, f).join(held, list(TRAITS), "left").select(F.lit(f).alias("fraction"), "profile", *TRAITS, F.coalesce("personas", F.lit(0)).alias("personas"))
        out = rows if out is None else out.union(rows)
    return out


@query
def alias_chains(spark, sf):
    """Effects that a fraction of the panel can't tell apart, with their contrast in it."""
    out = [planning.alias_contrasts(d.card_panel(spark, sf), f).withColumn("fraction", F.lit(f)) for f in ("1/2", "1/4")]
    return out[0].union(out[1])


@query
def panel_generated(spark, sf):
    """A panel whose quota levels are what the tables hold."""
    return panel.generate(spark, STUDY_SEED, d.quota_levels(spark, sf), ["low", "high"], "1/2", 2)


@query
def quota_level_gaps(spark, sf):
    rows = d.personas(spark, sf).select(F.col("region").alias("nars"), F.col("nation").alias("age_band"), F.col("segment").alias("gender"), F.lit("x").alias("cultural_region"), F.lit("y").alias("robot_experience"))
    levels = rows.select(F.lit("age_band").alias("attribute"), F.col("age_band").alias("level")).distinct()
    return panel.quota_gaps(rows, levels)


@query
def perception_shapes(spark, sf):
    return scoring.perception_shapes(d.event_checks(spark, sf)).select("instrument", F.array_join("clip_ids", "|").alias("clips"), "pair_id", "position", F.col("place.pos").alias("first_check"))


@query
def perception_scores(spark, sf):
    out = scoring.perception_scores(d.perception_trials(spark, sf), d.checks(spark))
    return out.select("model_id", "instrument", "passed", "units", _rate("ratio"), "outcome")


@query
def pair_check_counts(spark, sf):
    return scoring.pair_check_counts(d.event_checks(spark, sf))


def _planned(spark):
    return spark.createDataFrame([(c, 40 if c == "openness" else 4) for c in d.CONSTRUCTS], "construct string, planned int")


@query
def fidelity_scores(spark, sf):
    out = scoring.fidelity_scores(d.fidelity_answers(spark, sf), d.fidelity_keys(spark), d.fidelity_poles(spark), _planned(spark))
    return out.select("agent_id", "matched", "total", _rate("ratio"), "insufficient", "outcome")


@query
def fidelity_constructs(spark, sf):
    out = scoring.fidelity_constructs(d.fidelity_answers(spark, sf), d.fidelity_keys(spark), d.fidelity_poles(spark))
    return out.select("agent_id", "construct", "pole", "n", _rate("score"), "midpoint", "matches")


@query
def validate_reasons(spark, sf):
    return scoring.validated(d.raw_answers(spark, sf), d.scale(spark)).select("id", "problem", F.try_element_at("answers", F.lit("k")).alias("answer"))


@query
def invalid_reason_counts(spark, sf):
    return scoring.validated(d.raw_answers(spark, sf), d.scale(spark)).groupBy(F.coalesce("problem", F.lit("valid")).alias("problem")).agg(F.count("*").alias("n"))


@query
def answer_key_set_check(spark, sf):
    """Valid attempts whose answer has just the items of its instrument."""
    want = d.items(spark).groupBy("instrument").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    rows = d.answered(spark, sf).filter("valid").join(d.trials(spark, sf).select("trial_id", "instrument"), "trial_id").join(F.broadcast(want), "instrument")
    same = F.array_sort(F.json_object_keys("answer_json")) == F.col("ids")
    return rows.groupBy("instrument").agg(F.count_if(same).alias("fits"), F.count("*").alias("answers"))


@query
def reissue_mismatches(spark, sf):
    a = d.attempts(spark, sf).join(d.trials(spark, sf).select("trial_id", "model_id"), "trial_id")
    return references.reissue_mismatches(d.archive(spark, sf), a.filter("category <> 'transient'").withColumn("sent", F.lit(True)))


@query
def archive_last_line_wins(spark, sf):
    lines = d.event_answers(spark, sf).select(F.col("event_id").alias("line_no"), "raw", F.lit("record").alias("kind"))
    keyed = lines.withColumn("trial_id", F.concat(F.lit("o"), (F.col("line_no") % 700).cast("string"))).withColumn("attempt", (F.col("line_no") % 2).cast("int"))
    return files.last_lines(keyed).select("trial_id", "attempt", "line_no", "raw")


def _asked(spark, sf):
    return d.trials(spark, sf).select("trial_id", "test", "model_id", "clip_ids", (400 + F.length("trial_id") * 7).alias("chars"))


@query
def cost_estimate(spark, sf):
    return planning.cost_estimate(_asked(spark, sf), d.clips(spark, sf), d.prices(spark)).select("test", F.col("expected").cast("decimal(28,9)").alias("expected"), F.col("worst_case").cast("decimal(28,9)").alias("worst_case"), "trials", "providers")


@query
def actual_cost(spark, sf):
    rows = d.attempts(spark, sf).join(d.trials(spark, sf).select("trial_id", "model_id"), "trial_id").join(F.broadcast(d.prices(spark)), "model_id")
    tokens_in = F.when(F.col("category") == "ok", 800 + F.col("seed")).when(F.col("category") == "refused", -1)
    cost = planning.usage_cost(tokens_in, F.lit(100), F.col("input_usd"), F.col("output_usd"))
    return rows.groupBy("model_id", "category").agg(F.sum(cost.cast("decimal(28,12)")).cast("decimal(28,9)").alias("cost_usd"), F.count(cost).alias("known"), F.count("*").alias("attempts"))


def _media(spark, sf):
    targets = d.trials(spark, sf).select("instrument", F.explode("clip_ids").alias("clip_id")).groupBy("instrument").agg(F.collect_set("clip_id").alias("targets"))
    shapes = targets.select("instrument", F.col("instrument").isin(*d.PAIRWISE).alias("pairwise"), F.array(F.lit("c1"), F.lit("c3")).alias("practice"), "targets")
    return planning.media_worst_case(shapes, d.clips(spark, sf), d.limits(spark))


@query
def media_worst_case(spark, sf):
    return _media(spark, sf).select("model_id", "instrument", "limit", "allowed", "total", F.array_join("picked", "|").alias("picked"), "exceeds")


@query
def media_violations(spark, sf):
    return _media(spark, sf).filter("exceeds").groupBy("model_id").agg(F.count("*").alias("violations"))


@query
def clip_kind_overlap(spark, sf):
    tests = spark.createDataFrame([("t1", "pilot"), ("t2", "main"), ("t3", "screening"), ("t4", "main")], "name string, kind string")
    clips = d.trials(spark, sf).select("test", F.explode("clip_ids").alias("clip_id")).distinct().withColumn("role", F.lit("target"))
    return references.kind_overlap(clips, tests)


@query
def unknown_references(spark, sf):
    known = d.clips(spark, sf).filter("duration_s > 10")
    return references.unknown_references(d.trials(spark, sf).select(F.explode("clip_ids").alias("clip_id")), known, "clip_id")


@query
def duplicate_detection(spark, sf):
    return references.duplicates(d._read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def first_seen_order(spark, sf):
    return references.first_seen(d.trials(spark, sf), ["test", "instrument"], "trial_index")


@query
def natural_sort_rank(spark, sf):
    return references.natural_ranks(d.trials(spark, sf).select("agent_id"), "agent_id")


@query
def usd_texts(spark, sf):
    a = d.attempts(spark, sf).select(F.coalesce("actual_usd", "reserved_usd").cast("decimal(18,4)").alias("x"))
    return a.groupBy(numbers.usd("x").alias("usd")).agg(F.count("*").alias("n"))


@query
def run_numbers(spark, sf):
    names = d.runs(spark).select("run_id").union(d.trials(spark, sf).select("test").distinct())
    return names.select(F.col("run_id").alias("name"), ids.run_number("run_id").alias("n"))


@query
def likert_from_latent(spark, sf):
    e = d._read(spark, sf, "events").select((F.pmod(F.col("event_id") * 37, F.lit(101)) / 101.0).alias("latent"))
    return e.groupBy(numbers.likert(F.col("latent"), 5).alias("points")).agg(F.count("*").alias("n"))


@query
def worst_clips(spark, sf):
    rank = F.row_number().over(Window.partitionBy("width").orderBy(F.desc("duration_s"), "clip_id"))
    return d.clips(spark, sf).withColumn("rank", rank).filter("rank <= 3").select("width", "rank", "clip_id", "duration_s")


@query
def request_digests(spark, sf):
    """Per test and session, the digest of its trials' canonical bodies in plan order."""
    t = d.trials(spark, sf)
    body = F.concat(F.lit('{"i":"'), "instrument", F.lit('","t":"'), "trial_id", F.lit('"}'))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("trial_index", body.alias("body")))), lambda x: x["body"])
    return t.groupBy("test", "session_id").agg(F.sha2(F.array_join(parts, ""), 256).alias("digest"))


@query
def offline_answers(spark, sf):
    """The offline rater over every planned first attempt."""
    t = d.trials(spark, sf)
    a = t.select("trial_id", F.lit(1).alias("attempt"), seeds.derived(STUDY_SEED, "model", F.concat("trial_id", F.lit("#1"))).alias("seed"), "instrument")
    return rater.rated(a, d.items(spark), {"transient": 0.05, "refused": 0.03, "fatal": 0.01}, 0.1)


def _rendered(spark, sf):
    return requests.rendered(d.trials(spark, sf), d.cards(spark, sf), d.instruments(spark), d.examples(spark), d.clip_hashes(spark, sf), 2)


@query
def rendered_requests(spark, sf):
    return _rendered(spark, sf).select("trial_id", "problem", F.sha2("request", 256).alias("request_sha256"), F.array_join("clip_ids", "|").alias("clips"))


@query
def prompt_parts(spark, sf):
    line = lambda p: F.concat_ws("|", p["kind"], p["text"], p["clip_id"], p["sha256"], p["role"])
    return _rendered(spark, sf).select("trial_id", F.size("parts").alias("n_parts"), F.sha2(F.array_join(F.transform("parts", line), "\n"), 256).alias("prompt_sha256"))


@query
def practice_chosen(spark, sf):
    """The first two examples of each instrument in each customer's plan."""
    rows = d.customer_plans(spark, sf)["practice"].withColumn("instrument", F.concat_ws("/", "test", "instrument"))
    return requests.practice(rows, 2).select("instrument", "n", F.array_join("clips", "|").alias("clips"))


@query
def usage_totals(spark, sf):
    u = d.usage_reports(spark, sf).select(requests.usage_by_modality(F.col("by_modality")).alias("a"), requests.usage_by_details(F.col("by_details")).alias("b"))
    fields = {"a": ["input_tokens", "output_tokens", "text_tokens", "video_tokens", "audio_tokens", "thoughts_tokens"], "b": ["input_tokens", "output_tokens", "text_tokens", "video_tokens", "audio_tokens", "reasoning_tokens"]}
    return u.agg(*[F.sum(f"{k}.{c}").alias(f"{k}_{c}") for k, names in fields.items() for c in names], F.count("a").alias("reports"))


@query
def error_codes(spark, sf):
    return d.attempts(spark, sf).groupBy(requests.error_code(F.concat(F.lit("Rate_Limit."), "category")).alias("code")).agg(F.count("*").alias("n"))


@query
def attempts_from_events(spark, sf):
    return events.attempts_now(d.attempt_events(spark, sf), ["sent_at", "handle", "category", "valid"])


@query
def states_from_events(spark, sf):
    return events.states_now(d.state_events(spark, sf))


@query
def ledger_from_events(spark, sf):
    return events.ledger_now(d.ledger_events(spark, sf)).select("trial_id", "attempt", _cost("reserved_usd"), _cost("actual_usd"))


@query
def tests_with_clips(spark, sf):
    out = registry.tests_with_clips(d.tests(spark, sf), d.test_clips(spark, sf))
    return out.select("name", "kind", F.array_join(F.transform("clips", lambda c: F.concat_ws(":", c["role"], c["clip_id"])), "|").alias("clips"))


@query
def gate_decisions(spark, sf):
    t = d.trials(spark, sf)
    lost = t.filter("state = 'failed'").select("test", "agent_id", "model_id", "instrument").distinct()
    return registry.gate_decisions(t.filter("state = 'valid'"), lost)


@query
def needed_instruments(spark, sf):
    given = spark.createDataFrame([("5-LOW", "self"), ("3-MEDIUM", "covered")], "instrument string, why string")
    out = registry.needed_instruments(d.tests(spark, sf), given.filter("why = 'self'"), given.filter("why = 'covered'"))
    return out.select("instrument", F.array_join("tests", "|").alias("tests"))


@query
def plan_problems(spark, sf):
    p = d.customer_plans(spark, sf)
    return checks.plan_problems(p["tests"], p["listed"], d.known_instruments(spark), p["targets"], p["practice"], 1)


@query
def check_problems(spark, sf):
    return checks.check_problems(d.user_checks(spark, sf), d.check_items(spark), d.user_targets(spark, sf))


@query
def answer_schemas(spark, sf):
    out = checks.answer_schemas(d.part_items(spark, sf))
    return out.select("instrument", F.length("schema").alias("characters"), F.sha2("schema", 256).alias("sha256"))


@query
def stale_summary(spark, sf):
    stale = screening.latest_counting(d.results(spark, sf), d.runs(spark), d.settings(spark), d.stamps(spark)).filter("outcome = 'stale'")
    return checks.stale_summary(stale, F.concat_ws("|", "model_id", "instrument", "agent_id"))


@query
def shared_items(spark, sf):
    """Names that parts of two types share."""
    named = lambda kind: d._read(spark, sf, "part").filter(F.col("p_type") == kind).select(F.concat_ws("_", "p_name", "p_size").alias("item_id"))
    return registry.shared_items(named("ECONOMY"), named("PROMO"))


@query
def kept_agents(spark, sf):
    """Sessions of the agents that passed a fidelity screening."""
    passed = d.results(spark, sf).filter("agent_id is not null and outcome = 'pass'")
    return planning.kept_agents(_sessions(spark, sf), passed).select("session_id", "agent_id", "order_seed")


@query
def flat_personas(spark, sf):
    return study.flat_personas(d.panel(spark, sf))


@query
def sentence_problems(spark, sf):
    return d.sentences(spark, sf).select("id", texts.sentence_problem("text").alias("problem"))


@query
def leak_texts(spark, sf):
    return leak.report_texts(leak.leak_report(d.blinding_key(spark, sf), d.clips(spark, sf), TOLERANCE))


@query
def utc_texts(spark, sf):
    at = F.timestamp_millis(F.col("event_id") * 99991007)
    return d._read(spark, sf, "events").select("event_id", texts.utc_seconds(at).alias("at"), texts.utc_millis(at).alias("at_ms"))


@query
def screen_summary(spark, sf):
    detail = F.concat(F.lit('{"insufficient_data":'), F.when(F.col("pair_checks") == 0, "true").otherwise("false"), F.lit("}"))
    return screening.screen_summary(d.results(spark, sf).withColumn("detail", detail))


@query
def canonical_stamps(spark, sf):
    return d._read(spark, sf, "events").select("event_id", jsons.stamp(F.col("props")).alias("sha256"))


@query
def name_problems(spark, sf):
    """Which order priorities, brands, part names and run names could be names of tests."""
    part = d._read(spark, sf, "part")
    names = part.select("p_brand").union(part.select("p_name")).union(part.select(F.regexp_replace("p_name", " ", "-"))).union(part.select(F.concat(F.lit("s"), "p_size"))).union(part.select(F.concat(F.lit("t"), "p_size", F.lit("-attrition"))))
    return names.toDF("name").distinct().select("name", ids.test_name_problem("name").alias("problem"))


@query
def condition_pairs(spark, sf):
    text = F.concat(F.when(F.col("p_size") > 3, " brand "), F.when(F.col("p_size") < 45, F.lit("=")).otherwise(F.lit(":")), "p_brand", F.lit("= x "))
    out = d._read(spark, sf, "part").select("p_partkey", ids.condition_parts(text).alias("c"))
    return out.select("p_partkey", "c.factor", "c.level")


@query
def retry_delays(spark, sf):
    jitter = F.pmod(F.col("seed"), F.lit(8)) / 8.0
    return d.attempts(spark, sf).select("trial_id", "attempt", F.round(numbers.backoff(F.col("attempt"), 2.0, 30.0, jitter), 6).alias("wait_s"))


@query
def frame_rates(spark, sf):
    rate = F.concat(F.col("p_size") * 1000, F.lit("/"), F.when(F.col("p_size") > 40, F.lit("0")).otherwise(F.lit("1001")))
    return d._read(spark, sf, "part").select("p_partkey", F.round(numbers.frame_rate(rate), 6).alias("fps"))


@query
def price_texts(spark, sf):
    text = F.col("p_retailprice").cast("string")
    return d._read(spark, sf, "part").select("p_partkey", numbers.is_price(text).alias("plain"), numbers.usd(numbers.money(text)).alias("usd"))


@query
def card_texts(spark, sf):
    return d.card_panel(spark, sf).select("id", panel.card(d.WORDING).alias("card"))


@query
def card_cues(spark, sf):
    cards = d.card_panel(spark, sf).select("id", panel.card(d.WORDING).alias("card"))
    return panel.card_cues(cards, d.card_sentences(spark))


@query
def session_ranks(spark, sf):
    return references.natural_ranks(d.trials(spark, sf).select("session_id"), "session_id")


@query
def archive_fragments(spark, sf):
    """The lines of an archive by what they are, read by ranges of bytes."""
    folder = files.scratch_folder(spark)
    d.archive_texts(spark, sf).select("value").write.text(folder)
    lines = files.classified(files.archive_lines(spark, folder))
    # places are counted exactly as bits, 64 to a word: a set of single places would not fit a task
    words = lines.groupBy(F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pos & 63 as int))")).alias("bits"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    return lines.groupBy("kind").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("characters"), F.count("trial_id").alias("keyed")).union(
        words.agg(F.lit("placed"), F.sum(F.bit_count("bits").cast("bigint")), F.max("last") - F.min("first"), F.lit(0).cast("bigint"))
    )


@query
def rounded_texts(spark, sf):
    return d.rounding_values(spark, sf).select("p_partkey", "form", texts.four_decimals("x").alias("text"))


@query
def ceiling_decisions(spark, sf):
    out = ledger.ceiling_decisions(d.ceiling_requests(spark, sf))
    return out.select("study", "seq", _cost("amount"), _cost("ceiling_usd"), "refusal", _cost("previous_usd"))


@query
def document_problems(spark, sf):
    return documents.problems(d.test_documents(spark, sf)).select("doc_id", "field", "reason")


@query
def document_summaries(spark, sf):
    return documents.summaries(documents.problems(d.test_documents(spark, sf)))


@query
def price_matches(spark, sf):
    return documents.price_problems(*d.nation_models(spark, sf))


@query
def test_references(spark, sf):
    """What customers' plans refer to wrongly."""
    p = d.customer_plans(spark, sf)
    known = spark.createDataFrame([("1-URGENT", True, False), ("2-HIGH", False, False), ("3-MEDIUM", False, True), ("5-LOW", True, True)], "name string, enabled boolean, self_report boolean")
    models = p["tests"].select("test", F.lit(0).alias("pos"), F.concat(F.lit("m"), (F.substring("test", 2, 20).cast("bigint") % 4).cast("string")).alias("model_id"))
    out = documents.reference_problems(p["listed"], known, models, d.prices(spark).select("model_id"), p["practice"].select("test", F.col("pos").cast("int").alias("pos"), "instrument"))
    return out.select("test", F.array_join(F.transform("place", lambda x: x.cast("string")), "/").alias("place"), "code", "field")


@query
def push_outcomes(spark, sf):
    p = d.pushes(spark, sf)
    return push.pushed_tests(p["pushed"], p["registered"], p["stored"], p["clips"], p["test_clips"]).select("pos", "name", "outcome", "code")


@query
def registered_after_push(spark, sf):
    p = d.pushes(spark, sf)
    out = push.pushed_tests(p["pushed"], p["registered"], p["stored"], p["clips"], p["test_clips"])
    return push.registered_after(out, p["registered"])


@query
def leaks_after_push(spark, sf):
    key = push.conditions_after(d.pushed_conditions(spark, sf), d.blinding_key(spark, sf))
    return leak.report_texts(leak.leak_report(key, d.clips(spark, sf), TOLERANCE))


@query
def plan_digests(spark, sf):
    return requests.plan_digests(d.trials(spark, sf), _rendered(spark, sf), trial_ops.plan_order())


@query
def status_reports(spark, sf):
    """A document's size and digest, which tell as much as its text."""
    parts = study.status_report_parts(d.trials(spark, sf), d.attempts(spark, sf), d.paused_tests(spark, sf), d.ceiling_changes(spark, sf), d.personas(spark, sf), tuple(d.ATTRIBUTES))
    return requests.text_digests(parts, [F.col("at"), F.col("key")]).select("test", "characters", "sha256")


@query
def persona_results(spark, sf):
    out = scoring.persona_results(d.persona_trials(spark, sf), d.persona_answers(spark, sf), d.self_keys(spark), d.persona_poles(spark, sf), d.persona_settings(spark, sf), d.persona_runs(spark, sf), 0.5)
    return out.select("run_id", "agent_id", "model_id", "outcome", _rate("score"), "matched", "total", "insufficient", "problem", "settings_hash")


@query
def resolved_instruments(spark, sf):
    s = d.studies_of_parts(spark, sf)
    return registry.resolved_instruments(s["wanted"], s["user"], s["builtin"])


@query
def resolved_variants(spark, sf):
    """The wording of each trial's prompt; some name a variant that isn't there."""
    variants = d.trials(spark, sf).select("instrument").distinct().select("instrument", F.explode(F.array(F.lit("default"), F.substring("instrument", 1, 1))).alias("variant")).withColumn("text", F.concat_ws(" by ", "instrument", "variant"))
    wanted = d.trials(spark, sf).select("trial_id", "instrument", F.when(F.col("repeat") == 1, F.when(F.col("model_id") == "m1", F.substring("instrument", 1, 1)).otherwise("3")).alias("prompt_variant"))
    return registry.resolved_variants(wanted, variants).select("trial_id", "variant", "wording")


@query
def self_report_problems(spark, sf):
    instruments, items = d.questionnaires(spark, sf)
    taken = d._read(spark, sf, "part").filter("p_size between 40 and 41").select(F.concat(F.lit("q"), "p_size", F.lit("_"), "p_partkey").alias("item_id"))
    return registry.self_report_problems(instruments, items, taken)


@query
def stamp_maps(spark, sf):
    rows = d.results(spark, sf).filter("agent_id is null").select(F.col("run_id").alias("test"), "pos", "model_id", "instrument", "settings_hash", "instrument_hash")
    out = registry.stamp_map(rows)
    return out.select("test", F.size("stamps").alias("pairs"), F.array_join(F.transform(F.map_entries("stamps"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("stamps"))


@query
def exclusions_in_order(spark, sf):
    lost = d.trials(spark, sf).filter("state = 'failed'").groupBy("test", "agent_id").agg(F.min("trial_index").alias("pos"), F.min_by("instrument", "trial_index").alias("reason"))
    out = registry.exclusions_in_order(lost)
    return out.select("test", F.size("excluded").alias("n"), F.sha2(F.array_join(F.transform("excluded", lambda x: F.concat_ws("|", x["agent_id"], x["reason"])), ","), 256).alias("listed"))


def _moved(spark, sf):
    """The personas with those of one nation moved to another, and one region's twice."""
    p = d.personas(spark, sf)
    moved = p.withColumn("nation", F.when(F.col("nation") == F.lit("NATION_3"), "NATION_4").otherwise(F.col("nation")))
    return moved.union(p.filter("region = 'ASIA'"))


@query
def frame_differences(spark, sf):
    return copies.differences(_moved(spark, sf), d.personas(spark, sf))


@query
def source_hashes(spark, sf):
    """Per region, the digest of its personas' cards and its agents' results."""
    people = d.personas(spark, sf).select(F.col("id").alias("persona_id"), "region")
    cards = d.cards(spark, sf).join(people, "persona_id").select("region", F.concat("persona_id", F.lit(".md")).alias("name"), F.sha2("card", 256).alias("sha256"))
    own = d.results(spark, sf).filter("agent_id is not null").withColumn("persona_id", F.split_part("agent_id", F.lit("-"), F.lit(1))).join(people, "persona_id")
    return copies.source_hash(cards, own.select("region", "pos", "run_id", "model_id", "agent_id", "outcome", "pair_checks"), "pos", ["region"])


@query
def open_dry_run(spark, sf):
    """What opening the tests again would do, under ceilings typed for them."""
    t = d.trials(spark, sf)
    estimates = planning.cost_estimate(_asked(spark, sf), d.clips(spark, sf), d.prices(spark))
    spent = d.attempts(spark, sf).agg(numbers.total(F.coalesce("actual_usd", "reserved_usd")).alias("committed_usd"))
    given = F.when(F.col("test") == "t1", "1e12").when(F.col("test") == "t3", "much").when(F.col("test") == "t4", "5")
    asked = estimates.select("test", F.col("expected").alias("expected_usd")).crossJoin(F.broadcast(spent))  # one row
    asked = asked.select("test", F.lit("main").alias("study"), F.substring("test", 2, 5).cast("bigint").alias("seq"), given.alias("given"), "expected_usd", "committed_usd", F.lit(True).alias("fresh"), F.lit(False).alias("uncapped_ok"))
    lost = t.filter("state = 'failed'").select("test", "agent_id").distinct().withColumn("reason", F.lit("screening_stale"))
    out = study.dry_run(t, _rendered(spark, sf), estimates, ledger.ceiling_decisions(asked), lost, d.paused_tests(spark, sf))
    return out.select("test", "trials", "sessions", "agents", "uniform", "requests", "requests_sha256", "unrendered", F.col("expected").cast("decimal(28,9)").alias("expected"), F.col("worst_case").cast("decimal(28,9)").alias("worst_case"), "providers", _cost("ceiling_usd"), "would_refuse", "excluded", "paused")


@query
def plan_places(spark, sf):
    return trial_ops.plan_places(d.trials(spark, sf)).select("test", "trial_id", "place")


@query
def scoring_keys(spark, sf):
    return registry.scoring_keys(d.instrument_documents(spark, sf))


@query
def clip_scan(spark, sf):
    """The clips that tests show, by their ids."""
    t = {"clips": d.clips(spark, sf)}
    return tables.scan(t, "clips", d.test_clips(spark, sf).filter("role = 'target'")).select("clip_id", "duration_s", "size_bytes", "loudness_lufs")


@query
def typed_trials(spark, sf):
    """Trials as records of the study's schema, their keys checked; columns that are missing are null."""
    t = tables.with_table({}, "trials", d.trials(spark, sf))["trials"]
    return t.groupBy("test", "model_id").agg(F.count("*").alias("trials"), F.count("order_seed").alias("seeded"), F.sum(F.size("clip_ids")).alias("clips"), F.max("trial_index").alias("last"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
