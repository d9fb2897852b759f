"""Whole flows and reports of a study, composed of the operators. What changes a study gives a
new one; what is refused raises and has changed nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import ids, numbers
from ..schema import ATTRITION_COUNTS, TRAITS, TRIAL_STATES
from ..sources import tables
from ..sources.tables import Study
from . import copies
from . import export as exports
from . import ledger as spend
from . import planning, references, scoring, screening, status
from . import requests as renders
from . import trials as trial_ops

_NULLS = {"ignoreNullFields": "false"}
ATTRIBUTES = (*TRAITS, "nars", "age_band", "gender", "cultural_region", "robot_experience")


def cost_footer(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: what is committed, the ceiling set last, and what it leaves; null without one."""
    both = spend.committed(ledger).crossJoin(F.broadcast(spend.current_ceiling(changes)))
    return both.select("committed_usd", "ceiling_usd", (F.col("ceiling_usd") - F.col("committed_usd")).alias("left_usd"))


def status_document(rollup: DataFrame) -> DataFrame:
    """test, model, agent and the counts of a row of the status rollup as one JSON text, in
    the order of the life cycle."""
    body = F.to_json(F.struct(*TRIAL_STATES, "trials", "retried"))
    return rollup.select("test", "model", "agent", body.alias("document"))


def _by(field: str):
    """Order of structs by one field, for those that hold maps."""
    return lambda a, b: F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(0)


def status_report_parts(trials: DataFrame, ledger: DataFrame, tests: DataFrame, changes: DataFrame, personas: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES, neutral: str = "p0") -> DataFrame:
    """The documents of `status_reports` in parts, so that none has to be held: test, lead, text
    and opens as `requests.text_digests` takes them, in the order of at (0: what stands before
    the rows, 1: a row of the rollup, 2: what stands after) and key."""
    rollup = status.status_rollup(trials, ledger, tests)
    row = F.struct("test", "model", "agent", *TRIAL_STATES, "trials", "retried", "invalid_rate", numbers.usd("cost_usd").alias("cost_usd"), "paused")
    key = F.struct(*[ids.natural_key(c).alias(c) for c in ("test", "model", "agent")])
    part = lambda test, at, key, lead, text, opens: [test, F.lit(at).alias("at"), key.alias("key"), F.lit(lead).alias("lead"), text.alias("text"), F.lit(opens).alias("opens")]
    rows = rollup.select(*part(F.explode(F.array("test", F.lit(None))).alias("test"), 1, key, ",", F.to_json(row, _NULLS), False))
    names = trials.select("test").union(tests.select("name")).distinct()
    documents = names.union(names.select(F.lit(None).cast("string")).distinct())

    mine = trials.filter(F.col("persona_id") != neutral)
    lost = references.unknown_references(mine, personas.select(F.col("id").alias("persona_id")), "persona_id").agg((F.count("*") > 0).alias("lost"))
    tally = status.attrition_by_attribute(mine, personas, list(attributes))
    values = tally.groupBy("test", "attribute").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("first", "value", F.struct(*ATTRITION_COUNTS).alias("counts")))), lambda x: F.struct(x["value"], x["counts"]))).alias("values"))
    named = tests.select(F.col("name").alias("test"), F.posexplode(F.array(*[F.lit(a) for a in attributes])).alias("pos", "attribute"))
    empty = F.create_map().cast(values.schema["values"].dataType)
    per = named.join(values, ["test", "attribute"], "left").groupBy("test").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("persona_"), "attribute").alias("attribute"), F.coalesce("values", empty).alias("values"))), _by("pos")), lambda x: F.struct(x["attribute"], x["values"]))).alias("tally"))
    tallies = per.groupingSets([[F.col("test")], []], "test").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("test").alias("k"), "tally")), _by("k"))).alias("tallies"))

    paused = tests.filter("paused_reason is not null").agg(F.array_sort(F.collect_list(F.struct(F.col("name").alias("test"), F.col("paused_reason").alias("reason")))).alias("paused_tests"))
    footer = cost_footer(ledger, changes).crossJoin(F.broadcast(paused)).crossJoin(F.broadcast(lost))  # one row each
    both = documents.alias("s").join(F.broadcast(tallies).alias("t"), F.col("s.test").eqNullSafe(F.col("t.test")), "left").select("s.test", "tallies").crossJoin(F.broadcast(footer))
    head = F.to_json(F.struct(F.lit(1).alias("schema_version"), "test"), _NULLS)
    tail = F.struct(
        numbers.usd("committed_usd").alias("committed"), F.when(F.col("ceiling_usd").isNotNull(), numbers.usd("ceiling_usd")).alias("ceiling"),
        F.when(F.size("paused_tests") > 0, "paused").otherwise("ok").alias("state"), F.col("paused_tests").alias("paused"), F.when(~F.col("lost"), F.col("tallies")).alias("by_persona_attribute"),
    )
    none = F.lit(None).cast(rows.schema["key"].dataType)
    heads = documents.select(*part(F.col("test"), 0, none, "", F.concat(F.left(head, F.length(head) - 1), F.lit(',"rows":[')), True))
    return rows.unionByName(heads).unionByName(both.select(*part(F.col("test"), 2, none, "", F.concat(F.lit("],"), F.substr(F.to_json(tail, _NULLS), F.lit(2))), False)))


def status_reports(trials: DataFrame, ledger: DataFrame, tests: DataFrame, changes: DataFrame, personas: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES, neutral: str = "p0") -> DataFrame:
    """test and document: the status of each test, and of all of them (test null), as one nested
    JSON text: the rollup's rows in natural order, what is committed of which ceiling, the paused
    tests of the study, and per test the attrition by attribute and value of the personas,
    values by the first persona that has them.

    trials also has last_category; tests: name, paused_reason; personas: id and the attributes.
    The tallies are null where a persona of the trials is not in the panel (`neutral` belongs
    to none). A document is one value, with a row per agent and test; where panels are so large
    that this is too long, `status_report_parts` gives it in parts."""
    parts = status_report_parts(trials, ledger, tests, changes, personas, attributes, neutral)
    at = lambda n: F.max(F.when(F.col("at") == n, F.col("text")))
    rows = F.transform(F.array_sort(F.collect_list(F.when(F.col("at") == 1, F.struct("key", "text")))), lambda x: x["text"])
    return parts.groupBy("test").agg(F.concat(at(0), F.array_join(rows, ","), at(2)).alias("document"))


def dry_run(trials: DataFrame, requests: DataFrame, estimates: DataFrame, decisions: DataFrame, exclusions: DataFrame, tests: DataFrame) -> DataFrame:
    """What opening each planned test would do, without doing it: counts and uniformity of the
    plan, the digest of its requests in plan order, requests that can't be rendered, expected
    and worst cost, the ceiling and what it would refuse, agents the gate leaves out, and why
    the test is paused.

    trials: a plan as `planning.plan_trials` gives it. requests: as `requests.rendered`.
    estimates: as `planning.cost_estimate`. decisions: test and the columns of
    `ledger.ceiling_decisions`. exclusions: test, agent_id, reason."""
    plan = status.plan_summary(trials)
    digests = renders.plan_digests(trials, requests, trial_ops.plan_order())
    broken = requests.filter("problem is not null").join(trials.select("trial_id", "test"), "trial_id").groupBy("test").agg(F.count("*").alias("unrendered"))
    out = exclusions.groupBy("test").agg(F.count("*").alias("excluded"))
    rows = plan.join(digests, "test", "left").join(broken, "test", "left").join(estimates.select("test", "expected", "worst_case", "providers"), "test", "left")
    rows = rows.join(decisions.select("test", "ceiling_usd", "committed_usd", F.col("refusal").alias("would_refuse")), "test", "left").join(out, "test", "left")
    rows = rows.join(tests.select(F.col("name").alias("test"), F.col("paused_reason").alias("paused")), "test", "left")
    return rows.withColumns({"unrendered": F.coalesce("unrendered", F.lit(0)), "excluded": F.coalesce("excluded", F.lit(0))})


def status_report(t: Study) -> dict[str, DataFrame]:
    """rollup (with totals and tests without trials), documents and footer."""
    rollup = status.status_rollup(t["trials"], t["ledger"], t["tests"].select("name", "paused_reason"))
    return {"rollup": rollup, "documents": status_document(rollup), "footer": cost_footer(t["ledger"], t["ceiling_changes"])}


def flat_personas(personas: DataFrame) -> DataFrame:
    """id and one column per trait, band and demographic attribute; a null one is empty."""
    cell = lambda a: F.try_element_at("big_five", F.lit(a)) if a in TRAITS else F.col(a)
    return personas.select("id", *[F.coalesce(cell(a), F.lit("")).alias(a) for a in ATTRIBUTES])


def check_dimensions(trials: DataFrame, personas: DataFrame, items: DataFrame) -> None:
    """Trials whose persona or instrument nobody knows are refused; a join would drop them."""
    for column, known in (("persona_id", personas.select(F.col("id").alias("persona_id"))), ("instrument", items.select("instrument"))):
        lost = references.unknown_references(trials.select(column), known.distinct(), column).limit(1).collect()
        if lost:
            raise EngineError("unknown_reference", f"{column} {lost[0][column]}")


def export_study(t: Study, test: str, items: DataFrame, folder: str, single_file: bool = False) -> None:
    """The tidy rows and the attrition sidecar of a test as CSV, both or none. items:
    instrument, item_id, type, options, pos."""
    kind = t["tests"].filter(F.col("name") == test).select("kind").first()
    if kind is None:
        raise EngineError("unknown_test", test)
    exports.check_exportable(t["trials"], test, kind.kind)
    trials, personas = t["trials"].filter(F.col("test") == test), flat_personas(t["personas"])
    check_dimensions(trials, personas, items)
    tidy = exports.tidy_rows(trials, t["attempts"], items, personas, t["blinding_key"], list(ATTRIBUTES), kind.kind)
    last = t["attempts"].groupBy("trial_id").agg(F.max_by("category", "attempt").alias("last_category"))
    sidecar = exports.attrition_sidecar(trials.join(last, "trial_id", "left"), personas, t["blinding_key"], list(ATTRIBUTES))
    frames = {"tidy": exports.as_text(exports.in_export_order(tidy)), "attrition": exports.as_text(sidecar.orderBy("dimension", "attribute", "first").drop("first"))}
    exports.write_together(items.sparkSession, frames, folder, single_file)


def abandon_run(t: Study, kind: str, test: str | None = None) -> tuple[Study, str]:
    """Marks the open screening of a kind (and test) as abandoned and gives its id. Its trials
    stay; it gives no results, so a fresh run may start."""
    runs = t["screening_runs"]
    mine = (F.col("status") == "open") & (F.col("kind") == kind) & F.col("screening_test").eqNullSafe(F.lit(test).cast("string"))
    run_id = runs.filter(mine).agg(F.max("run_id")).first()[0]
    if run_id is None:
        raise EngineError("screening_not_open", f"no {kind} screening is open")
    status_now = F.when(F.col("run_id") == run_id, "abandoned").otherwise(F.col("status"))
    return tables.with_table(t, "screening_runs", runs.withColumn("status", status_now)), run_id


def check_panel_free(t: Study, neutral: str = "p0") -> None:
    """Refused while trials of the panel's personas or fidelity results are stored: another
    panel would give them other labels. The neutral persona and perception don't count."""
    fidelity = t["screening_results"].join(t["screening_runs"].filter("kind = 'fidelity'"), "run_id", "left_semi")
    if not t["trials"].filter(F.col("persona_id") != neutral).isEmpty() or not fidelity.isEmpty():
        raise EngineError("panel_in_use", "trials or screening results refer to this panel")


def complete_run(t: Study, run_id: str, results: DataFrame) -> tuple[Study, list[str]]:
    """Stores the results of an open screening, marks it complete, and gives the ids of the
    runs that it supersedes with that; all or nothing."""
    runs, mine = t["screening_runs"], F.col("run_id") == run_id
    if runs.filter(mine & (F.col("status") == "open")).isEmpty():
        raise EngineError("screening_not_open", run_id)
    t = tables.with_rows(t, "screening_results", results.withColumn("run_id", F.lit(run_id)))
    done = runs.withColumn("status", F.when(mine, "complete").otherwise(F.col("status")))
    found = screening.supersession(t["screening_results"], done).filter("superseded").select("run_id", F.col("superseded_by").alias("_by"))
    after = done.join(found, "run_id", "left").withColumn("_new", F.col("superseded_by").isNull() & F.col("_by").isNotNull())
    fresh = sorted((r.run_id for r in after.filter("_new").select("run_id").collect()), key=lambda r: int(r[1:]))
    return tables.with_table(t, "screening_runs", after.withColumn("superseded_by", F.coalesce("superseded_by", "_by"))), fresh


def complete_persona_runs(t: Study, results: DataFrame) -> tuple[Study, dict[str, list[str]]]:
    """Completes the open screenings that results (as `scoring.persona_results` gives them) are
    of, in order of their numbers, and gives what each supersedes. Refused for rows that
    couldn't be scored. A study has a few open screenings at most."""
    lost = results.filter("problem is not null").first()
    if lost is not None:
        raise EngineError(lost.problem, f"{lost.agent_id} of run {lost.run_id}")
    numbered = results.withColumn("pos", F.struct(ids.persona_number("agent_id"), ids.natural_key("model_id")))
    superseded = {}
    for run_id in sorted((r.run_id for r in results.select("run_id").distinct().collect()), key=lambda r: int(r[1:])):
        rows = numbered.filter(F.col("run_id") == run_id).withColumn("pos", F.row_number().over(Window.partitionBy("run_id").orderBy("pos")))
        t, superseded[run_id] = complete_run(t, run_id, rows)
    return t, superseded


def push_clips(t: Study, clips: DataFrame, conditions: DataFrame) -> Study:
    """Stores clips with their hidden conditions (clip_id, text as `factor=level`), both or
    none. Conditions of clips that aren't among these are refused, and so is other text."""
    rows = conditions.select("clip_id", "text", ids.condition_parts("text").alias("c"))
    bad = rows.filter("c is null").select("text").first()
    if bad is not None:
        raise EngineError("bad_condition", str(bad.text))
    lost = references.unknown_references(rows, clips, "clip_id").first()
    if lost is not None:
        raise EngineError("unknown_clip", str(lost.clip_id))
    last = t["blinding_key"].agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0]
    key = rows.select("clip_id", "c.factor", "c.level").distinct()
    twice = references.duplicates(key, ["clip_id", "factor"]).first()
    if twice is not None:
        raise EngineError("repeated_condition", f"{twice.clip_id} {twice.factor}")
    return tables.with_rows(tables.with_rows(t, "clips", clips), "blinding_key", key.withColumn("pos", F.lit(last + 1)))


def register_test(t: Study, name: str, kind: str, clips: DataFrame) -> Study:
    """Stores a test with its clips (clip_id, role), both or none. Refused: a name that can't
    be one or is taken, clips that aren't stored, and targets that tests of another kind use."""
    test = clips.sparkSession.createDataFrame([(name, kind)], "name string, kind string")
    problem = test.select(ids.test_name_problem("name")).first()[0]
    if problem:
        raise EngineError("bad_test_name", f"{name}: {problem}")
    used = clips.select(F.lit(name).alias("test"), "clip_id", "role")
    lost = references.unknown_references(used, t["clips"], "clip_id").first()
    if lost is not None:
        raise EngineError("unknown_clip", str(lost.clip_id))
    shared = references.kind_overlap(t["test_clips"].select("test", "clip_id", "role").union(used), t["tests"].select("name", "kind").union(test))
    mine = shared.join(used.filter("role = 'target'").select("clip_id"), "clip_id", "left_semi").first()
    if mine is not None:
        raise EngineError("clip_kind_overlap", f"{mine.clip_id} in {mine.tests}")
    return tables.with_rows(tables.with_rows(t, "tests", test), "test_clips", used)


def set_pause(t: Study, test: str, reason: str | None) -> Study:
    """Notes why a test is paused, or with None that it goes on."""
    if t["tests"].filter(F.col("name") == test).isEmpty():
        raise EngineError("unknown_test", test)
    mine = F.col("name") == test
    return tables.with_table(t, "tests", t["tests"].withColumn("paused_reason", F.when(mine, F.lit(reason)).otherwise(F.col("paused_reason"))))


def copy_panel(source: Study, target: Study, name: str, frames: tuple[DataFrame, DataFrame] | None = None, files: DataFrame | None = None) -> Study:
    """The target study with the personas of a source and its current screening results, their
    runs numbered anew; refused if it has either already, or if the persona frames (of source
    and target, any columns) don't hold the same rows. `name` is kept as the results' source,
    with the hash of what is copied where the panel's files (name, sha256) are given."""
    if not target["trials"].isEmpty() or not target["screening_results"].isEmpty():
        raise EngineError("panel_in_use", name)
    if not target["personas"].isEmpty():
        raise EngineError("panel_exists", name)
    if frames is not None and not copies.differences(*frames).isEmpty():
        raise EngineError("frame_differs", name)
    rows = screening.renumbered(source["screening_results"], source["screening_runs"])
    numbers = rows.select("run_id", "new_run_id").distinct()
    runs = source["screening_runs"].join(numbers, "run_id").withColumn("run_id", F.col("new_run_id")).withColumn("superseded_by", F.lit(None))
    results = rows.withColumn("run_id", F.col("new_run_id")).withColumn("source_study", F.lit(name))
    if files is not None:
        own = [c for c in ("run_id", "pos", "model_id", "agent_id", "instrument", "outcome", "score", "threshold", "settings_hash", "instrument_hash", "detail", "pair_checks") if c in results.columns]
        placed = results.select(*own, F.struct(ids.run_number("run_id"), F.col("pos")).alias("_at"))
        results = results.withColumn("source_hash", F.lit(copies.source_hash(files, placed, "_at").first().source_hash))
    out = target
    for table, df in (("screening_runs", runs), ("screening_results", results), ("personas", source["personas"])):
        out = tables.with_rows(out, table, df)
    return out


def open_test(t: Study, test: str, models: DataFrame, shapes: DataFrame, variants: DataFrame, repeats: int, study_seed: int, agents: DataFrame | None = None) -> tuple[Study, DataFrame]:
    """Plans a registered test over the stored panel, for the listed agents only if given
    (those that the gate lets pass), stores the trials and gives the plan's summary. A test
    is planned once. models: model_id, pos; shapes and variants as plan_trials takes them."""
    if t["tests"].filter(F.col("name") == test).isEmpty():
        raise EngineError("unknown_test", test)
    if not t["trials"].filter(F.col("test") == test).isEmpty():
        raise EngineError("already_planned", test)
    planned = planning.sessions(test, t["personas"], models, repeats, study_seed)
    if agents is not None:
        planned = planning.kept_agents(planned, agents)
    trials = planning.plan_trials(planned, shapes, variants).withColumns({"state": F.lit("planned"), "attempt": F.lit(0)})
    if trials.isEmpty():
        raise EngineError("nothing_to_plan", test)
    t = tables.with_rows(t, "trials", trials)
    return t, status.plan_summary(t["trials"].filter(F.col("test") == test))


def resume_test(t: Study, test: str, archive: DataFrame) -> DataFrame:
    """What is to be done with the trials of a test that haven't ended, by class. Before that,
    the archived requests must prove the attempts; the first that doesn't is named."""
    trials = t["trials"].filter(F.col("test") == test)
    mine = t["attempts"].join(trials.select("trial_id", "model_id"), "trial_id").withColumn("sent", F.col("sent_at").isNotNull())
    wrong = references.reissue_mismatches(archive.join(trials.select("trial_id"), "trial_id", "left_semi"), mine).orderBy("trial_id", "attempt").first()
    if wrong is not None:
        raise EngineError("reissue_mismatch", f"{wrong.trial_id} attempt {wrong.attempt}: {wrong.reason}")
    return trial_ops.resume_classes(trials, mine.drop("model_id", "sent"))


def score_perception_run(t: Study, run_id: str, trials: DataFrame, checks: DataFrame, stamps: DataFrame, threshold: float = 0.75) -> tuple[Study, list[str]]:
    """Scores the ended trials of an open perception run and completes it. stamps: model_id,
    instrument, settings_hash, instrument_hash; a model or instrument without them is
    refused. The rows are as many as models and instruments, so one task numbers them."""
    if not trials.filter(F.col("state").isin("planned", "sent")).isEmpty():
        raise EngineError("trials_running", run_id)
    models = stamps.select("model_id").distinct().crossJoin(trials.select("repeat").distinct())
    scores = scoring.perception_scores(trials, checks, threshold, models).join(stamps, ["model_id", "instrument"], "left")
    lost = scores.filter("settings_hash is null or instrument_hash is null").first()
    if lost is not None:
        raise EngineError("no_stamp", f"{lost.model_id} {lost.instrument}")
    counts = scoring.pair_check_counts(checks).select("instrument", F.col("n_pair_checks").cast("int").alias("pair_checks"), "first")
    rows = scores.join(counts, "instrument").withColumn("pos", F.row_number().over(Window.orderBy("model_id", "first")).cast("bigint"))
    detail = F.to_json(F.struct("passed", "units"))
    results = rows.select("pos", "model_id", "instrument", "outcome", F.col("ratio").alias("score"), F.lit(threshold).alias("threshold"), "settings_hash", "instrument_hash", detail.alias("detail"), "pair_checks")
    return complete_run(t, run_id, results)
