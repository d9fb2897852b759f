"""Fidelity and perception scoring, and the checks on answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsons import parsed
from ..functions.numbers import pass_ratio
from ..schema import TERMINAL_STATES


def fidelity_constructs(answers: DataFrame, keys: DataFrame, poles: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """One row per agent and construct: score, midpoint, n, short and matches.

    answers: agent_id, item_id, value (int, null if it was none). keys: item_id, construct,
    reversed, points. poles: agent_id, construct, pole. planned: construct, planned.
    A score at the midpoint matches neither pole."""
    scored = answers.join(F.broadcast(keys), "item_id").filter("value between 1 and points")
    value = F.when(F.col("reversed"), F.col("points") + 1 - F.col("value")).otherwise(F.col("value"))
    means = scored.groupBy("agent_id", "construct").agg(F.avg(value).alias("score"), F.avg((F.col("points") + 1) / 2).alias("midpoint"), F.count("*").alias("n"))
    rows = poles.join(means, ["agent_id", "construct"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if planned is None:
        rows = rows.withColumn("short", F.lit(False))
    else:
        rows = rows.join(F.broadcast(planned), "construct", "left").withColumn("short", 2 * F.col("n") < F.coalesce("planned", F.lit(0))).drop("planned")
    fits = F.when(F.col("pole") == "high", F.col("score") > F.col("midpoint")).when(F.col("pole") == "low", F.col("score") < F.col("midpoint"))
    return rows.withColumn("matches", ~F.col("short") & F.coalesce(fits, F.lit(False)))


def fidelity_scores(answers: DataFrame, keys: DataFrame, poles: DataFrame, planned: DataFrame | None = None, threshold: float = 0.8) -> DataFrame:
    """One row per agent: matched, total, ratio, insufficient and outcome."""
    per = fidelity_constructs(answers, keys, poles, planned)
    out = per.groupBy("agent_id").agg(F.count_if("matches").alias("matched"), F.count("*").alias("total"), F.count_if("short").alias("insufficient"))
    ratio = pass_ratio(F.col("matched"), F.col("total"))
    return out.withColumn("ratio", ratio).withColumn("outcome", F.when(ratio >= threshold, "pass").otherwise("fail"))


def ended_runs(trials: DataFrame) -> DataFrame:
    """run_id of the screenings whose trials, one at least, have all ended."""
    return trials.groupBy("run_id").agg(F.bool_and(F.col("state").isin(*TERMINAL_STATES)).alias("ended")).filter("ended").select("run_id")


def persona_results(trials: DataFrame, answers: DataFrame, keys: DataFrame, poles: DataFrame, settings: DataFrame, runs: DataFrame, threshold: float = 0.8, draft: bool = False) -> DataFrame:
    """The results of persona screenings: one row per run and agent, of runs whose trials have
    all ended; nothing of the others.

    What is expected of an agent follows from the run's own plan: each of its trials is to
    answer the keyed items of its instrument. A construct with fewer than half of that is
    short, matches nothing and makes the data insufficient. Stamps are those that were taken
    when the run was made.

    trials: run_id, trial_id, agent_id, persona_id, model_id, instrument, state. answers:
    trial_id, item_id, value (int; null if it was none), the chosen answers of valid trials.
    keys: instrument, item_id, construct, reversed, subscale, points. poles: persona_id,
    construct, pole. settings: run_id, model_id, settings_hash. runs: run_id,
    instrument_hash. Gives model_id, agent_id, instrument, outcome, score, threshold, hashes,
    detail (canonical JSON), matched, total, insufficient and problem: `no_settings_stamp` or
    `panel_mismatch` where a row can't be scored, which a caller refuses."""
    mine = trials.join(ended_runs(trials), "run_id", "left_semi")
    agents = mine.select("run_id", "agent_id", "persona_id", "model_id").distinct()
    keyed = keys.select("instrument", "item_id", "construct", "reversed", "subscale", "points")
    expected = mine.join(F.broadcast(keyed.groupBy("instrument", "construct").agg(F.count("*").alias("per_trial"))), "instrument").groupBy("run_id", "agent_id", "construct").agg(F.sum("per_trial").alias("expected"))
    given = answers.join(mine.filter("state = 'valid'").select("trial_id", "run_id", "agent_id"), "trial_id")
    scored = given.join(F.broadcast(keyed.drop("instrument")), "item_id").filter("value between 1 and points")
    scored = scored.withColumn("value", F.when(F.col("reversed"), F.col("points") + 1 - F.col("value")).otherwise(F.col("value")))
    means = scored.groupBy("run_id", "agent_id", "construct").agg(F.avg("value").alias("score"), F.avg((F.col("points") + 1) / 2).alias("midpoint"), F.count("*").alias("n"))
    scales = scored.filter("subscale is not null").groupBy("run_id", "agent_id", "construct", "subscale").agg(F.avg("value").alias("mean")).groupBy("run_id", "agent_id", "construct").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("subscale", "mean")))).alias("subscales"))
    key = ["run_id", "agent_id", "construct"]
    rows = agents.join(poles, "persona_id").join(expected, key, "left").join(means, key, "left").join(scales, key, "left")
    rows = rows.withColumns({"expected": F.coalesce("expected", F.lit(0)), "n": F.coalesce("n", F.lit(0))}).withColumn("short", 2 * F.col("n") < F.col("expected"))
    fits = F.when(F.col("pole") == "high", F.col("score") > F.col("midpoint")).when(F.col("pole") == "low", F.col("score") < F.col("midpoint"))
    rows = rows.withColumn("match", ~F.col("short") & F.coalesce(fits, F.lit(False)))
    check = F.struct("expected", F.col("short").alias("insufficient_data"), "match", "midpoint", "n", "pole", "score", F.when(F.col("construct") == "nars", F.coalesce("subscales", F.create_map().cast("map<string,double>"))).alias("subscales"))
    text = F.to_json(check, {"ignoreNullFields": "false"})
    # subscales are written for the one construct that has them
    text = F.when(F.col("construct") == "nars", text).otherwise(F.regexp_replace(text, r',"subscales":null\}$', "}"))
    checks = F.array_sort(F.collect_list(F.struct("construct", F.concat(F.lit('"'), "construct", F.lit('":'), text).alias("t"))))
    per = rows.groupBy("run_id", "agent_id").agg(F.count_if("match").alias("matched"), F.count("*").alias("total"), F.count_if("short").alias("insufficient"), F.array_join(F.transform(checks, lambda c: c["t"]), ",").alias("checks"))
    out = agents.join(per, ["run_id", "agent_id"], "left").join(settings.select("run_id", "model_id", "settings_hash"), ["run_id", "model_id"], "left").join(runs.select("run_id", "instrument_hash"), "run_id", "left")
    problem = F.when(F.col("settings_hash").isNull(), "no_settings_stamp").when(F.col("total").isNull(), "panel_mismatch")
    ratio = pass_ratio(F.col("matched"), F.col("total"))
    detail = F.concat(F.lit('{"checks":{'), "checks", F.lit(f'}},"draft":{str(draft).lower()},"insufficient_data":'), F.when(F.col("insufficient") > 0, "true").otherwise("false"), F.lit(',"matched":'), F.col("matched").cast("string"), F.lit(',"total":'), F.col("total").cast("string"), F.lit("}"))
    fine = lambda c: F.when(problem.isNull(), c)
    return out.select(
        "run_id", "model_id", "agent_id", F.lit("fidelity").alias("instrument"), fine(F.when(ratio >= threshold, "pass").otherwise("fail")).alias("outcome"), fine(ratio).alias("score"), F.lit(threshold).alias("threshold"),
        "settings_hash", "instrument_hash", fine(detail).alias("detail"), "matched", "total", "insufficient", problem.alias("problem"),
    )


def is_pair_check(checks: DataFrame) -> Column:
    return checks["pairwise"] | (F.size(checks["clips"]) == 2)


def pair_check_counts(checks: DataFrame) -> DataFrame:
    """instrument, n_pair_checks (0 for low-level checks only) and the place of its first check."""
    return checks.groupBy("instrument").agg(F.count_if(is_pair_check(checks)).alias("n_pair_checks"), F.min("pos").alias("first"))


def perception_units(trials: DataFrame, checks: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """One row per model, repeat, check and unit, with ok.

    trials: model_id, repeat, instrument, clip_ids, item_id, answer, kind (`int` or
    `string`), state; the answer of a pairwise trial is the chosen clip. checks: pos,
    instrument, item_id, pairwise, clips, expected. A pairwise check asks both orders of its
    clips; one with two clips asks that the expected clip is rated strictly higher; one
    with a single clip asks for the expected answer. A missing or invalid trial fails, and
    so does every unit of a model of `models` (model_id, repeat) without any trial."""
    runs = trials.select("model_id", "repeat")
    runs = (runs if models is None else runs.union(models.select("model_id", "repeat"))).distinct()
    lo, hi = F.array_min("clips"), F.array_max("clips")
    expected_first = F.when(F.get("clips", F.lit(0)) == F.col("expected"), F.col("clips")).otherwise(F.reverse("clips"))
    plain = F.when(F.size("clips") == 2, F.transform(expected_first, lambda c: F.array(c))).otherwise(F.array(F.array(F.get("clips", F.lit(0)))))
    asked = F.when(F.col("pairwise"), F.array(F.array(lo, hi), F.array(hi, lo))).otherwise(plain)
    wanted = runs.crossJoin(F.broadcast(checks)).select("*", F.posexplode(asked).alias("side", "clip_ids"))
    given = trials.filter("state = 'valid'").select("model_id", "repeat", "instrument", "item_id", "clip_ids", "answer", "kind")
    both = wanted.join(given, ["model_id", "repeat", "instrument", "item_id", "clip_ids"], "left")
    two = ~F.col("pairwise") & (F.size("clips") == 2)
    number = F.when(F.col("kind") == "int", F.col("answer").cast("bigint"))
    pairs = both.filter(two).groupBy("model_id", "repeat", "instrument", "pos").agg((F.max(F.when(F.col("side") == 0, number)) > F.max(F.when(F.col("side") == 1, number))).alias("ok")).withColumn("side", F.lit(0))
    rest = both.filter(~two).select("model_id", "repeat", "instrument", "pos", (F.col("answer") == F.col("expected")).alias("ok"), "side")
    return pairs.unionByName(rest).withColumn("ok", F.coalesce("ok", F.lit(False)))


def perception_scores(trials: DataFrame, checks: DataFrame, threshold: float = 0.75, models: DataFrame | None = None) -> DataFrame:
    """One row per model and instrument with a check: passed, units, ratio, outcome. Without
    a unit a model fails."""
    units = perception_units(trials, checks, models).groupBy("model_id", "instrument").agg(F.count_if("ok").alias("passed"), F.count("*").alias("units"))
    ratio = pass_ratio(F.col("passed"), F.col("units"))
    return units.withColumn("ratio", ratio).withColumn("outcome", F.when((F.col("units") > 0) & (ratio >= threshold), "pass").otherwise("fail"))


def perception_shapes(checks: DataFrame) -> DataFrame:
    """instrument, clip_ids, pair_id, position of the trials that the checks need, each once,
    and place, where a check first needs it."""
    lo, hi = F.array_min("clips"), F.array_max("clips")
    pid = F.concat_ws(":", "instrument", lo, hi)
    one = lambda clips, pair, position: F.struct(clips.alias("clip_ids"), pair.cast("string").alias("pair_id"), position.cast("int").alias("position"))
    pair = F.array(one(F.array(lo, hi), pid, F.lit(1)), one(F.array(hi, lo), pid, F.lit(2)))
    single = F.transform("clips", lambda c: one(F.array(c), F.lit(None), F.lit(None)))
    rows = checks.select("instrument", "pos", F.posexplode(F.when(F.col("pairwise"), pair).otherwise(single)).alias("side", "s"))
    return rows.groupBy("instrument", "s.clip_ids", "s.pair_id", "s.position").agg(F.min(F.struct("pos", "side")).alias("place"))


def validated(raw: DataFrame, items: DataFrame) -> DataFrame:
    """Adds problem, the first of the ordered reasons (null for a valid answer), and answers.

    raw: instrument, raw and any others. items: instrument, item_id, type, points, options,
    pos. Structure is judged first, then each item in order; nothing is coerced."""
    listed = items.groupBy("instrument").agg(F.array_sort(F.collect_list(F.struct("pos", "item_id", "type", "points", "options"))).alias("items"))
    rows = raw.withColumn("_p", parsed("raw")).join(F.broadcast(listed), "instrument")
    entries = F.map_from_arrays(F.transform("_p.entries", lambda e: e["key"]), F.col("_p.entries"))
    rows = rows.withColumn("_e", F.when(F.col("_p.problem").isNull(), entries))
    known = F.transform("items", lambda i: i["item_id"])
    unknown = F.exists(F.map_keys("_e"), lambda k: ~F.array_contains(known, k))
    missing = F.exists(known, lambda k: ~F.map_contains_key("_e", k))

    def check(i: Column) -> Column:
        e = F.try_element_at("_e", i["item_id"])
        reason = lambda name: F.concat(F.lit(f"{name}:"), i["item_id"])
        number = e["value"].try_cast("decimal(38,0)")
        options = F.coalesce(i["options"], F.array(F.lit("A"), F.lit("B")))
        likert = F.when(e["kind"] != "int", reason("wrong_type")).when(number.isNull() | (number < 1) | (number > i["points"]), reason("out_of_range"))
        choice = F.when(e["kind"] != "string", reason("wrong_type")).when(~F.array_contains(options, e["value"]), reason("bad_choice"))
        text = F.when(e["kind"] != "string", reason("wrong_type")).when(~e["value"].rlike(r"(?U)\S"), reason("empty_text"))
        return F.when(i["type"] == "likert", likert).when(i["type"] == "pairwise", choice).otherwise(text)

    wrong = F.get(F.filter(F.transform("items", check), lambda x: x.isNotNull()), F.lit(0))
    problem = F.coalesce(F.col("_p.problem"), F.when(unknown, "unknown_item").when(missing, "missing_item").otherwise(wrong))
    answers = F.when(problem.isNull(), F.transform_values("_e", lambda k, v: v["value"]))
    return rows.withColumn("problem", problem).withColumn("answers", answers).drop("_p", "_e", "items")
