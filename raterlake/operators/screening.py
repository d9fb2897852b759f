"""Screening results: which rows are current, which runs superseded, who is eligible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids

#: Reasons for exclusion, the strongest first.
REASONS = ("perception_fail", "screening_stale", "perception_missing", "fidelity_fail", "fidelity_missing")
FIDELITY = "fidelity"
_KEY = ["screening_test", "instrument", "model_id", "agent_id"]


def complete_results(results: DataFrame, runs: DataFrame, kind: str | None = None) -> DataFrame:
    """The rows of complete runs, with the run's test and number. Runs are few: one per
    screening; the join is left to the optimizer all the same."""
    done = runs.filter("status = 'complete'")
    if kind is not None:
        done = done.filter(F.col("kind") == kind)
    done = done.select("run_id", "screening_test", F.col("kind").alias("run_kind"), ids.run_number("run_id").alias("run_no"))
    return results.join(done, "run_id")


def current_results(results: DataFrame, runs: DataFrame, kind: str | None = None) -> DataFrame:
    """Per key, the row of the highest-numbered complete run; in it the first by pos."""
    rows = complete_results(results, runs, kind)
    rank = F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.desc("run_no"), "pos"))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def latest_counting(results: DataFrame, runs: DataFrame, settings: DataFrame, instruments: DataFrame) -> DataFrame:
    """Per key, outcome, deciding run and what changed: the latest row whose stamps are
    still current decides, even where a newer row is stale.

    settings: model_id, cur_settings; instruments: instrument, cur_instrument."""
    rows = complete_results(results, runs).join(settings, "model_id", "left").join(instruments, "instrument", "left")
    fresh = (F.col("settings_hash") == F.col("cur_settings")) & (F.col("instrument_hash") == F.col("cur_instrument"))
    rows = rows.withColumn("fresh", F.coalesce(fresh, F.lit(False)))
    counting = F.when(F.col("fresh"), F.struct("run_no", (-F.col("pos")).alias("back")))
    judged = rows.groupBy("model_id", "instrument", "agent_id").agg(
        F.max_by("outcome", counting).alias("decided"), F.max_by("run_id", counting).alias("run_id"),
        F.bool_or(~F.col("settings_hash").eqNullSafe(F.col("cur_settings"))).alias("settings_changed"), F.bool_or(~F.col("instrument_hash").eqNullSafe(F.col("cur_instrument"))).alias("instrument_changed"),
    )
    stale = F.col("decided").isNull()
    return judged.select("model_id", "instrument", "agent_id", F.coalesce("decided", F.lit("stale")).alias("outcome"), "run_id", (stale & F.col("settings_changed")).alias("settings_changed"), (stale & F.col("instrument_changed")).alias("instrument_changed"))


def supersession(results: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, superseded, superseded_by: a run is superseded when each of its keys occurs in
    a later complete run of its kind and test, and by the run that completes that.

    For each key only the next later run matters, a window over the runs that have the key;
    a run without keys is superseded by the next run of its kind and test."""
    done = runs.filter("status = 'complete'").select("run_id", F.col("kind").alias("run_kind"), "screening_test", ids.run_number("run_id").alias("run_no"))
    keys = complete_results(results, runs).select("run_kind", *_KEY, "run_no").distinct()
    later = F.lead("run_no").over(Window.partitionBy("run_kind", *_KEY).orderBy("run_no"))
    per = keys.withColumn("later", later).groupBy("run_kind", "screening_test", "run_no").agg(F.bool_and(F.col("later").isNotNull()).alias("all_later"), F.max("later").alias("last_later"))
    next_run = F.lead("run_no").over(Window.partitionBy("run_kind", "screening_test").orderBy("run_no"))
    joined = done.withColumn("next_run", next_run).alias("r").join(per.alias("p"), (F.col("r.run_kind") == F.col("p.run_kind")) & F.col("r.screening_test").eqNullSafe(F.col("p.screening_test")) & (F.col("r.run_no") == F.col("p.run_no")), "left")
    by = F.when(F.col("p.all_later").isNull(), F.col("next_run")).when(F.col("p.all_later"), F.col("p.last_later"))
    return joined.select("run_id", by.isNotNull().alias("superseded"), F.concat(F.lit("s"), by.cast("string")).alias("superseded_by"))


def coverage_gaps(results: DataFrame, runs: DataFrame, needed: DataFrame, settings: DataFrame, instruments: DataFrame) -> DataFrame:
    """Needed instruments that no current row with pair checks covers, and why: `stale` if
    stale rows with pair checks exist, else `missing`."""
    rows = complete_results(results, runs).filter("agent_id is null and pair_checks > 0").join(settings, "model_id", "left").join(instruments, "instrument", "left")
    fresh = F.coalesce((F.col("settings_hash") == F.col("cur_settings")) & (F.col("instrument_hash") == F.col("cur_instrument")), F.lit(False))
    seen = rows.groupBy("instrument").agg(F.bool_or(fresh).alias("covered"))
    return needed.select("instrument").join(seen, "instrument", "left").filter("covered is null or not covered").select("instrument", F.when(F.col("covered").isNull(), "missing").otherwise("stale").alias("reason"))


def eligibility(agents: DataFrame, needed: DataFrame, results: DataFrame, runs: DataFrame, settings: DataFrame, instruments: DataFrame) -> DataFrame:
    """One row per agent: eligible, reason and the instrument behind it.

    agents: persona_id, model_id. needed: instrument, pos (test order, without self-report).
    instruments also holds the stamp of `fidelity`. A model's perception outcome is judged
    once per model and instrument and joined to its agents."""
    judged = latest_counting(results, runs, settings, instruments)
    perception = judged.filter("agent_id is null").select("model_id", "instrument", "outcome")
    models = agents.select("model_id").distinct().crossJoin(F.broadcast(needed.select("instrument", "pos")))
    rank = F.when(F.col("found") == "fail", 0).when(F.col("found") == "stale", 1).when(F.col("found") == "missing", 2)
    found = models.join(perception, ["model_id", "instrument"], "left").withColumn("found", F.coalesce("outcome", F.lit("missing")))
    first = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), "pos", "instrument"))).alias("worst")
    model = found.groupBy("model_id").agg(first)
    code = F.element_at(F.array(*[F.lit(r) for r in REASONS[:3]]), F.col("worst.rank") + 1)
    model = model.select("model_id", F.when(F.col("worst").isNotNull(), code).alias("perceived"), F.col("worst.instrument").alias("instrument"))
    own = judged.filter((F.col("agent_id").isNotNull()) & (F.col("instrument") == FIDELITY)).select("agent_id", F.col("outcome").alias("own"))
    named = agents.withColumn("agent_id", ids.agent_id("persona_id", "model_id")).join(model, "model_id", "left").join(own, "agent_id", "left").withColumn("own", F.coalesce("own", F.lit("missing")))
    return named.select("agent_id", "persona_id", "model_id", _reason().isNull().alias("eligible"), _reason().alias("reason"), F.when(F.col("perceived") == _reason(), F.col("instrument")).alias("instrument"))


def _reason() -> Column:
    return (
        F.when(F.col("perceived") == "perception_fail", "perception_fail")
        .when((F.col("own") == "stale") | (F.col("perceived") == "screening_stale"), "screening_stale")
        .when(F.col("perceived").isNotNull(), F.col("perceived"))
        .when(F.col("own") == "fail", "fidelity_fail")
        .when(F.col("own") == "missing", "fidelity_missing")
    )


def exclusion_counts(gate: DataFrame) -> DataFrame:
    """reason, n and the reason's place in the order of precedence."""
    place = F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("reason")).cast("int")
    return gate.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).withColumn("place", place)


def stamp_drift(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Model and instrument pairs whose recorded and current stamps differ, or are missing on
    one side. Both: model_id, instrument, settings_hash, instrument_hash."""
    r = recorded.select("model_id", "instrument", F.struct("settings_hash", "instrument_hash").alias("was"))
    c = current.select("model_id", "instrument", F.struct("settings_hash", "instrument_hash").alias("now"))
    both = r.join(c, ["model_id", "instrument"], "full_outer").filter(~F.col("was").eqNullSafe(F.col("now")))
    return both.select("model_id", "instrument", F.when(F.col("was").isNull(), "not_recorded").when(F.col("now").isNull(), "gone").otherwise("changed").alias("drift"))


def renumbered(results: DataFrame, runs: DataFrame) -> DataFrame:
    """The current rows of an imported panel, their runs renumbered s1, s2, ... in order."""
    rows = current_results(results, runs)
    numbers = rows.select("run_id", "run_no").distinct().withColumn("new_no", F.row_number().over(Window.orderBy("run_no")))
    return rows.join(F.broadcast(numbers.select("run_id", "new_no")), "run_id").withColumn("new_run_id", F.concat(F.lit("s"), F.col("new_no").cast("string"))).drop("new_no")


def screen_summary(results: DataFrame) -> DataFrame:
    """Per model: passed, failed, and rows whose detail says the data were insufficient."""
    short = F.get_json_object("detail", "$.insufficient_data") == "true"
    return results.groupBy("model_id").agg(F.count_if(F.col("outcome") == "pass").alias("passed"), F.count_if(F.col("outcome") == "fail").alias("failed"), F.count_if(short).alias("insufficient"))
