"""The trial state machine as queries over attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, seeds
from ..schema import TERMINAL_STATES
from . import ledger


def chosen_answer(attempts: DataFrame) -> DataFrame:
    """The highest valid attempt of each trial that has one."""
    valid = attempts.filter("valid")
    return valid.groupBy("trial_id").agg(F.max("attempt").alias("attempt"), F.max_by("seed", "attempt").alias("seed"), F.max_by("answer_json", "attempt").alias("answer_json"))


def plan_order() -> list[Column]:
    """What puts stored trials in the order of their plan: persona, model, repeat, place in the
    session, and the id where these are the same."""
    return [ids.persona_number("persona_id"), ids.natural_key("model_id"), F.col("repeat"), F.col("trial_index"), F.col("trial_id")]


def plan_places(trials: DataFrame) -> DataFrame:
    """The trials with place, from 1 in each test, in the order of the plan. Counted range by
    range over all tests, less what stands before the test, so that no test is one task's."""
    keyed = trials.withColumns({f"_o{i}": c for i, c in enumerate(plan_order())}).withColumn("_one", F.lit(1))
    order = ["test", *[c for c in keyed.columns if c.startswith("_o") and c != "_one"]]
    counted = ledger.running_sums(keyed, order, "_one", "_all").select(*trials.columns, "_all")
    first = counted.groupBy("test").agg((F.min("_all") - 1).alias("_before"))
    return counted.join(first, "test").withColumn("place", (F.col("_all") - F.col("_before")).cast("bigint")).select(*trials.columns, "place")


def budget_counts(attempts: DataFrame) -> DataFrame:
    """Both retry budgets count rows, never the attempt's number."""
    return attempts.groupBy("trial_id").agg(F.count_if(~F.col("valid")).alias("n_invalid"), F.count_if(F.col("category") == "transient").alias("n_transient"))


def last_attempt(attempts: DataFrame) -> DataFrame:
    """The last attempt of each trial with its budgets, in one aggregation."""
    last = F.max_by(F.struct("attempt", "handle", "sent_at", "answered_at", "category", "valid", "seed"), "attempt").alias("last")
    return attempts.groupBy("trial_id").agg(last, F.count_if(~F.col("valid")).alias("n_invalid"), F.count_if(F.col("category") == "transient").alias("n_transient"))


def settled_state(max_retries: int, transient_retries: int) -> Column:
    """The state that a trial with an attempt is settled to without another, or null. Over
    last_attempt's columns and state."""
    most = 1 + max_retries + transient_retries
    valid, category = F.col("last.valid"), F.col("last.category")
    waiting = (F.col("state") == "sent") & F.col("last.sent_at").isNotNull() & F.col("last.handle").isNotNull()
    return (
        F.when(F.col("last").isNull(), None)
        .when(valid, "valid")
        .when((~valid) & (F.col("n_invalid") > max_retries), "invalid")
        .when((category == "transient") & (F.col("n_transient") > transient_retries), "failed")
        .when(F.col("last.attempt") < most, None)
        .when(~valid, "invalid")
        .when(category == "transient", "failed")
        .when(waiting, None)
        .otherwise("failed")
    )


def settlement(trials: DataFrame, attempts: DataFrame, max_retries: int = 2, transient_retries: int = 3) -> DataFrame:
    """Every trial that hasn't ended: the budgets it used and the state it settles to."""
    open_ = trials.filter(~F.col("state").isin(*TERMINAL_STATES)).select("trial_id", "test", "state")
    joined = open_.join(last_attempt(attempts), "trial_id", "left")
    return joined.select("trial_id", "test", "state", F.coalesce("n_invalid", F.lit(0)).alias("n_invalid"), F.coalesce("n_transient", F.lit(0)).alias("n_transient"), settled_state(max_retries, transient_retries).alias("settles_to"))


def resume_classes(trials: DataFrame, attempts: DataFrame, max_retries: int = 2, transient_retries: int = 3) -> DataFrame:
    """test, class, n: what a resume does with each trial that hasn't ended."""
    open_ = trials.filter(~F.col("state").isin(*TERMINAL_STATES)).select("trial_id", "test", "state")
    joined = open_.join(last_attempt(attempts), "trial_id", "left").withColumn("target", settled_state(max_retries, transient_retries))
    answered = F.col("last.valid").isNotNull() | F.col("last.category").isNotNull()
    collect = (F.col("state") == "sent") & F.col("last.handle").isNotNull() & ~answered
    kind = F.when(F.col("target").isNotNull(), "settle").when(collect, "collect").otherwise("new_attempt")
    return joined.groupBy("test", kind.alias("class")).agg(F.count("*").alias("n"))


def outcome(category: Column, valid: Column) -> Column:
    """What one attempt's category and verdict mean for its trial."""
    return F.when(category == "refused", "refused").when(category == "fatal", "failed").when(category == "transient", "retry").when((category == "ok") & valid, "valid").when(category == "ok", "retry")


def attempt_seeds(attempts: DataFrame, study_seed: int, purpose: str = "model") -> DataFrame:
    """The seed that each attempt must have been sent with."""
    key = F.concat(F.col("trial_id"), F.lit("#"), F.col("attempt").cast("string"))
    return attempts.select("trial_id", "attempt", seeds.derived(study_seed, purpose, key).alias("seed"))


def exported_attempt(trials: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per trial the attempt that an export shows: the highest valid one of a valid trial,
    else the last. With its seed, time (answered, else sent) and category.

    One aggregation over attempts finds both candidates, so attempts are read once."""
    facts = F.struct("attempt", "seed", F.coalesce("answered_at", "sent_at").alias("at"), "category", "answer_json")
    found = attempts.groupBy("trial_id").agg(F.max_by(facts, "attempt").alias("last"), F.max_by(facts, F.when(F.col("valid"), F.col("attempt"))).alias("best"))
    joined = trials.join(found, "trial_id", "left")
    shown = F.when((F.col("state") == "valid") & F.col("best").isNotNull(), F.col("best")).otherwise(F.col("last"))
    joined = joined.withColumn("shown", shown)
    return joined.select(*[joined[c] for c in trials.columns], F.col("shown.attempt").alias("exported_attempt"), F.col("shown.seed").alias("seed"), F.col("shown.at").alias("shown_at"), F.col("shown.category").alias("category"), F.when(F.col("state") == "valid", F.col("shown.answer_json")).alias("answer_json"))


def orphans(trials: DataFrame, attempts: DataFrame) -> DataFrame:
    """Trials that count an attempt of which no row exists."""
    return trials.filter("attempt > 0").join(attempts.select("trial_id", "attempt"), ["trial_id", "attempt"], "left_anti").select("trial_id", "attempt")


def next_run_number(*names: DataFrame) -> DataFrame:
    """One row: one more than the highest `s<n>` among the names of tests and runs."""
    every = names[0].select(F.col(names[0].columns[0]).alias("name"))
    for n in names[1:]:
        every = every.union(n.select(F.col(n.columns[0])))
    return every.agg((F.coalesce(F.max(ids.run_number("name")), F.lit(0)) + 1).alias("next_run"))
