"""Trial counts, invalid rates, cost and their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, numbers
from ..schema import ATTRITION_COUNTS, RUNNING_STATES, TRIAL_STATES

ALL = "*"


def _in_state(state: str) -> Column:
    return F.count_if(F.col("state") == state).alias(state)


def _states() -> list[Column]:
    return [_in_state(s) for s in TRIAL_STATES]


def spend_by_trial(ledger: DataFrame) -> DataFrame:
    """trial_id, cost: every attempt counts, with its reservation where the cost isn't known."""
    return ledger.groupBy("trial_id").agg(numbers.total(F.coalesce("actual_usd", "reserved_usd")).alias("cost"))


def status_counts(trials: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row per test, model and agent: counts by state, trials, retried, cost_usd.

    The ledger is summed per trial first, so one shuffle on trial_id brings it to the
    trials and one more groups both."""
    both = trials.select("trial_id", "test", "model_id", "agent_id", "state", "attempt").join(spend_by_trial(ledger), "trial_id", "left")
    return both.groupBy("test", F.col("model_id").alias("model"), F.col("agent_id").alias("agent")).agg(
        *_states(), F.count("*").alias("trials"), F.sum(F.greatest(F.col("attempt") - 1, F.lit(0))).cast("bigint").alias("retried"), numbers.total(F.col("cost")).alias("cost_usd")
    )


def status_rollup(trials: DataFrame, ledger: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """The counts with totals per model and per test (`*`), the invalid rate, and a zero row
    for each test in `tests` (name, paused_reason) that has no trial."""
    counts = status_counts(trials, ledger)
    sums = [F.sum(c).alias(c) for c in (*TRIAL_STATES, "trials", "retried")]
    name = lambda c: F.when(F.grouping(c) == 1, ALL).otherwise(F.col(c)).alias(f"{c}_")
    sets = [["test", "model", "agent"], ["test", "model"], ["test"]]
    rolled = counts.groupingSets([[F.col(c) for c in s] for s in sets], "test", "model", "agent").agg(name("model"), name("agent"), *sums, numbers.total(F.col("cost_usd")).alias("cost_usd"))
    rolled = rolled.drop("model", "agent").withColumnsRenamed({"model_": "model", "agent_": "agent"})
    if tests is not None:
        none = tests.select(F.col("name").alias("test")).join(counts.select("test").distinct(), "test", "left_anti")
        zero = none.select("test", F.lit(ALL).alias("model"), F.lit(ALL).alias("agent"), *[F.lit(0).cast("bigint").alias(c) for c in (*TRIAL_STATES, "trials", "retried")], F.lit(0).cast("decimal(38,12)").alias("cost_usd"))
        rolled = rolled.unionByName(zero)
        paused = tests.select(F.col("name").alias("test"), F.when(F.col("paused_reason").isNotNull(), F.col("paused_reason")).alias("paused"))
        rolled = rolled.join(paused, "test", "left").withColumn("paused", F.when(F.col("model") == ALL, F.col("paused")))
    return rolled.withColumn("invalid_rate", numbers.invalid_rate(F.col("valid"), F.col("invalid")))


def in_report_order(rollup: DataFrame) -> DataFrame:
    """Totals first, digits as numbers."""
    return rolled_sort(rollup, "test", "model", "agent")


def rolled_sort(df: DataFrame, *cols: str) -> DataFrame:
    return df.orderBy(*[ids.natural_key(c) for c in cols])


def state_counts(trials: DataFrame) -> DataFrame:
    """test, state, n and the state's place in the life cycle; absent states are left out."""
    place = F.array_position(F.array(*[F.lit(s) for s in TRIAL_STATES]), F.col("state")).cast("int")
    return trials.groupBy("test", "state").agg(F.count("*").alias("n")).withColumn("place", place)


def invalid_rates(trials: DataFrame, by: str) -> DataFrame:
    """Counts of ended states and the invalid rate, per test and `by`."""
    grouped = trials.groupBy("test", F.col(by).alias("key")).agg(*[_in_state(s) for s in ("valid", "invalid", "refused", "failed")])
    return grouped.withColumn("rate", numbers.invalid_rate(F.col("valid"), F.col("invalid")))


def plan_summary(trials: DataFrame) -> DataFrame:
    """Per test: trials, sessions, agents, models and instruments, and whether all sessions
    have the same number of trials of each instrument."""
    shape = trials.groupBy("test", "session_id", "instrument").agg(F.count("*").alias("n")).groupBy("test", "session_id").agg(F.array_sort(F.collect_list(F.struct("instrument", "n"))).alias("shape"))
    same = shape.groupBy("test").agg((F.count_distinct("shape") == 1).alias("uniform"))
    counts = trials.groupBy("test").agg(F.count("*").alias("trials"), *[F.count_distinct(c).alias(a) for c, a in (("session_id", "sessions"), ("agent_id", "agents"), ("model_id", "models"), ("instrument", "instruments"))])
    return counts.join(same, "test")


def running(trials: DataFrame) -> DataFrame:
    """Tests whose trials have not all ended, and how many have not."""
    return trials.groupBy("test").agg(F.count_if(F.col("state").isin(*RUNNING_STATES)).alias("running")).filter("running > 0")


def trial_counters(trials: DataFrame) -> DataFrame:
    """The attrition counters of each trial as 0/1 columns. trials has state and
    last_category, the category of the last attempt."""
    failed = F.col("state") == "failed"
    kind = F.when(F.col("last_category") == "transient", "failed_transient").when(F.col("last_category") == "attempts_exhausted", "failed_exhausted").otherwise("failed_fatal")
    flags = {"trials": F.lit(True), "invalid": F.col("state") == "invalid", "refused": F.col("state") == "refused", "failed": failed}
    flags |= {k: failed & (kind == k) for k in ATTRITION_COUNTS[4:]}
    return trials.withColumns({f"is_{k}": flags[k].cast("int") for k in ATTRITION_COUNTS})


def counted() -> list[Column]:
    return [F.sum(f"is_{k}").cast("bigint").alias(k) for k in ATTRITION_COUNTS]


def attrition_by_persona(trials: DataFrame) -> DataFrame:
    return trial_counters(trials).groupBy("test", "persona_id").agg(*counted())


def attrition_by_attribute(trials: DataFrame, personas: DataFrame, attributes: list[str]) -> DataFrame:
    """Counters per test, persona attribute and value, and first, the number of the first
    persona that has the value. personas: id and the attributes. The attributes of a
    persona are unpivoted after its trials are summed, so rows grow with personas only."""
    per = attrition_by_persona(trials).join(personas.select(F.col("id").alias("persona_id"), *attributes), "persona_id")
    long = per.withColumn("number", ids.persona_number("persona_id")).unpivot(["test", "number", *ATTRITION_COUNTS], attributes, "attribute", "value")
    long = long.withColumn("value", F.coalesce("value", F.lit("")))
    return long.groupBy("test", "attribute", "value").agg(*[F.sum(c).alias(c) for c in ATTRITION_COUNTS], F.min("number").alias("first"))
