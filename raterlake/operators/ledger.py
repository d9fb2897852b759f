"""Spend, ceilings and the replay of reservations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import total
from ..schema import MONEY
from ..sources import files

#: Rows that one task of the replay numbers at most, on average.
BLOCK = 1 << 20


def committed(ledger: DataFrame) -> DataFrame:
    """One row: what is spent or reserved over all attempts."""
    return ledger.agg(total(F.coalesce("actual_usd", "reserved_usd")).alias("committed_usd"))


def cost_by_group(ledger: DataFrame, trials: DataFrame, by: list[str]) -> DataFrame:
    spent = ledger.groupBy("trial_id").agg(total(F.coalesce("actual_usd", "reserved_usd")).alias("cost"))
    return spent.join(trials.select("trial_id", *by), "trial_id").groupBy(*by).agg(total(F.col("cost")).alias("cost_usd"))


def current_ceiling(changes: DataFrame) -> DataFrame:
    """One row: the ceiling set last, null if none ever was."""
    return changes.agg(F.max_by("ceiling_usd", "seq").alias("ceiling_usd"))


def running_sums(rows: DataFrame, order: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """Adds the running sum of `value` in the order of all rows, without bringing them to
    one task: ranges are summed on their own, then shifted by the sums of the ranges before,
    one row each. `order` must be a total order. The ranges are written to the shared folder,
    so that a lost executor can't bring others about."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = files.written(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sums = cut.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before")


def reservations(ledger: DataFrame) -> DataFrame:
    """The ledger as a stream of deltas: the reservation, then what the actual cost changes.
    ledger also has seq, the order in which attempts were reserved."""
    reserve = ledger.select("seq", F.lit(0).alias("step"), "trial_id", "attempt", F.col("reserved_usd").alias("delta"))
    settle = ledger.filter("actual_usd is not null").select("seq", F.lit(1).alias("step"), "trial_id", "attempt", (F.col("actual_usd") - F.col("reserved_usd")).cast(MONEY).alias("delta"))
    return reserve.union(settle)


def running_committed(ledger: DataFrame) -> DataFrame:
    """The deltas with committed, the running total after each."""
    deltas = reservations(ledger).withColumn("delta", F.col("delta").cast("decimal(28,12)"))
    return running_sums(deltas, ["seq", "step"], "delta", "committed")


def over_ceiling(ledger: DataFrame, ceiling: float | str) -> DataFrame:
    """The reservations after which the running total was above the ceiling."""
    return running_committed(ledger).filter((F.col("step") == 0) & (F.col("committed") > F.lit(str(ceiling)).cast(MONEY))).select("seq", "trial_id", "attempt", "committed")


def ceiling_history(changes: DataFrame) -> DataFrame:
    """Every change with the ceiling before it. Changes are made by hand, a few per study."""
    return changes.withColumn("previous_usd", F.lag("ceiling_usd").over(Window.orderBy("seq")))


def ceiling_amount(text: Column) -> Column:
    """A ceiling as it is typed: a decimal number, blanks around it, an exponent and single
    underscores allowed; null if it is none or too large to be money."""
    plain = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), "_", "")
    return F.when(plain.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"), plain.try_cast(MONEY))


def ceiling_decisions(requests: DataFrame) -> DataFrame:
    """Adds to requests to run under a ceiling: amount (of the text given), ceiling_usd (it runs
    under that: the one given, else the last one that was accepted before), refusal and, where
    a given ceiling is accepted, previous_usd (the accepted one before it).

    requests: study, seq (their order), given (text, null for none), expected_usd,
    committed_usd (spent or reserved so far), fresh (a first run, no resume) and uncapped_ok
    (nothing it uses costs anything). The first reason holds: `invalid_ceiling` (no amount
    above 0), `over_ceiling` (a given ceiling below what is committed), `ceiling_required`
    (none given or accepted, and not uncapped), `over_ceiling` (a fresh run whose expected
    cost goes beyond it). Only accepted requests change the ceiling.

    Whether a given ceiling is accepted doesn't depend on the ones before, so the fold is a
    running last value: accepted amounts are picked first, then each request looks back to
    the nearest. Requests are made by hand, so a study's fit one window."""
    amount = ceiling_amount(F.col("given"))
    rows = requests.withColumn("amount", amount)
    own = F.col("given").isNotNull()
    too_much = lambda ceiling: F.col("fresh") & (F.col("committed_usd") + F.col("expected_usd") > ceiling)
    of_own = F.when(F.col("amount").isNull() | (F.col("amount") <= 0), "invalid_ceiling").when(F.col("committed_usd") > F.col("amount"), "over_ceiling").when(too_much(F.col("amount")), "over_ceiling")
    rows = rows.withColumn("_own", F.when(own, F.coalesce(of_own, F.lit("accepted"))))
    before = Window.partitionBy("study").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_last", F.last(F.when(F.col("_own") == "accepted", F.col("amount")), ignorenulls=True).over(before))
    ceiling = F.when(own, F.when(F.col("amount") > 0, F.col("amount"))).otherwise(F.col("_last"))
    inherited = F.when(F.col("_last").isNull() & ~F.col("uncapped_ok"), "ceiling_required").when(too_much(F.col("_last")), "over_ceiling")
    refusal = F.when(own, F.nullif(F.col("_own"), F.lit("accepted"))).otherwise(inherited)
    return rows.withColumn("ceiling_usd", ceiling).withColumn("refusal", refusal).withColumn("previous_usd", F.when(F.col("_own") == "accepted", F.col("_last"))).drop("_own", "_last")
