"""Attempts, trial states and the ledger as append-only events.

A write appends an event and changes no row; what holds now is a fold over the events of a
key, in one shuffle with partial aggregation. `seq` orders the events of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TERMINAL_STATES


def _latest(column: str):
    """The last value that an event set; an event that leaves it null keeps it."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("seq"))).alias(column)


def attempts_now(events: DataFrame, columns: list[str]) -> DataFrame:
    """Per trial and attempt, the last value that was set of each of the columns."""
    return events.groupBy("trial_id", "attempt").agg(*[_latest(c) for c in columns])


def states_now(events: DataFrame) -> DataFrame:
    """Per trial, its state: the first terminal one, which never changes, else the last."""
    ends = F.when(F.col("state").isin(*TERMINAL_STATES), F.col("seq"))
    return events.groupBy("trial_id").agg(F.coalesce(F.min_by("state", ends), F.max_by("state", "seq")).alias("state"))


def ledger_now(events: DataFrame) -> DataFrame:
    """Per trial and attempt: reserved_usd, as first reserved, and the actual_usd set last;
    without any, the reservation stands."""
    reserved = F.min_by("reserved_usd", F.when(F.col("reserved_usd").isNotNull(), F.col("seq"))).alias("reserved_usd")
    return events.groupBy("trial_id", "attempt").agg(reserved, _latest("actual_usd"))
