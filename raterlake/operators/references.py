"""Reference checks: what is used must exist, once, and in one role."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from . import ledger


def unknown_references(used: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Values that are used but not known, and how often."""
    return used.join(known.select(column), column, "left_anti").groupBy(column).agg(F.count("*").alias("uses"))


def duplicates(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def first_seen(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Each value once, with the place where it comes first."""
    return rows.groupBy(*columns).agg(F.min(order).alias("first"))


def kind_overlap(test_clips: DataFrame, tests: DataFrame, kinds: tuple[str, ...] = ("pilot", "main")) -> DataFrame:
    """Target clips that tests of different kinds share, with these tests in order."""
    used = test_clips.filter("role = 'target'").join(tests.select(F.col("name").alias("test"), "kind").filter(F.col("kind").isin(*kinds)), "test")
    out = used.groupBy("clip_id").agg(F.array_join(F.array_sort(F.collect_set("test")), ",").alias("tests"), F.count_distinct("kind").alias("kinds"))
    return out.filter("kinds > 1")


def natural_ranks(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values with their rank in natural order, numbered range by range."""
    names = rows.select(column).distinct().withColumn("_key", ids.natural_key(column)).withColumn("_one", F.lit(1))
    ranked = ledger.running_sums(names, ["_key", column], "_one", "rank")
    return ranked.select(column, F.col("rank").cast("int").alias("rank"))


def reissue_mismatches(archive: DataFrame, attempts: DataFrame) -> DataFrame:
    """Attempts and archived requests that don't prove each other, with the first reason.

    archive: trial_id, attempt, request_sha256, seed, model_id, body_sha256. attempts:
    trial_id, attempt, seed, model_id, sent. One full join on the key; nothing is collected."""
    lines = archive.groupBy("trial_id", "attempt").agg(F.count("*").alias("lines"), F.max("request_sha256").alias("sha"), F.max("body_sha256").alias("body"), F.count_distinct("body_sha256").alias("bodies"), F.max("seed").alias("a_seed"), F.max("model_id").alias("a_model"))
    both = attempts.select("trial_id", "attempt", "seed", "model_id", "sent").join(lines, ["trial_id", "attempt"], "full_outer")
    reason = (
        F.when(F.col("lines").isNull() & F.col("sent"), "sent_without_request")
        .when(F.col("lines").isNull(), None)
        .when(F.col("sent").isNull(), "request_without_attempt")
        .when(F.col("bodies") > 1, "requests_differ")
        .when(F.col("sha") != F.col("body"), "hash_differs")
        .when(F.col("a_seed") != F.col("seed"), "seed_differs")
        .when(F.col("a_model") != F.col("model_id"), "model_differs")
    )
    return both.withColumn("reason", reason).filter("reason is not null").select("trial_id", "attempt", "reason")
