"""Tests and clips pushed by content: what is new, what is the same, what is refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from . import references

#: What a push comes to.
NEW, SAME, REFUSED = "new", "same", "refused"


def by_content(pushed: DataFrame, registered: DataFrame, stored: DataFrame) -> DataFrame:
    """name, pos, sha256, outcome and code of pushed tests, told apart by the hash of their
    bytes: `new`, `same` (pushed again: nothing to do) or `refused` with `test_exists`, where
    the name has other content, or where its stored file is gone or was edited.

    pushed: pos (the order of the pushes), name, sha256. registered and stored (the files):
    name, sha256. Of several pushes of one name the first stands for the name where it wasn't
    registered before; later ones are the same or refused. One full outer join of what is
    there by name, one join and one window of the pushes by name."""
    there = registered.select("name", F.col("sha256").alias("was")).join(stored.select("name", F.col("sha256").alias("file")), "name", "full_outer")
    rows = pushed.select("pos", "name", "sha256").join(there, "name", "left")
    clean = F.col("was").isNull() & (F.col("file").isNull() | (F.col("file") == F.col("sha256")))
    first = F.first(F.when(clean, F.col("sha256")), ignorenulls=True).over(Window.partitionBy("name").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("earlier", first)
    known = F.coalesce("was", "earlier")
    outcome = (
        F.when(known.isNull() & clean, NEW).when(F.col("was").isNotNull() & (F.col("was") == F.col("sha256")) & F.col("file").eqNullSafe(F.col("was")), SAME)
        .when(F.col("was").isNull() & (F.col("earlier") == F.col("sha256")), SAME).otherwise(REFUSED)
    )
    return rows.select("pos", "name", "sha256", outcome.alias("outcome"), F.when(outcome == REFUSED, "test_exists").alias("code"))


def pushed_tests(pushed: DataFrame, registered: DataFrame, stored: DataFrame, clips: DataFrame, test_clips: DataFrame) -> DataFrame:
    """The outcomes of pushes with the first reason against each: `bad_test_name`, `test_exists`,
    `unknown_clip`, `bad_practice` (an example's clip is unknown), `clip_kind_overlap` (a target
    that a registered test of the other kind has: main tests share none with the rest).

    pushed: pos, name, kind, sha256, targets and practice (arrays of clip ids). registered:
    name, kind, sha256; test_clips: test, clip_id, role; clips: clip_id. A test that is
    refused for its clips doesn't stand for its name: the next push of the name is judged."""
    known = clips.select("clip_id").distinct()

    def lost(column: str, code: str) -> DataFrame:
        used = pushed.select("pos", F.explode(column).alias("clip_id"))
        return used.join(known, "clip_id", "left_anti").select("pos").distinct().withColumn(code, F.lit(True))

    side = lambda c: F.when(F.col(c) == "main", "main").otherwise("other")
    held = test_clips.filter("role = 'target'").join(registered.select(F.col("name").alias("test"), side("kind").alias("held_as")), "test").select("clip_id", "test", "held_as").distinct()
    shared = pushed.select("pos", "name", side("kind").alias("as_"), F.explode("targets").alias("clip_id")).join(held, "clip_id").filter("held_as <> as_ and test <> name")
    rows = pushed
    for found in (lost("targets", "unknown_clip"), lost("practice", "bad_practice"), shared.select("pos").distinct().withColumn("clip_kind_overlap", F.lit(True))):
        rows = rows.join(found, "pos", "left")
    named = ids.test_name_problem("name").isNotNull()
    fault = F.when(named, "bad_test_name").when(F.col("unknown_clip"), "unknown_clip").when(F.col("bad_practice"), "bad_practice").when(F.col("clip_kind_overlap"), "clip_kind_overlap")
    rows = rows.withColumn("fault", fault)
    # what is registered already comes before faults of the content, a bad name before both
    again = by_content(rows.filter("fault is null"), registered, stored).select("pos", "outcome", "code")
    faulty = rows.filter("fault is not null").select("pos", "name", "sha256", "fault").join(registered.select("name", F.col("sha256").alias("was")), "name", "left").join(stored.select("name", F.col("sha256").alias("file")), "name", "left")
    same = F.col("was").eqNullSafe(F.col("sha256")) & F.col("file").eqNullSafe(F.col("sha256"))
    taken = F.coalesce((F.col("was").isNotNull() & ~same) | (F.col("was").isNull() & F.col("file").isNotNull() & (F.col("file") != F.col("sha256"))), F.lit(False))
    code = F.when(F.col("fault") == "bad_test_name", F.col("fault")).when(same, None).when(taken, "test_exists").otherwise(F.col("fault"))
    judged = faulty.select("pos", F.when(code.isNull(), SAME).otherwise(REFUSED).alias("outcome"), code.alias("code"))
    return pushed.select("pos", "name", "kind", "sha256").join(again.union(judged), "pos")


def registered_after(outcomes: DataFrame, registered: DataFrame) -> DataFrame:
    """name, kind, sha256 of the tests that are registered once the new ones are added."""
    new = outcomes.filter(F.col("outcome") == NEW).select("name", "kind", "sha256")
    return registered.select("name", "kind", "sha256").union(new)


def conditions_after(conditions: DataFrame, key: DataFrame) -> DataFrame:
    """The blinding key with pushed conditions (clip_id, factor, level, pos) added, in which the
    last of a clip and factor wins: what the leak report is made from after a push."""
    both = key.select("clip_id", "factor", "level", "pos", F.lit(0).alias("later")).union(conditions.select("clip_id", "factor", "level", "pos", F.lit(1)))
    return both.groupBy("clip_id", "factor").agg(F.max_by("level", F.struct("later", "pos")).alias("level"), F.max(F.struct("later", "pos")).getField("pos").alias("pos"))


def repeated_clips(clips: DataFrame) -> DataFrame:
    """Contents (sha256) that several clips hold, with how many."""
    return references.duplicates(clips, ["sha256"])
