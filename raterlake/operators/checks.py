"""Whether tests, their perception checks and their instruments can be used as configured.

Every rule gives rows by joins and grouping; the first rule that a test breaks is the least
of its rows. Nothing about a test is gathered on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _found(rows: DataFrame, rule: int, pos: Column, code: str, detail: Column) -> DataFrame:
    return rows.select("test", F.struct(F.lit(rule).alias("rule"), pos.cast("bigint").alias("pos"), F.lit(code).alias("code"), detail.alias("detail")).alias("p"))


def plan_problems(tests: DataFrame, listed: DataFrame, instruments: DataFrame, targets: DataFrame, practice: DataFrame, needed: int) -> DataFrame:
    """Every test with the first problem of its plan: code and detail, both null without one.

    tests: test. listed: test, instrument, pos. instruments: instrument, pairwise. targets:
    test, clip_id. practice: test, pos, instrument, clips. In order: an instrument that isn't
    known; no target; a pairwise instrument with fewer than two targets; an example with a
    clip twice or with a target; an instrument with fewer than `needed` examples."""
    known = listed.join(instruments.select("instrument", "pairwise"), "instrument", "left")
    counted = tests.select("test").join(targets.groupBy("test").agg(F.count("*").alias("n")), "test", "left").select("test", F.coalesce("n", F.lit(0)).alias("n"))
    given = practice.groupBy("test", "instrument").agg(F.count("*").alias("has"))
    has = known.join(given, ["test", "instrument"], "left").withColumn("has", F.coalesce("has", F.lit(0)))
    shown = practice.select("test", "pos", F.posexplode("clips").alias("at", "clip_id")).join(targets.select("test", "clip_id").distinct(), ["test", "clip_id"])
    shown = shown.groupBy("test", "pos").agg(F.min_by("clip_id", "at").alias("clip_id"))
    example = lambda text: F.concat(F.lit("practice["), F.col("pos").cast("string"), F.lit(f"] {text}"))
    twice = F.size(F.array_distinct("clips")) < F.size("clips")
    rows = [
        _found(known.filter("pairwise is null"), 0, F.col("pos"), "unknown_instrument", F.col("instrument")),
        _found(counted.filter("n = 0"), 1, F.lit(0), "bad_pairing", F.lit("no target clip")),
        _found(known.filter("pairwise").join(counted.filter("n < 2"), "test"), 2, F.col("pos"), "bad_pairing", F.concat("instrument", F.lit(" needs two target clips"))),
        _found(practice.filter(twice), 3, F.col("pos") * 2, "bad_practice", example("lists a clip twice")),
        _found(shown, 3, F.col("pos") * 2 + 1, "bad_practice", F.concat(example("has the target "), F.col("clip_id"))),
        _found(has.filter(F.col("has") < needed), 4, F.col("pos"), "bad_practice", F.concat("instrument", F.lit(" has "), F.col("has").cast("string"), F.lit(f" of {needed} examples"))),
    ]
    first = reduce(DataFrame.unionByName, rows).groupBy("test").agg(F.min("p").alias("p"))
    return tests.select("test").join(first, "test", "left").select("test", "p.code", "p.detail")


def check_problems(checks: DataFrame, items: DataFrame, targets: DataFrame) -> DataFrame:
    """test, pos and problem of every perception check, null for a good one, and first: the
    check that a repeated one repeats.

    checks: test, pos, instrument, item_id, clips, expected, kind (`int` or `string`). items:
    instrument, item_id, type, points, options, pos. targets: test, clip_id. An instrument is
    pairwise if its first item is. A check that agrees with an earlier one of the same
    instrument, item and clips duplicates it, else contradicts it."""
    forms = items.groupBy("instrument").agg((F.min_by("type", "pos") == "pairwise").alias("pairwise"))
    rows = checks.join(forms, "instrument", "left").join(items.select("instrument", "item_id", "type", "points", "options"), ["instrument", "item_id"], "left")
    strange = checks.select("test", "pos", F.explode("clips").alias("clip_id")).join(targets, ["test", "clip_id"], "left_anti").select("test", "pos", F.lit(True).alias("strange")).distinct()
    same = ["test", "instrument", "item_id", "shown"]
    rows = rows.join(strange, ["test", "pos"], "left").withColumn("shown", F.array_sort(F.array_distinct("clips")))
    keyed = checks.withColumn("shown", F.array_sort(F.array_distinct("clips")))
    rows = rows.join(keyed.groupBy(*same).agg(F.min(F.struct("pos", "expected", "kind")).alias("f")), same, "left")

    kind, pairwise, points = F.col("type"), F.col("pairwise"), F.coalesce("points", F.lit(0))
    number = F.when(F.col("kind") == "int", F.col("expected").try_cast("bigint"))
    fits = F.when(kind == "likert", number.between(1, points)).otherwise((F.col("kind") == "string") & F.array_contains("options", F.col("expected")))
    two = (
        F.when(~F.coalesce(F.array_contains("clips", F.col("expected")), F.lit(False)), "expected_not_shown")
        .when(~pairwise & (kind != "likert"), "needs_likert").when(~pairwise & (points < 3), "too_few_points")
    )
    one = F.when(kind == "free_text", "free_text").when(~F.coalesce(fits, F.lit(False)), "bad_expected")
    problem = (
        F.when(pairwise.isNull(), "unknown_instrument").when(kind.isNull(), "unknown_item").when(pairwise & (kind != "pairwise"), "item_not_pairwise")
        .when(F.col("strange"), "unknown_clip").when(pairwise & (F.size("clips") != 2), "needs_two_clips").when(F.size("clips") == 2, two).otherwise(one)
    )
    later = F.when(F.col("f.pos") < F.col("pos"), F.col("f.pos"))
    agrees = F.col("f.expected").eqNullSafe(F.col("expected")) & F.col("f.kind").eqNullSafe(F.col("kind"))
    again = F.when(later.isNotNull(), F.when(agrees, "duplicates").otherwise("contradicts"))
    return rows.select("test", "pos", F.coalesce(problem, again).alias("problem"), F.when(problem.isNull(), later).alias("first"))


def _text(x: Column) -> Column:
    """One JSON string."""
    return F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")


def answer_schemas(items: DataFrame) -> DataFrame:
    """Per instrument, the JSON schema of a valid answer, as canonical text. items: instrument,
    item_id, type, points, options, pos."""
    likert = F.concat(F.lit('{"maximum":'), F.col("points").cast("string"), F.lit(',"minimum":1,"type":"integer"}'))
    choice = F.concat(F.lit('{"enum":'), F.to_json(F.coalesce("options", F.array().cast("array<string>"))), F.lit(',"type":"string"}'))
    one = F.when(F.col("type") == "likert", likert).when(F.col("type") == "pairwise", choice).otherwise(F.lit('{"minLength":1,"type":"string"}'))
    named = items.select("instrument", "pos", "item_id", F.concat(_text(F.col("item_id")), F.lit(":"), one).alias("property"))
    both = named.groupBy("instrument").agg(F.array_sort(F.collect_list(F.struct("item_id", "property"))).alias("p"), F.array_sort(F.collect_list(F.struct("pos", "item_id"))).alias("r"))
    properties = F.array_join(F.transform("p", lambda x: x["property"]), ",")
    required = F.to_json(F.transform("r", lambda x: x["item_id"]))
    return both.select("instrument", F.concat(F.lit('{"additionalProperties":false,"properties":{'), properties, F.lit('},"required":'), required, F.lit(',"type":"object"}')).alias("schema"))


def stale_summary(stale: DataFrame, place: Column) -> DataFrame:
    """What must be screened again: a row per model whose settings changed and per instrument
    whose definition did, with the number of stale keys and the first place.

    stale: model_id, instrument, settings_changed, instrument_changed."""
    one = lambda what, name, when: F.when(F.col(when), F.struct(F.lit(what).alias("what"), F.col(name).alias("name")))
    both = F.array_compact(F.array(one("model", "model_id", "settings_changed"), one("instrument", "instrument", "instrument_changed")))
    return stale.select(place.alias("place"), F.explode(both).alias("s")).groupBy("s.what", "s.name").agg(F.count("*").alias("n"), F.min("place").alias("first"))
