"""Registered tests: their clips, their gate decisions and the instruments they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tests_with_clips(tests: DataFrame, test_clips: DataFrame) -> DataFrame:
    """Each test with its clips: an array of (role, clip_id), roles from Z to A, clips from A
    to Z within; empty without clips."""
    later = lambda a, b: F.when(a["role"] != b["role"], F.when(a["role"] > b["role"], -1).otherwise(1)).when(a["clip_id"] < b["clip_id"], -1).when(a["clip_id"] > b["clip_id"], 1).otherwise(0)
    clips = test_clips.groupBy(F.col("test").alias("name")).agg(F.array_sort(F.collect_set(F.struct("role", "clip_id")), later).alias("clips"))
    empty = F.array().cast("array<struct<role:string,clip_id:string>>")
    return tests.join(clips, "name", "left").withColumn("clips", F.coalesce("clips", empty))


def gate_decisions(stamps: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Per test: how many (model, instrument) pairs it is stamped for, agents it excludes, and
    excluded agents whose model and instrument it has no stamp for."""
    pairs = stamps.select("test", "model_id", "instrument").distinct()
    lost = exclusions.join(pairs, ["test", "model_id", "instrument"], "left_anti")
    count = lambda rows, name: rows.groupBy("test").agg(F.count("*").alias(name))
    out = count(pairs, "stamped").join(count(exclusions, "excluded"), "test", "full").join(count(lost, "unstamped"), "test", "left")
    return out.select("test", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("stamped", "excluded", "unstamped")])


def needed_instruments(tests: DataFrame, self_reports: DataFrame, covered: DataFrame, kinds: tuple[str, ...] = ("main", "pilot")) -> DataFrame:
    """instrument and tests: what registered tests use and no check covers, self-reports
    aside. tests: name, kind, instruments (array)."""
    used = tests.filter(F.col("kind").isin(*kinds)).select("name", F.explode("instruments").alias("instrument"))
    used = used.join(self_reports.select("instrument"), "instrument", "left_anti").join(covered.select("instrument"), "instrument", "left_anti")
    return used.groupBy("instrument").agg(F.array_sort(F.collect_set("name")).alias("tests"))


def shared_items(one: DataFrame, other: DataFrame) -> DataFrame:
    """Item ids that two instruments both use, where none may be."""
    return one.select("item_id").intersect(other.select("item_id"))


def resolved_instruments(wanted: DataFrame, user: DataFrame, builtin: DataFrame) -> DataFrame:
    """study, pos, name, source (`user` or `builtin`) and problem of the instruments that studies
    list. A study's own come before the built-in ones, but may not have their names:
    `shadows_builtin` stands against all that the study lists; then `unknown_instrument`, then
    `name_differs` (the document says another name than its file).

    wanted: study, pos, name. user: study, name, document_name; builtin: name, document_name."""
    own = user.select("study", "name", F.lit(0).alias("rank"), F.lit("user").alias("source"), "document_name")
    shared = builtin.select("name", F.lit(1).alias("rank"), F.lit("builtin").alias("source"), "document_name")
    found = wanted.join(own, ["study", "name"]).select("study", "pos", "name", "rank", "source", "document_name")
    found = found.union(wanted.join(shared, "name").select("study", "pos", "name", "rank", "source", "document_name"))
    best = found.groupBy("study", "pos", "name").agg(F.min_by(F.struct("source", "document_name"), "rank").alias("b"))
    shadowing = user.join(builtin.select("name"), "name", "left_semi").select("study").distinct().withColumn("shadows", F.lit(True))
    rows = wanted.select("study", "pos", "name").join(best, ["study", "pos", "name"], "left").join(shadowing, "study", "left")
    problem = F.when(F.col("shadows"), "shadows_builtin").when(F.col("b").isNull(), "unknown_instrument").when(F.col("b.document_name") != F.col("name"), "name_differs")
    return rows.select("study", "pos", "name", F.col("b.source").alias("source"), problem.alias("problem"))


def resolved_variants(wanted: DataFrame, variants: DataFrame) -> DataFrame:
    """The rows of wanted (instrument, prompt_variant and any others) with wording: the text of
    the variant they name; null where the instrument has none of that name. A null name means
    `default`. variants: instrument, variant, text."""
    named = wanted.withColumn("variant", F.coalesce("prompt_variant", F.lit("default")))
    return named.join(variants.select("instrument", "variant", F.col("text").alias("wording")), ["instrument", "variant"], "left")


def self_report_problems(instruments: DataFrame, items: DataFrame, taken: DataFrame, construct: str = "nars", subscales: tuple[str, ...] = ("s1", "s2", "s3")) -> DataFrame:
    """instrument and the first reason why it can't be the questionnaire for `construct`: it is no
    self-report; an item (in order) has no key or one of another construct; no key has one of
    the subscales; it uses item ids (all named) that are taken.

    instruments: instrument, self_report. items: instrument, pos, item_id, construct (null
    without a key), subscale. taken: item_id."""
    wrong = F.when(F.col("construct").isNull(), F.concat(F.lit("no_key:"), "item_id")).when(F.col("construct") != construct, F.concat(F.lit("other_construct:"), "item_id"))
    marked = items.join(taken.select("item_id", F.lit(True).alias("taken")).distinct(), "item_id", "left").withColumn("wrong", wrong)
    per = marked.groupBy("instrument").agg(
        F.min_by("wrong", F.when(F.col("wrong").isNotNull(), F.col("pos"))).alias("wrong"), F.bool_or(F.coalesce(F.col("subscale").isin(*subscales), F.lit(False))).alias("scaled"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("taken"), F.col("item_id")))), ",").alias("shared"),
    )
    rows = instruments.select("instrument", "self_report").join(per, "instrument", "left")
    problem = F.when(~F.col("self_report"), "no_self_report").when(F.col("wrong").isNotNull(), F.col("wrong")).when(~F.coalesce("scaled", F.lit(False)), "no_subscale").when(F.col("shared") != "", F.concat(F.lit("item_ids_taken:"), "shared"))
    return rows.select("instrument", problem.alias("problem"))


def stamp_map(stamps: DataFrame) -> DataFrame:
    """Per test, the stamps it was opened with as one map, `model/instrument` to `settings
    hash/instrument hash`, the last by pos where a pair was stamped again. stamps: test, pos,
    model_id, instrument, settings_hash, instrument_hash."""
    last = stamps.groupBy("test", "model_id", "instrument").agg(F.max_by(F.concat_ws("/", "settings_hash", "instrument_hash"), "pos").alias("stamp"))
    entries = F.array_sort(F.collect_list(F.struct(F.concat_ws("/", "model_id", "instrument").alias("pair"), "stamp")))
    return last.groupBy("test").agg(F.map_from_entries(entries).alias("stamps"))


def exclusions_in_order(exclusions: DataFrame) -> DataFrame:
    """Per test, the agents it left out with their reasons, in the order they were written
    (pos). exclusions: test, pos, agent_id, reason. Agents are as many as a panel has."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "agent_id", "reason")))
    return exclusions.groupBy("test").agg(F.transform(listed, lambda x: F.struct(x["agent_id"].alias("agent_id"), x["reason"].alias("reason"))).alias("excluded"))


def scoring_keys(documents: DataFrame) -> DataFrame:
    """instrument, pos, item_id, construct, reversed, subscale and points of the items that
    instrument documents (instrument, json) key; items without a key or without points have no
    row. The items and keys of a document leave its row one by one and meet by item id, so that
    none is looked up in a map of all keys; documents of one name are told apart by their texts.
    Both leave in one pass: two readings of a document may order its members differently (lists
    collected over a shuffle do), and then its items and keys would have texts that don't meet."""
    doc = documents.select("instrument", F.sha2("json", 256).alias("text"), F.try_parse_json("json").alias("v"))
    of = lambda value, name, kind: F.try_variant_get(value, f"$.{name}", kind).alias(name)
    key = lambda v: F.when(v.isNotNull(), F.struct(of(v, "construct", "string"), of(v, "reversed", "boolean"), of(v, "subscale", "string")))
    none = F.lit(None).cast("struct<construct:string,reversed:boolean,subscale:string>")
    member = lambda item_id, pos, points, keyed: F.struct(item_id.alias("item_id"), pos.alias("pos"), points.alias("points"), keyed.alias("key"))
    items = F.transform(F.try_variant_get("v", "$.items", "array<variant>"), lambda x, i: member(F.try_variant_get(x, "$.id", "string"), i, F.try_variant_get(x, "$.points", "int"), none))
    keys = F.transform(F.map_entries(F.try_variant_get("v", "$.keys", "map<string,variant>")), lambda e: member(e["key"], F.lit(None).cast("int"), F.lit(None).cast("int"), key(e["value"])))
    rows = doc.select("instrument", "text", F.inline(F.concat(items, keys))).filter("item_id is not null and (points is not null or key is not null)")
    same = ["instrument", "text", "item_id"]
    rows = rows.repartition(*same).withColumn("key", F.max("key").over(Window.partitionBy(*same))).filter("pos is not null and key is not null")
    return rows.select("instrument", "pos", "item_id", "key.construct", "key.reversed", "key.subscale", "points")
