"""The blinded export: hidden conditions are joined at the last step only."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import ids, texts
from ..schema import ATTRITION_COUNTS
from . import status, trials as trial_ops

HEAD = ["schema_version", "agent_id", "session_id", "trial_index", "clip_id", "pair_id", "clip_id_a", "clip_id_b"]
TAIL = ["instrument", "item", "response", "position", "repeat", "seed", "prompt_variant", "status", "excluded", "exclusion_reason", "test_kind", "protocol_lock", "timestamp"]
EXPORT_VERSION = 1


def blinding_wide(key: DataFrame, factors: list[str]) -> DataFrame:
    """clip_id and a column per factor; the last row of a clip and factor counts."""
    last = key.groupBy("clip_id", "factor").agg(F.max_by("level", "pos").alias("level"))
    return last.groupBy("clip_id").pivot("factor", factors).agg(F.first("level"))


def factors_of(key: DataFrame) -> list[str]:
    """The factors by name. There are as many as columns in the export."""
    return [r.factor for r in key.select("factor").distinct().orderBy("factor").collect()]


def condition_cells(trials: DataFrame, key: DataFrame, factors: list[str]) -> DataFrame:
    """trial_id and the condition columns: `<factor>` for one clip, `<factor>_a` and
    `<factor>_b` for a pair. Each side is a left join, so clips without a key stay. Only the
    clips that trials show are sought, and a trial without a clip has a key of its own, or
    all of these would meet in one task."""
    shown = trials.select(F.explode("clip_ids").alias("clip_id")).distinct()
    wide = blinding_wide(key.join(shown, "clip_id", "left_semi"), factors)
    side = lambda k: wide.select(F.col("clip_id").alias(f"clip_{k}"), *[F.col(f).alias(f"{f}@{k}") for f in factors])
    t = trials.select("trial_id", "pair_id", F.get("clip_ids", F.lit(0)).alias("clip_0"), F.get("clip_ids", F.lit(1)).alias("clip_1"))
    for k in (0, 1):
        t = t.withColumn("none", F.col(f"clip_{k}").isNull()).withColumn(f"clip_{k}", F.coalesce(f"clip_{k}", "trial_id"))
        t = t.join(side(k).withColumn("none", F.lit(False)), [f"clip_{k}", "none"], "left").drop("none")
    single = F.col("pair_id").isNull()
    cells = []
    for f in factors:
        cells += [F.when(single, F.col(f"{f}@0")).alias(f), F.when(~single, F.col(f"{f}@0")).alias(f"{f}_a"), F.when(~single, F.col(f"{f}@1")).alias(f"{f}_b")]
    return t.select("trial_id", *cells)


def response(kind: Column, value: Column, options: Column, clips: Column) -> Column:
    """A pairwise answer becomes the clip that its option stood for."""
    clip = F.get(clips, (F.array_position(options, value) - 1).cast("int"))
    return F.when(kind == "pairwise", clip).otherwise(value)


def tidy_rows(trials: DataFrame, attempts: DataFrame, items: DataFrame, personas: DataFrame, key: DataFrame, attributes: list[str], test_kind: str = "main") -> DataFrame:
    """One row per trial and item, typed. items: instrument, item_id, type, options, pos."""
    clash = set(HEAD + TAIL + attributes + ["model"])
    factors = factors_of(key)
    for f in factors:
        if clash & {f, f"{f}_a", f"{f}_b"}:
            raise EngineError("condition_name_clash", f)
    t = trial_ops.exported_attempt(trials, attempts)
    answers = F.from_json("answer_json", "map<string,string>")
    asked = items.select("instrument", "item_id", F.col("type").alias("_type"), F.col("options").alias("_options"), F.col("pos").alias("item_pos"))
    rows = t.withColumn("answers", answers).join(F.broadcast(asked), "instrument")
    people = personas.select(F.col("id").alias("persona_id"), *attributes)
    rows = rows.join(people, "persona_id").join(condition_cells(trials, key, factors), "trial_id")
    pair = F.col("pair_id").isNotNull()
    clip = lambda i: F.get("clip_ids", F.lit(i))
    value = F.try_element_at("answers", F.col("item_id"))
    return rows.select(
        F.lit(EXPORT_VERSION).alias("schema_version"), "agent_id", "session_id", "trial_index",
        F.when(~pair, clip(0)).alias("clip_id"), "pair_id", F.when(pair, clip(0)).alias("clip_id_a"), F.when(pair, clip(1)).alias("clip_id_b"),
        *attributes, F.col("model_id").alias("model"),
        *[c for f in factors for c in (f, f"{f}_a", f"{f}_b")],
        "instrument", F.col("item_id").alias("item"), response(F.col("_type"), value, F.col("_options"), F.col("clip_ids")).alias("response"),
        "position", "repeat", "seed", "prompt_variant", F.col("state").alias("status"), F.lit(False).alias("excluded"), F.lit(None).cast("string").alias("exclusion_reason"),
        F.lit(test_kind).alias("test_kind"), F.lit(None).cast("string").alias("protocol_lock"), F.col("shown_at").alias("timestamp"), "item_pos",
    )


def in_export_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(ids.natural_key("session_id"), "trial_index", "item_pos").drop("item_pos")


def as_text(rows: DataFrame) -> DataFrame:
    """Every cell as text; null and empty are both empty, booleans lower-case, times UTC."""
    out = []
    for name, kind in rows.dtypes:
        c = F.col(f"`{name}`")
        text = texts.utc_millis(c) if kind.startswith("timestamp") else c.cast("string")
        out.append(F.coalesce(text, F.lit("")).alias(name))
    return rows.select(*out)


def attrition_sidecar(trials: DataFrame, personas: DataFrame, key: DataFrame, attributes: list[str]) -> DataFrame:
    """dimension, attribute, value and the counters, per model, persona attribute, condition
    column and instrument; first is the place of the value in export order.

    The dimensions of a trial are unpivoted to rows and summed per task before one shuffle."""
    factors = factors_of(key)
    columns = [c for f in factors for c in (f, f"{f}_a", f"{f}_b")]
    people = personas.select(F.col("id").alias("persona_id"), *attributes)
    t = status.trial_counters(trials).join(people, "persona_id").join(condition_cells(trials, key, factors), "trial_id")
    place = F.struct(ids.natural_key("session_id").alias("s"), F.col("trial_index").alias("i"))
    one = lambda d, a, v: F.struct(F.lit(d).alias("dimension"), F.lit(a).alias("attribute"), F.coalesce(v.cast("string"), F.lit("")).alias("value"))
    cells = [one("model", "model_id", F.col("model_id")), *[one("persona", a, F.col(a)) for a in attributes], *[one("condition", c, F.col(c)) for c in columns], one("instrument", "instrument", F.col("instrument"))]
    long = t.select(place.alias("place"), F.explode(F.array(*cells)).alias("d"), *[f"is_{k}" for k in ATTRITION_COUNTS])
    return long.groupBy("d.dimension", "d.attribute", "d.value").agg(*status.counted(), F.min("place").alias("first"))


def check_exportable(trials: DataFrame, test: str, kind: str) -> None:
    """Ordered refusals of an export."""
    if kind == "screening":
        raise EngineError("screening_not_exportable", test)
    found = trials.filter(F.col("test") == test).agg(F.count("*").alias("n"), F.count_if(F.col("state").isin("planned", "sent")).alias("running")).first()
    if not found.n:
        raise EngineError("nothing_to_export", test)
    if found.running:
        raise EngineError("sessions_running", f"{found.running} trials have not ended")


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV as text, header first, quotes doubled, blanks kept, null as empty. At scale the
    parts stay parts, each with a header; `single_file` is for reports of bounded size."""
    out = df.coalesce(1) if single_file else df
    out.write.options(header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_together(spark, frames: dict[str, DataFrame], folder: str, single_file: bool = False) -> None:
    """All outputs or none: written to a folder beside, which then takes the place of `folder`
    with one rename. A folder that was there before goes, or comes back if that fails; no
    reader sees outputs of two exports together."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    folder, mark = folder.rstrip("/"), uuid.uuid4().hex
    path = jvm.org.apache.hadoop.fs.Path
    final, new, old = path(folder), path(f"{folder}.{mark}"), path(f"{folder}.{mark}-was")
    fs = final.getFileSystem(conf)
    try:
        for name, df in frames.items():
            write_csv(df, os.path.join(new.toString(), name), single_file)
        there = fs.exists(final)
        if there and not fs.rename(final, old):
            raise EngineError("export_failed", folder)
        if not fs.rename(new, final):
            if there:
                fs.rename(old, final)
            raise EngineError("export_failed", folder)
    finally:
        fs.delete(new, True)
        if fs.exists(final):
            fs.delete(old, True)
