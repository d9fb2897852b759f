"""Study tables derived from the driver's tables, so that queries have something to run on.

`tables(spark, dir)` gives the DataFrames; oracles.py has the same views as DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids

#: Instruments that show two clips.
PAIRWISE = ("1-URGENT", "2-HIGH")
ITEMS = [
    ("1-URGENT", "better", "pairwise", None, ["A", "B"], 0),
    ("2-HIGH", "alive", "pairwise", None, ["A", "B"], 0),
    ("3-MEDIUM", "like", "likert", 5, None, 0),
    ("3-MEDIUM", "trust", "likert", 7, None, 1),
    ("4-NOT SPECIFIED", "calm", "likert", 5, None, 0),
    ("5-LOW", "why", "free_text", None, None, 0),
]
ATTRIBUTES = ["segment", "nation", "region"]
#: item of a self-report, construct, reversed, points
KEYS = [
    ("i0", "extraversion", True, 5), ("i1", "agreeableness", False, 5), ("i2", "conscientiousness", True, 5), ("i3", "neuroticism", True, 5), ("i4", "openness", True, 5),
    ("i5", "extraversion", False, 5), ("i6", "agreeableness", True, 5), ("i7", "conscientiousness", False, 5), ("i8", "neuroticism", False, 5), ("i9", "openness", False, 5),
]
CONSTRUCTS = ["openness", "conscientiousness", "extraversion", "agreeableness", "neuroticism"]
#: place, instrument, item, pairwise, clips, expected
CHECKS = [
    (0, "view", "v", False, ["c1", "c2"], "c1"), (1, "view", "v", False, ["c3"], "4"), (2, "click", "v", True, ["c1", "c4"], "c4"),
    (3, "click", "v", True, ["c2", "c3"], "c2"), (4, "signup", "v", False, ["c5", "c6"], "c6"), (5, "error", "v", False, ["c7"], "2"),
]
#: model, provider, input and output USD per million tokens, media tokens a second, characters a token, most output tokens
PRICES = [("m1", "alpha", "1.25", "5", "263", "4", 100), ("m2", "beta", "0.075", "0.3", "258", "4", 200), ("m3", "gamma", "3", "15", "300", "3.5", 150)]
#: model, place, most seconds, most bytes, base64
LIMITS = [("m1", 0, 95.0, 120000, True), ("m2", 1, 60.0, 400000, False), ("m3", 2, 200.0, 99000, True)]
CEILING = "40000000"
INSTRUCTIONS = 'Look closely. "Quote" nothing; é stays.'
#: instrument, place, clips, intended answer
EXAMPLES = [
    ("1-URGENT", 0, ["c1", "c102"], '{"better": "A"}'), ("3-MEDIUM", 0, ["c1"], '{"trust": 6, "like": 2}'),
    ("3-MEDIUM", 1, ["c3"], '{"like": 4, "trust": 1}'), ("3-MEDIUM", 2, ["c4"], '{"like": 5, "trust": 5}'),
]
#: name, kind
TESTS = [("t1", "main"), ("t2", "pilot"), ("t3", "screening"), ("t4", "main"), ("t5", "pilot")]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    reserved = F.col("l_extendedprice").cast("decimal(18,2)")
    return line.select(
        F.concat(F.lit("o"), "l_orderkey").alias("trial_id"),
        F.row_number().over(order).alias("attempt"),
        F.col("l_suppkey").alias("seed"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("h"), "l_partkey")).alias("handle"),
        F.col("l_shipdate").alias("sent_at"),
        F.when(F.col("l_returnflag") != "N", F.expr("l_shipdate + interval 1 hour")).alias("answered_at"),
        F.when(F.col("l_returnflag") != "N", "ok").when(F.col("l_linestatus") == "O", "transient").otherwise("refused").alias("category"),
        F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False).alias("valid"),
        F.when(F.col("l_returnflag") == "A", F.col("l_suppkey")).alias("answer"),
        reserved.alias("reserved_usd"),
        F.when(F.col("l_linestatus") == "F", (reserved * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)")).alias("actual_usd"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a trial follows from its last attempt; with two thirds of the attempts
    already grouped by trial, the join needs no further shuffle of them."""
    last = attempts(spark, sf_dir).groupBy("trial_id").agg(F.max("attempt").alias("attempt"), F.max_by(F.struct("valid", "category"), "attempt").alias("l"))
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", F.concat(F.lit("o"), "o_orderkey").alias("trial_id"))
    key, pair = F.col("o_orderkey"), F.col("o_orderpriority").isin(*PAIRWISE)
    a, b = F.concat(F.lit("c"), (1 + key % 97).cast("string")), F.concat(F.lit("c"), (101 + (key * 7 + 3) % 97).cast("string"))
    model, persona = F.concat(F.lit("m"), (1 + F.col("o_custkey") % 3).cast("string")), F.concat(F.lit("p"), (1 + F.col("o_custkey")).cast("string"))
    test, repeat = F.concat(F.lit("t"), (1 + key % 4).cast("string")), (1 + key % 2).cast("int")
    state = (
        F.when(F.col("l").isNull(), "planned").when(F.col("o_orderstatus") == "P", "sent").when(F.col("l.valid"), "valid").when(~F.col("l.valid"), "invalid")
        .when(F.col("l.category") == "refused", "refused").otherwise("failed")
    )
    t = o.join(last, "trial_id", "left").select("*", test.alias("test"), model.alias("model_id"), persona.alias("persona_id"), repeat.alias("repeat"))
    t = t.withColumn("agent_id", ids.agent_id("persona_id", "model_id")).withColumn("session_id", ids.session_id("test", "agent_id", "repeat"))
    return t.select(
        "trial_id", "test", "session_id", key.cast("int").alias("trial_index"), F.col("o_orderpriority").alias("instrument"),
        F.when(pair, F.array(a, b)).otherwise(F.array(a)).alias("clip_ids"), F.when(pair, ids.pair_id("o_orderpriority", a, b)).alias("pair_id"),
        F.when(pair, 1 + (key % 2)).cast("int").alias("position"), F.lit("default").alias("prompt_variant"), "repeat", "agent_id", "persona_id", "model_id",
        state.alias("state"), F.coalesce("attempt", F.lit(0)).alias("attempt"), F.col("l.category").alias("last_category"),
    )


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attempts with answer_json for their trial's instrument."""
    a = attempts(spark, sf_dir)
    t = trials(spark, sf_dir).select("trial_id", "instrument")
    likert = lambda name, points, add: F.concat(F.lit(f'"{name}":'), (1 + (F.col("seed") + add) % points).cast("string"))
    option = F.when(F.col("seed") % 2 == 0, "A").otherwise("B")
    body = (
        F.when(F.col("instrument") == "1-URGENT", F.concat(F.lit('"better":"'), option, F.lit('"')))
        .when(F.col("instrument") == "2-HIGH", F.concat(F.lit('"alive":"'), option, F.lit('"')))
        .when(F.col("instrument") == "3-MEDIUM", F.concat_ws(",", likert("like", 5, 0), likert("trust", 7, 1)))
        .when(F.col("instrument") == "4-NOT SPECIFIED", likert("calm", 5, 2))
        .otherwise(F.lit('"why":"because"'))
    )
    return a.join(t, "trial_id").withColumn("answer_json", F.when(F.col("valid"), F.concat(F.lit("{"), body, F.lit("}")))).drop("instrument")


def items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ITEMS, "instrument string, item_id string, type string, points int, options array<string>, pos int")


def personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (_read(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.concat(F.lit("p"), (1 + F.col("c_custkey")).cast("string")).alias("id"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _read(spark, sf_dir, "part").select(
        F.concat(F.lit("c"), k.cast("string")).alias("clip_id"), F.col("p_size").cast("double").alias("duration_s"), (k * 977 % 50021 + 100).alias("size_bytes"),
        (640 + 16 * (k % 2)).cast("int").alias("width"), F.lit(480).alias("height"), F.lit(25.0).alias("fps"),
        F.when(k % 17 == 0, None).otherwise(-20 - k % 7).cast("double").alias("loudness_lufs"),
    )


def blinding_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part").select(F.concat(F.lit("c"), "p_partkey").alias("clip_id"), F.col("p_partkey").alias("pos"), "p_brand", "p_type")
    return p.unpivot(["clip_id", "pos"], ["p_brand", "p_type"], "factor", "level").withColumn("factor", F.substring("factor", 3, 10))


def runs(spark: SparkSession) -> DataFrame:
    rows = [(f"s{i}", "fidelity" if i % 2 == 0 else "perception", None if i % 2 == 0 else "t1", "complete" if i != 3 else "abandoned") for i in range(1, 7)]
    return spark.createDataFrame(rows, "run_id string, kind string, screening_test string, status string")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run, model, instrument and agent; the first event that gives it counts."""
    e = _read(spark, sf_dir, "events")
    run, fidelity = 1 + F.col("event_id") % 6, F.col("event_id") % 2 == 1
    rows = e.select(
        F.col("event_id").alias("pos"), F.concat(F.lit("s"), run.cast("string")).alias("run_id"), F.concat(F.lit("m"), (1 + F.col("user_id") % 3).cast("string")).alias("model_id"),
        F.when(fidelity, F.concat(F.lit("p"), (1 + F.col("user_id") % 40).cast("string"), F.lit("-m"), (1 + F.col("user_id") % 3).cast("string"))).alias("agent_id"),
        F.when(fidelity, "fidelity").otherwise(F.col("event_type")).alias("instrument"), F.when(F.col("value") >= 5, "pass").otherwise("fail").alias("outcome"),
        F.concat(F.lit("h"), (F.col("event_id") % 5).cast("string")).alias("settings_hash"), F.lit("i0").alias("instrument_hash"),
        F.when(fidelity, None).otherwise(F.when(F.col("event_type") == "error", 0).otherwise(2)).cast("int").alias("pair_checks"),
    )
    first = F.min_by(F.struct("pos", "outcome", "settings_hash", "instrument_hash", "pair_checks"), "pos")
    return rows.groupBy("run_id", "model_id", "agent_id", "instrument").agg(first.alias("r")).select("run_id", "model_id", "agent_id", "instrument", "r.*")


def settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("m1", "h1"), ("m2", "h2"), ("m3", "h9")], "model_id string, cur_settings string")


def stamps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, "i0") for i in ("view", "click", "signup", "fidelity")] + [("purchase", "i1"), ("error", "i0")], "instrument string, cur_instrument string")


def needed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("view", 0), ("purchase", 1), ("error", 2), ("poll", 3)], "instrument string, pos int")


def agents(spark: SparkSession) -> DataFrame:
    return spark.range(1, 41).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("persona_id"), F.explode(F.array(F.lit("m1"), F.lit("m2"), F.lit("m3"))).alias("model_id"))


def checks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHECKS, "pos int, instrument string, item_id string, pairwise boolean, clips array<string>, expected string")


def perception_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trial per model, repeat, instrument and clips; the last event that gives it counts."""
    e = _read(spark, sf_dir, "events")
    k, pair = F.col("event_id"), F.col("event_type") == "click"
    a, b = 1 + k % 7, 1 + (k + 1 + F.floor(k / 7) % 6) % 7
    name = lambda n: F.concat(F.lit("c"), n.cast("string"))
    clip_ids = F.when(pair, F.array(name(a), name(b))).otherwise(F.array(name(a)))
    number = (1 + F.floor(F.col("value")) % 5).cast("string")
    rows = e.select(
        k.alias("event_id"), F.concat(F.lit("m"), (1 + F.col("user_id") % 3).cast("string")).alias("model_id"), (1 + k % 2).cast("int").alias("repeat"), F.col("event_type").alias("instrument"),
        clip_ids.alias("clip_ids"), F.when(pair, F.get(clip_ids, (F.floor(F.col("value")) % 2).cast("int"))).otherwise(number).alias("answer"), F.when(pair, "string").otherwise("int").alias("kind"),
        F.when(k % 11 == 0, "invalid").otherwise("valid").alias("state"), F.lit("v").alias("item_id"),
    )
    last = F.max_by(F.struct("answer", "kind", "state", "item_id"), "event_id")
    return rows.groupBy("model_id", "repeat", "instrument", "clip_ids").agg(last.alias("r")).select("model_id", "repeat", "instrument", "clip_ids", "r.*")


def fidelity_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _read(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'")
    return line.select(F.concat(F.lit("a"), (F.col("l_suppkey") % 50).cast("string")).alias("agent_id"), F.concat(F.lit("i"), (F.col("l_partkey") % 10).cast("string")).alias("item_id"), F.pmod(F.floor(F.col("l_quantity")).cast("int") + F.when(F.col("l_suppkey") % 2 == 0, F.col("l_partkey") % 10).otherwise(0).cast("int"), F.lit(6)).alias("value"))


def fidelity_keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KEYS, "item_id string, construct string, reversed boolean, points int")


def fidelity_poles(spark: SparkSession) -> DataFrame:
    named = F.array(*[F.lit(c) for c in CONSTRUCTS])
    return spark.range(50).select("id", F.posexplode(named).alias("bit", "construct")).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("agent_id"), "construct", F.when(F.expr("(id >> bit) & 1") == 1, "high").otherwise("low").alias("pole"))


def event_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each event: valid ones and all kinds of broken ones."""
    e = _read(spark, sf_dir, "events")
    kind, p = F.col("event_id") % 13, F.col("props")
    raw = (
        F.when(kind == 1, F.concat(p, F.lit(" extra"))).when(kind == 2, F.concat(F.lit("["), p, F.lit("]"))).when(kind == 3, F.lit('{"k": 1, "k": 2}')).when(kind == 4, F.lit('{"k": 1, "z": 2}'))
        .when(kind == 5, F.lit("{}")).when(kind == 6, F.lit('{"k": "1"}')).when(kind == 7, F.lit('{"k": 4.0}')).when(kind == 8, F.lit('{"k": true}')).when(kind == 9, F.lit('{"k": NaN}'))
        .when(kind == 10, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(kind == 11, F.lit('{"k": 0}')).otherwise(p)
    )
    return e.select("event_id", raw.alias("raw"))


def raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as they come: those of the events, and plain prose."""
    e = event_answers(spark, sf_dir)
    prose = _read(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), F.lit("scale").alias("instrument"), F.col("text").alias("raw"))
    return e.select(F.concat(F.lit("e"), "event_id").alias("id"), F.lit("scale").alias("instrument"), "raw").union(prose)


def scale(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("scale", "k", "likert", 90, None, 0)], "instrument string, item_id string, type string, points int, options array<string>, pos int")


def ceiling_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change per day at most, as somebody would make them."""
    e = _read(spark, sf_dir, "events").filter("event_type = 'purchase'")
    day = e.groupBy(F.to_date("ts").alias("day")).agg(F.max_by(F.struct("event_id", "value"), "event_id").alias("r"))
    return day.select(F.col("r.event_id").alias("seq"), F.col("r.value").cast("decimal(18,2)").alias("ceiling_usd"))


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model_id string, provider string, input_usd string, output_usd string, media_rate string, chars_per_token string, max_output_tokens bigint")


def limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LIMITS, "model_id string, pos int, max_seconds double, max_bytes bigint, base64 boolean")


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request lines of the attempts, some of them wrong, missing or written twice."""
    a = attempts(spark, sf_dir).join(trials(spark, sf_dir).select("trial_id", "model_id"), "trial_id").withColumn("k", F.col("seed") % 20)
    sha = F.concat(F.lit("b"), F.col("seed").cast("string"))
    kept = a.filter("k <> 1").select("trial_id", "attempt", F.when(F.col("k") == 2, F.lit("?")).otherwise(sha).alias("request_sha256"), F.when(F.col("k") == 3, F.col("seed") + 1).otherwise(F.col("seed")).alias("seed"), F.when(F.col("k") == 4, F.lit("m0")).otherwise(F.col("model_id")).alias("model_id"), sha.alias("body_sha256"))
    twice = a.filter("k = 5").select("trial_id", "attempt", sha.alias("request_sha256"), "seed", "model_id", F.concat(sha, F.lit("x")).alias("body_sha256"))
    return kept.union(twice)


def request_items(instrument: str) -> list[dict]:
    """The items of an instrument as a request lists them."""
    anchors = lambda kind: {"high": "very", "low": "not at all"} if kind == "likert" else None
    return [{"anchors": anchors(kind), "id": item, "options": options, "points": points, "text": f"How {item}?", "type": kind} for name, item, kind, points, options, _ in ITEMS if name == instrument]


def answer_schema(instrument: str) -> dict:
    kinds = {i["id"]: {"type": "integer" if i["type"] == "likert" else "string"} for i in request_items(instrument)}
    return {"type": "object", "properties": kinds, "required": list(kinds)}


def instruments(spark: SparkSession) -> DataFrame:
    names = list(dict.fromkeys(i[0] for i in ITEMS))
    rows = [(n, INSTRUCTIONS, request_items(n), json.dumps(answer_schema(n)), {"default": f"Answer {n}."}) for n in names]
    item = "struct<anchors:struct<high:string,low:string>,id:string,options:array<string>,points:int,text:string,type:string>"
    return spark.createDataFrame(rows, f"instrument string, instructions string, items array<{item}>, schema string, variants map<string,string>")


def examples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXAMPLES, "instrument string, pos int, clips array<string>, answer string")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personas(spark, sf_dir).select(F.col("id").alias("persona_id"), F.concat(F.lit("You live in "), "nation", F.lit(".\nYou buy "), "segment", F.lit(".")).alias("card"))


def clip_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips(spark, sf_dir).select("clip_id", F.sha2("clip_id", 256).alias("sha256"))


def _events(rows: DataFrame, events: list[tuple[int, dict]], columns: dict[str, str]) -> DataFrame:
    """For each attempt, its events: their place in the attempt and the columns they set."""
    one = lambda at, given: F.struct((F.col("attempt") * 10 + at).alias("seq"), *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
    return rows.select("trial_id", "attempt", F.explode(F.array(*[one(at, given) for at, given in events])).alias("e")).select("trial_id", "attempt", "e.*")


def attempt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attempt is sent, given a handle, and answered."""
    set_by = [(0, {"sent_at": F.col("sent_at")}), (1, {"handle": F.col("handle")}), (2, {"category": F.col("category"), "valid": F.col("valid")})]
    rows = attempts(spark, sf_dir)
    return _events(rows, set_by, {"sent_at": rows.schema["sent_at"].dataType, "handle": "string", "category": "string", "valid": "boolean"})


def state_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("valid"), "valid").when(~F.col("valid"), "invalid").when(F.col("category") == "refused", "refused").otherwise("sent")
    return _events(attempts(spark, sf_dir), [(0, {"state": F.lit("sent")}), (2, {"state": end})], {"state": "string"})


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reservation, the actual cost, and nothing to pay for what was refused."""
    free = F.when(F.col("category") == "refused", 0)
    set_by = [(0, {"reserved_usd": F.col("reserved_usd")}), (1, {"actual_usd": F.col("actual_usd")}), (2, {"actual_usd": free})]
    return _events(attempts(spark, sf_dir), set_by, {"reserved_usd": "decimal(18,2)", "actual_usd": "decimal(18,4)"})


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = trials(spark, sf_dir).groupBy(F.col("test").alias("name")).agg(F.collect_set("instrument").alias("instruments"))
    return spark.createDataFrame(TESTS, "name string, kind string").join(used, "name", "left")


def test_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials(spark, sf_dir)
    target = t.select("test", F.explode("clip_ids").alias("clip_id"), F.lit("target").alias("role"))
    return target.union(t.select("test", F.lit("c1").alias("clip_id"), F.lit("practice").alias("role"))).distinct()


def usage_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per attempt, the usage that two kinds of provider report; none for transient ones."""
    n = F.col("seed")
    detail = lambda kind, count: F.struct(F.lit(kind).alias("modality"), count.alias("token_count"))
    a = F.struct((n + 100).alias("prompt_token_count"), F.lit(3).alias("tool_use_prompt_token_count"), n.alias("candidates_token_count"), F.when(F.col("valid"), n % 7).alias("thoughts_token_count"), F.array(detail("text", n), detail("VIDEO", n * 2), detail("Video", F.lit(1).cast("long"))).alias("prompt_tokens_details"))
    b = F.struct((n + 50).alias("prompt_tokens"), n.alias("completion_tokens"), F.struct(F.lit(5).alias("text_tokens"), F.when(F.col("valid"), n).alias("video_tokens")).alias("prompt_tokens_details"))
    answered = F.col("category") != "transient"
    return attempts(spark, sf_dir).select("trial_id", "attempt", F.when(answered, F.to_json(a)).alias("by_modality"), F.when(answered, F.to_json(b)).alias("by_details"))


def customer_plans(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A test plan per customer: the priorities of its pending orders are the instruments it
    lists, its finished orders name the targets, its open ones the practice examples."""
    o = _read(spark, sf_dir, "orders").select(F.concat(F.lit("u"), "o_custkey").alias("test"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("instrument"), "o_orderstatus")
    clip = lambda first, n: F.concat(F.lit("c"), (first + F.col("k") % n).cast("string"))
    pair = F.col("instrument").isin(*PAIRWISE)
    examples = o.filter("o_orderstatus = 'O'").withColumn("pos", (F.row_number().over(Window.partitionBy("test").orderBy("k")) - 1).cast("bigint"))
    return {
        "tests": _read(spark, sf_dir, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("test")),
        "listed": o.filter("o_orderstatus = 'P'").select("test", "instrument", F.substring("instrument", 1, 1).cast("int").alias("pos")).distinct(),
        "targets": o.filter("o_orderstatus = 'F'").select("test", clip(0, 30).alias("clip_id")).distinct(),
        "practice": examples.select("test", "pos", "instrument", F.when(pair, F.array(clip(25, 7), clip(27, 4))).otherwise(F.array(clip(25, 7))).alias("clips")),
    }


#: Instruments that customers' plans may list, and whether they show pairs.
KNOWN = [("1-URGENT", True), ("2-HIGH", True), ("3-MEDIUM", False), ("5-LOW", False)]
#: instrument, item, type, points, options, place
CHECK_ITEMS = [("view", "v", "likert", 5, None, 0), ("click", "v", "pairwise", None, ["A", "B"], 0), ("signup", "v", "likert", 2, None, 0), ("signup", "t", "pairwise", None, ["A", "B"], 1), ("purchase", "v", "free_text", None, None, 0)]


def known_instruments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "instrument string, pairwise boolean")


def check_items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHECK_ITEMS, "instrument string, item_id string, type string, points int, options array<string>, pos int")


def user_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check per event, in a test per user: good ones and all kinds of bad ones."""
    k, two = F.col("event_id"), F.col("value") >= 40
    a, b = F.concat(F.lit("c"), (1 + k % 4).cast("string")), F.concat(F.lit("c"), (1 + (k + 1) % 5).cast("string"))
    return _read(spark, sf_dir, "events").select(
        F.concat(F.lit("k"), "user_id").alias("test"), k.alias("pos"), F.col("event_type").alias("instrument"), F.when(k % 9 == 0, "t").otherwise("v").alias("item_id"),
        F.when(two, F.array(a, b)).otherwise(F.array(a)).alias("clips"), F.when(two, F.when(k % 5 == 0, "c9").otherwise(a)).otherwise((1 + k % 6).cast("string")).alias("expected"), F.when(two | (k % 7 == 0), "string").otherwise("int").alias("kind"),
    )


def user_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _read(spark, sf_dir, "events").select(F.concat(F.lit("k"), "user_id").alias("test")).distinct()
    return users.select("test", F.explode(F.array(*[F.lit(f"c{i}") for i in range(1, 5)])).alias("clip_id"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that may stand on a card, and some that may not."""
    size = F.col("p_size")
    word = F.when(size > 40, "HIGH").when(size > 20, "low-lying").when(size > 10, "Agreeable").when(size > 5, "slow").otherwise("")
    made = _read(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.when(size == 1, "").otherwise(F.concat(word, F.lit(" "), "p_name")).alias("text"))
    return made.union(_read(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn"), "text"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A persona per customer; those of one region have no band."""
    bits = F.create_map(*[x for i, t in enumerate(CONSTRUCTS) for x in (F.lit(t), F.when(F.expr(f"(number >> {i}) & 1") == 1, "high").otherwise("low"))])
    rows = personas(spark, sf_dir).withColumn("number", ids.persona_number("id"))
    return rows.select("id", bits.alias("big_five"), F.when(F.col("region") != "ASIA", "low").alias("nars"), F.col("nation").alias("age_band"), F.col("segment").alias("gender"), F.col("region").alias("cultural_region"), F.lit("some").alias("robot_experience"))


#: Phrases of cards by level, and the sentences of the traits' poles.
_PLACES = {"AFRICA": "the south", "AMERICA": "the west", "ASIA": "the east", "EUROPE": "the north", "MIDDLE EAST": "the middle"}
_TRADES = {"AUTOMOBILE": "drive", "BUILDING": "build", "FURNITURE": "furnish", "HOUSEHOLD": "keep house", "MACHINERY": "run machines"}
WORDING = {
    "demographic": "You come from {cultural_region} and {gender}; {age_band}, {robot_experience}.",
    "level_phrases": {"age_band": {"grown": "you are grown"}, "gender": _TRADES, "cultural_region": _PLACES, "robot_experience": {"some": "you have met robots"}},
    "traits": {c: {"high": f"Much of sentence {i}.", "low": f"Little of sentence {i}."} for i, c in enumerate(CONSTRUCTS)},
    "nars": {"low": "Robots are fine."},
}


def card_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with a column per trait, and one age only."""
    traits = [F.col("big_five")[c].alias(c) for c in CONSTRUCTS]
    return panel(spark, sf_dir).select("id", *traits, "nars", F.lit("grown").alias("age_band"), "gender", "cultural_region", "robot_experience")


def card_sentences(spark: SparkSession) -> DataFrame:
    rows = [(text, construct, pole) for construct, poles in WORDING["traits"].items() for pole, text in poles.items()]
    return spark.createDataFrame(rows, "sentence string, construct string, pole string")


def archive_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive lines of the attempts: those of transient ones break off, those of refused ones
    lack their attempt."""
    a = attempts(spark, sf_dir)
    text = F.concat(F.lit('{"trial_id":"'), "trial_id", F.lit('","attempt":'), F.when(F.col("category") == "refused", F.lit("null")).otherwise(F.col("attempt").cast("string")), F.lit(',"raw":"line\\\\nof '), "category", F.lit('"}'))
    return a.select("category", F.when(F.col("category") == "transient", F.substring(text, 1, 30)).otherwise(text).alias("value"))


def rounding_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles of many sizes, ties of the fourth decimal among them."""
    part = _read(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("double").alias("k"), "p_retailprice", "p_size")
    forms = {"tie": F.col("k") / 32, "third": F.col("p_retailprice") / 3, "near": F.col("k") + 0.00005, "small": -F.col("k") * 1e-7, "cents": F.col("k") * 0.0125, "large": F.col("p_retailprice") * 1e9 / 7, "huge": F.col("p_retailprice") * 1e19, "wide": (F.col("k") + 0.3) * 1e11}
    return part.select("p_partkey", F.explode(F.create_map(*[x for k, v in forms.items() for x in (F.lit(k), v)])).alias("form", "x"))


def ceiling_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order asks to run under a ceiling, in one study per nation of its customer."""
    o = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal"), "o_custkey")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    given = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit(" "), price.cast("string"))).when(F.col("o_orderpriority") == "2-HIGH", F.concat((F.col("o_orderkey") % 4).cast("string"), F.lit("e5")))
        .when((F.col("o_orderpriority") == "3-MEDIUM") & (F.col("c_acctbal") < 0), "some")
    )
    return o.select(
        F.concat(F.lit("n"), "c_nationkey").alias("study"), F.col("o_orderkey").alias("seq"), given.alias("given"), (price / 2).cast("decimal(18,2)").alias("expected_usd"),
        F.abs(F.col("c_acctbal").cast("decimal(18,2)") * 9).cast("decimal(18,2)").alias("committed_usd"), (F.col("o_orderstatus") != "P").alias("fresh"), (F.col("o_orderstatus") == "O").alias("uncapped_ok"),
    )


def test_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test document per customer and a price document per supplier, with many kinds of faults."""
    k = F.col("c_custkey") % 13
    pick = lambda cases, other: F.coalesce(*[F.when(k == n, F.lit(text)) for n, text in cases.items()], other if not isinstance(other, str) else F.lit(other))
    name = F.concat(F.when(k == 11, "-u").otherwise("u"), "c_custkey")
    test = F.concat(
        F.lit('{"schema_version":'), pick({11: "2"}, "1"), F.lit(',"test":"'), name, F.lit('"'), pick({1: "", 2: ',"kind":"poll"'}, ',"kind":"pilot"'), F.lit(',"instruments":'), pick({3: "[]", 4: '["a","b","a"]'}, '["a","b"]'),
        F.lit(',"models":'), pick({9: "[]", 12: "null"}, '["m1"]'), F.lit(',"clips":'), pick({5: '["c_aaaaaaaa","c_bbbbbbbb","c_aaaaaaaa"]', 8: '["c_aaaaaaaa",7,"x"]'}, '["c_cccccccc"]'),
        F.lit(',"session":'), pick({6: '{"repeats":0,"pairing":"none"}', 7: '{"repeats":"3","max_retries":1.5}'}, '{"repeats":2}'),
        pick({10: ',"colour":1,"checks":[{"instrument":"a","item":"i","clips":["c_aaaaaaaa"],"expected":3}]'}, ""), F.lit("}"),
    )
    tests = _read(spark, sf_dir, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("doc_id"), F.lit("test").alias("doc_kind"), test.alias("json"))
    s, amount = F.col("s_suppkey") % 5, F.abs(F.col("s_acctbal").cast("decimal(18,2)")).cast("string")
    price = F.concat(F.lit('{"input_usd_per_mtok":"'), F.when(s == 1, "-").otherwise(""), amount, F.lit('","output_usd_per_mtok":"5","media_tokens_per_s":"263","chars_per_token":"'), F.when(s == 3, "0.0").otherwise("4"), F.lit('"}'))
    prices = F.when(s == 4, '{"schema_version":1}').otherwise(F.concat(F.lit('{"schema_version":1,"models":{"'), F.when(s == 2, "x1").otherwise("m1"), F.lit('":'), price, F.lit("}}")))
    return tests.union(_read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.lit("prices"), prices))


def nation_models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The models that customers of a nation use, and those that its suppliers price."""
    model = lambda c, n: F.concat(F.lit("m"), (1 + F.col(c) % n).cast("string")).alias("model_id")
    study = lambda c: F.concat(F.lit("n"), c).alias("study")
    return _read(spark, sf_dir, "customer").select(study("c_nationkey"), model("c_custkey", 7)), _read(spark, sf_dir, "supplier").select(study("s_nationkey"), model("s_suppkey", 5))


def pushes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Each order pushes its customer's test, its priority being the content. Customers with
    money have registered theirs; the stored files of some are gone or edited."""
    o, c = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    sha = lambda *parts: F.sha2(F.concat_ws("/", *parts), 256)
    name = lambda key: F.concat(F.lit("u"), key)
    clip = lambda n: F.concat(F.lit("c"), (1 + F.col("o_orderkey") % n).cast("string"))
    pushed = o.select(
        F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderpriority") == "5-LOW", F.concat(name("o_custkey"), F.lit("-attrition"))).otherwise(name("o_custkey")).alias("name"),
        F.when(F.col("o_orderstatus") == "F", "main").otherwise("pilot").alias("kind"), sha("o_custkey", "o_orderpriority").alias("sha256"), F.array(clip(500)).alias("targets"), F.array(clip(230)).alias("practice"),
    )
    rich = c.filter("c_acctbal > 0")
    registered = rich.select(name("c_custkey").alias("name"), F.when(F.col("c_mktsegment") == "BUILDING", "main").otherwise("pilot").alias("kind"), sha("c_custkey", F.lit("1-URGENT")).alias("sha256"))
    stored = rich.filter("c_mktsegment <> 'MACHINERY'").select(name("c_custkey").alias("name"), sha("c_custkey", F.when(F.col("c_mktsegment") == "FURNITURE", "edited").otherwise("1-URGENT")).alias("sha256"))
    held = rich.select(name("c_custkey").alias("test"), F.concat(F.lit("c"), (1 + F.col("c_custkey") % 400).cast("string")).alias("clip_id"), F.when(F.col("c_nationkey") < 5, "target").otherwise("practice").alias("role"))
    return {"pushed": pushed, "registered": registered, "stored": stored, "clips": clips(spark, sf_dir), "test_clips": held}


def pushed_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small parts are pushed again with their size as another brand."""
    return _read(spark, sf_dir, "part").filter("p_size < 10").select(F.concat(F.lit("c"), "p_partkey").alias("clip_id"), F.lit("brand").alias("factor"), F.concat(F.lit("size"), "p_size").alias("level"), F.col("p_partkey").alias("pos"))


#: instrument, item, construct, reversed, subscale, points
SELF_KEYS = [
    *[("self", f"i{i}", c, i % 2 == 0, None, 5) for i, c in enumerate(("openness", "conscientiousness", "extraversion", "agreeableness", "neuroticism") * 2)],
    ("bands", "r0", "nars", False, "s1", 5), ("bands", "r1", "nars", True, "s2", 5), ("bands", "r2", "nars", False, "s2", 5),
]


def self_keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SELF_KEYS, "instrument string, item_id string, construct string, reversed boolean, subscale string, points int")


def persona_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A screening per customer: its orders are the trials of one agent."""
    t = trials(spark, sf_dir)
    return t.select(F.concat(F.lit("s"), F.substring("persona_id", 2, 20)).alias("run_id"), "trial_id", "agent_id", "persona_id", "model_id", F.when(F.col("instrument").isin("4-NOT SPECIFIED", "5-LOW"), "bands").otherwise("self").alias("instrument"), "state")


def persona_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of chosen answers; some values are out of range."""
    valid = attempts(spark, sf_dir).filter("valid").groupBy("trial_id").agg(F.max_by("seed", "attempt").alias("seed"))
    keys = self_keys(spark).select("instrument", "item_id", F.substring("item_id", 2, 2).cast("int").alias("n"))
    rows = valid.join(persona_trials(spark, sf_dir).select("trial_id", "instrument"), "trial_id").join(F.broadcast(keys), "instrument")
    return rows.select("trial_id", "item_id", ((F.col("seed") + F.col("n") * 3) % 7).cast("int").alias("value"))


def persona_poles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    traits = p.select(F.col("id").alias("persona_id"), F.explode("big_five").alias("construct", "pole"))
    return traits.union(p.filter("nars is not null").select("id", F.lit("nars"), "nars"))


def persona_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps of the runs; those of one market segment have none."""
    c = _read(spark, sf_dir, "customer").filter("c_mktsegment <> 'MACHINERY'")
    return c.select(F.concat(F.lit("s"), (1 + F.col("c_custkey")).cast("string")).alias("run_id"), F.concat(F.lit("m"), (1 + F.col("c_custkey") % 3).cast("string")).alias("model_id"), F.sha2("c_mktsegment", 256).alias("settings_hash"))


def persona_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select(F.concat(F.lit("s"), (1 + F.col("c_custkey")).cast("string")).alias("run_id"), F.lit("h0").alias("instrument_hash"))


def studies_of_parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Brand and type are a study that lists its parts' names; large parts are its own
    instruments, the largest of one type are built in, some with another name inside."""
    p = _read(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("study"), F.regexp_replace("p_name", " ", "_").alias("name"), "p_partkey", "p_size", "p_type")
    other = lambda size: F.when(F.max("p_size") > size, F.concat("name", F.lit("_old"))).otherwise(F.col("name")).alias("document_name")
    return {
        "wanted": p.groupBy("study", "name").agg(F.min("p_partkey").alias("pos")),
        "user": p.filter("p_size > 40").groupBy("study", "name").agg(other(48)),
        "builtin": p.filter("p_size < 3 and p_type = 'STANDARD'").groupBy("name").agg(other(1)),
    }


def questionnaires(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A questionnaire per part name, with an item per part; most are about one construct."""
    p = _read(spark, sf_dir, "part")
    instruments = p.groupBy(F.col("p_name").alias("instrument")).agg((F.max("p_size") > 15).alias("self_report"))
    construct = F.when(F.col("p_size") == 13, "openness").when(F.col("p_size") != 17, "nars")
    items = p.select(F.col("p_name").alias("instrument"), F.col("p_partkey").alias("pos"), F.concat(F.lit("q"), "p_size", F.lit("_"), "p_partkey").alias("item_id"), construct.alias("construct"), F.when(F.col("p_size") > 25, F.concat(F.lit("s"), (F.col("p_size") % 5).cast("string"))).alias("subscale"))
    return instruments, items


def paused_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tests(spark, sf_dir).select("name", "kind", F.when(F.col("kind") == "pilot", "ceiling").alias("paused_reason"))


def clip_per_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").groupBy(F.col("p_size").alias("pos")).agg(F.concat(F.lit("c"), F.min("p_partkey")).alias("clip_id"))


def listed_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priorities of orders, which show pairs or single clips."""
    names = _read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("instrument")).distinct()
    return names.select("instrument", F.col("instrument").isin(*PAIRWISE).alias("pairwise"), F.lit(False).alias("self_report"), F.substring("instrument", 1, 1).cast("int").alias("pos"))


def quota_levels(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    """The levels of a panel's quotas: a few values each, as a study would list them."""
    of = {"age_band": ("part", "p_type"), "gender": ("customer", "c_mktsegment"), "cultural_region": ("region", "r_name"), "robot_experience": ("orders", "o_orderpriority")}
    return {q: sorted(r[0] for r in _read(spark, sf_dir, t).select(c).distinct().collect()) for q, (t, c) in of.items()}


def event_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check per event; clicks show pairs, and some others ask for two clips."""
    k, pair = F.col("event_id"), F.col("event_type") == "click"
    a, b = F.concat(F.lit("c"), 1 + k % 40), F.concat(F.lit("c"), 101 + (k * 7 + 3) % 41)
    clips = F.when(pair | (F.col("value") >= 40), F.array(b, a)).otherwise(F.array(a))
    return _read(spark, sf_dir, "events").select(k.alias("pos"), F.col("event_type").alias("instrument"), F.lit("v").alias("item_id"), pair.alias("pairwise"), clips.alias("clips"), a.alias("expected"))


def part_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item per part, of an instrument per brand."""
    kind = F.when(F.col("p_type") == "ECONOMY", "likert").when(F.col("p_type") == "PROMO", "pairwise").otherwise("free_text")
    p = _read(spark, sf_dir, "part").select("*", kind.alias("type"))
    points = F.when(F.col("type") == "likert", 2 + F.col("p_size") % 10).cast("int")
    return p.select(F.col("p_brand").alias("instrument"), F.concat(F.lit("i"), "p_partkey").alias("item_id"), "type", points.alias("points"), F.when(F.col("type") == "pairwise", F.split("p_name", " ")).alias("options"), F.col("p_partkey").cast("int").alias("pos"))


def instrument_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per brand; its small parts are free texts, and some parts have a key."""
    p = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("instrument"), "p_partkey", "p_size", "p_type")
    item = F.concat(F.lit('{"id":"i'), "p_partkey", F.lit('","type":"'), F.when(F.col("p_size") < 8, F.lit('free_text"}')).otherwise(F.concat(F.lit('likert","points":'), 2 + F.col("p_size") % 9, F.lit("}"))))
    scale = F.when(F.col("p_type") == "PROMO", F.concat(F.lit(',"subscale":"s'), 1 + F.col("p_size") % 3, F.lit('"'))).otherwise("")
    key = F.when(F.col("p_type") != "LARGE", F.concat(F.lit('"i'), "p_partkey", F.lit('":{"construct":"'), F.lower("p_type"), F.lit('","reversed":'), (F.col("p_size") % 2 == 0).cast("string"), scale, F.lit("}")))
    per = p.groupBy("instrument").agg(F.sort_array(F.collect_list(F.struct("p_partkey", item.alias("item"), key.alias("key")))).alias("parts"))
    listed = lambda name: F.array_join(F.transform("parts", lambda x: x[name]), ",")
    return per.select("instrument", F.concat(F.lit('{"items":['), listed("item"), F.lit('],"keys":{'), listed("key"), F.lit("}}")).alias("json"))
