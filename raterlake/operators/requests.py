"""What a rater is sent for a trial, and what a provider says it cost.

Requests are built by joins and array expressions. A trial that can't be rendered keeps its
row, with the reason in `problem` and nothing rendered.

trials: trial_id, instrument, persona_id, prompt_variant, clip_ids (two at most). cards:
persona_id, card. instruments: instrument, instructions, items (array of structs), schema
(JSON text), variants (map of texts). examples: instrument, pos, clips, answer (JSON text).
clips: clip_id, sha256."""

from __future__ import annotations

import hashlib
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The labels between the parts of a prompt.
PRACTICE_LABEL = "Practice example "
ANSWER_LABEL = "Intended answer: "
TARGET_LABEL = "Video to rate:"
PAIR_LABEL = "Video "
ITEMS_LABEL = "Items: "
SCHEMA_LABEL = "Response schema: "

PART = "struct<kind:string,text:string,clip_id:string,sha256:string,role:string>"
_JSON = {"ignoreNullFields": "false"}
#: Characters of a chunk of texts that is compressed at once, and requests that a task sorts.
CHUNK = 1 << 22
PER_TASK = 100_000


def practice(examples: DataFrame, count: int) -> DataFrame:
    """The first `count` examples of each instrument, numbered from 1 in n."""
    rank = F.row_number().over(Window.partitionBy("instrument").orderBy("pos"))
    return examples.withColumn("n", rank).filter(F.col("n") <= count)


def shown_clips(clip_lists: Column) -> Column:
    """The distinct clips of a request's lists, in the order they appear."""
    return F.array_distinct(F.flatten(clip_lists))


def _with_refs(rows: DataFrame, column: str, clips: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Adds refs: the clips of a list of two at most with their hashes, which are null where
    a clip is unknown. Each list that occurs is looked up once, a left join for each place; so
    neither the clips that most rows show nor the missing second ones gather rows in a task. among: where the lists are found, if not in rows."""
    lists = (among or rows).select(F.col(column).alias("_list")).distinct()
    for i in (0, 1):
        known = clips.select(F.col("clip_id").alias(f"_id{i}"), F.col("sha256").alias(f"_sha{i}"))
        lists = lists.withColumn(f"_id{i}", F.get("_list", F.lit(i))).join(known, f"_id{i}", "left")
    refs = F.array(*[F.struct(F.col(f"_id{i}").alias("clip_id"), F.col(f"_sha{i}").alias("sha256")) for i in (0, 1)])
    lists = lists.select("_list", F.slice(refs, F.lit(1), F.least(F.size("_list"), F.lit(2))).alias("refs"))
    return rows.join(lists, F.col(column).eqNullSafe(F.col("_list")), "left").drop("_list")


def _text(value: Column) -> Column:
    return F.struct(F.lit("text").alias("kind"), value.alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("clip_id", "sha256", "role")]).cast(PART)


def _media(ref: Column, role: str) -> Column:
    return F.struct(F.lit("media").alias("kind"), F.lit(None).cast("string").alias("text"), ref["clip_id"].alias("clip_id"), ref["sha256"].alias("sha256"), F.lit(role).alias("role")).cast(PART)


def _clip_parts(refs: Column, labels: Column, role: str) -> Column:
    """A pair is labelled by its options; a single target, but no example, has a label too."""
    pair = F.flatten(F.transform(F.arrays_zip(labels.alias("label"), refs.alias("ref")), lambda x: F.array(_text(F.concat(F.lit(PAIR_LABEL), x["label"], F.lit(":"))), _media(x["ref"], role))))
    one = F.transform(refs, lambda r: _media(r, role))
    if role == "target":
        one = F.when(F.size(refs) > 0, F.concat(F.array(_text(F.lit(TARGET_LABEL))), one)).otherwise(one)
    return F.when(F.size(refs) == 2, pair).otherwise(one)


def _unknown(refs: Column) -> Column:
    return F.exists(refs, lambda r: r["sha256"].isNull())


def instrument_parts(instruments: DataFrame, examples: DataFrame, clips: DataFrame, count: int) -> DataFrame:
    """The instruments with labels (the two options of their pairwise items, else null),
    examples (clips and answers), before (prompt parts of the examples), after (those of
    items and schema), pair and clash (an example shows a pair, an unknown clip). Examples
    are at most `count` an instrument."""
    options = F.array_distinct(F.transform(F.filter("items", lambda i: i["type"] == "pairwise"), lambda i: i["options"]))
    labels = F.when((F.size(options) == 1) & (F.size(F.get(options, 0)) == 2), F.get(options, 0))
    rows = instruments.withColumn("labels", labels)
    some = _with_refs(practice(examples, count), "clips", clips).join(rows.select("instrument", "labels"), "instrument")
    parts = F.concat(F.array(_text(F.concat(F.lit(PRACTICE_LABEL), F.col("n").cast("string"), F.lit(":")))), _clip_parts(F.col("refs"), F.col("labels"), "practice"), F.array(_text(F.concat(F.lit(ANSWER_LABEL), F.to_json(F.parse_json("answer"))))))
    each = F.array_sort(F.collect_list(F.struct("n", parts.alias("parts"), F.struct(F.parse_json("answer").cast("string").alias("answer"), F.col("refs").alias("clips")).alias("example"))))
    some = some.groupBy("instrument").agg(each.alias("each"), F.max(F.size("clips") == 2).alias("pair"), F.max(_unknown(F.col("refs"))).alias("clash"))
    out = rows.join(some, "instrument", "left")
    after = F.array(_text(F.concat(F.lit(ITEMS_LABEL), F.to_json("items", _JSON))), _text(F.concat(F.lit(SCHEMA_LABEL), F.to_json(F.parse_json("schema")))))
    return out.select(
        "instrument", "instructions", "items", "schema", "variants", "labels", after.alias("after"), F.coalesce("pair", F.lit(False)).alias("pair"), F.coalesce("clash", F.lit(False)).alias("clash"),
        F.coalesce(F.flatten(F.transform("each", lambda x: x["parts"])), F.array().cast(f"array<{PART}>")).alias("before"),
        F.transform("each", lambda x: x["example"]).alias("examples"),
    )


def rendered(trials: DataFrame, cards: DataFrame, instruments: DataFrame, examples: DataFrame, clips: DataFrame, count: int) -> DataFrame:
    """trial_id, problem, request (canonical JSON: sorted keys, no blanks), parts (the prompt)
    and clip_ids (distinct clips in order of appearance). Instruments, which a study lists, are
    sent to the trials last, so that their long parts are never shuffled."""
    rows = trials.select("trial_id", "instrument", "persona_id", "prompt_variant", "clip_ids").join(cards.select("persona_id", "card"), "persona_id", "left")
    rows = _with_refs(rows, "clip_ids", clips, trials).join(F.broadcast(instrument_parts(instruments, examples, clips, count)), "instrument", "left")
    prompt = F.try_element_at("variants", F.col("prompt_variant"))
    pairs = (F.size("clip_ids") == 2) | F.col("pair")
    problem = (
        F.when(F.col("instructions").isNull(), "unknown_instrument").when(F.col("card").isNull(), "unknown_persona").when(prompt.isNull(), "unknown_prompt_variant")
        .when(F.size("clip_ids") > 2, "too_many_clips").when(_unknown(F.col("refs")) | F.col("clash"), "unknown_clip").when(pairs & F.col("labels").isNull(), "pair_without_labels")
    )
    practice_json = F.transform(F.coalesce("examples", F.array()), lambda e: F.concat(F.lit('{"answer":'), e["answer"], F.lit(',"clips":'), F.to_json(e["clips"]), F.lit("}")))
    # the only member of an object, without the object's braces
    field = lambda name, c: F.regexp_extract(F.to_json(F.struct(c.alias(name))), r"(?s)^\{(.*)\}$", 1)
    request = F.concat(
        F.lit('{"clips":'), F.to_json("refs"), F.lit(","), field("instructions", F.col("instructions")), F.lit(',"items":'), F.to_json("items", _JSON), F.lit(","), field("persona_card", F.col("card")),
        F.lit(',"practice":['), F.array_join(practice_json, ","), F.lit("],"), field("prompt", prompt), F.lit(',"response_schema":'), F.to_json(F.parse_json("schema")), F.lit("}"),
    )
    parts = F.concat(F.array(_text(F.col("card")), _text(F.col("instructions"))), F.col("before"), _clip_parts(F.col("refs"), F.col("labels"), "target"), F.array(_text(prompt)), F.col("after"))
    shown = shown_clips(F.array(F.flatten(F.transform(F.coalesce("examples", F.array()), lambda e: F.transform(e["clips"], lambda c: c["clip_id"]))), F.col("clip_ids")))
    fine = lambda c: F.when(F.col("problem").isNull(), c)
    return rows.withColumn("problem", problem).select("trial_id", "problem", fine(request).alias("request"), fine(parts).alias("parts"), fine(shown).alias("clip_ids"))


def _packed(batches):
    """The parts of texts in chunks of some CHUNK characters, compressed; rows come in order."""
    place, n, held, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("test", "lead", "text", "opens"))):
            if held and (size >= CHUNK or row[0] != held[0][0]):
                yield _chunk(place, n, held)
                n, held, size = n + 1, [], 0
            held.append(row)
            size += len(row[2])
    if held:
        yield _chunk(place, n, held)


def _chunk(place: int, n: int, rows: list[tuple[str | None, str, str, bool]]) -> pa.RecordBatch:
    text = rows[0][2] + "".join(("" if before[3] else row[1]) + row[2] for before, row in pairwise(rows))
    data = text.encode()
    values = (rows[0][0], place, n, len(rows), len(text), len(data), rows[0][1], rows[-1][3], pa.compress(data, "zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _CHUNK_TYPES)], _CHUNK_NAMES)


_CHUNK_NAMES = ("test", "place", "n", "parts", "characters", "size", "lead", "opens", "data")
_CHUNK_TYPES = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary())
_CHUNKS = "test string, place int, n int, parts bigint, characters bigint, size bigint, lead string, opens boolean, data binary"


def _digests(batches):
    """Running SHA-256 of the chunks of each test; they come sorted by test."""
    done = lambda: pa.RecordBatch.from_pydict({"test": pa.array([name], pa.string()), "parts": [parts], "characters": [characters], "sha256": [digest.hexdigest()]})
    name, digest, parts, characters, opened = None, None, 0, 0, True
    for batch in batches:
        for chunk in batch.to_pylist():
            if digest is None or chunk["test"] != name:
                if digest is not None:
                    yield done()
                name, digest, parts, characters, opened = chunk["test"], hashlib.sha256(), 0, 0, True
            lead = "" if opened else chunk["lead"]
            digest.update(lead.encode())
            digest.update(pa.decompress(chunk["data"], chunk["size"], "zstd"))
            parts, characters, opened = parts + chunk["parts"], characters + len(lead) + chunk["characters"], chunk["opens"]
    if digest is not None:
        yield done()


def text_digests(rows: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """Per test, how many parts its text has, its characters and its SHA-256. rows: test, lead
    (what parts it from the one before), text, opens (the next one has no lead), and what
    `order` needs.

    A digest of a sequence is handed on from part to part, so a test is one sequence in one
    task. What is wide is done before, range by range of the order: parts are sorted there and
    packed to compressed chunks; the one task sorts and reads only these."""
    placed = rows.select("test", "lead", "text", "opens", *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    by = ["test", *[f"_o{i}" for i in range(len(order))]]
    ranges = placed.repartitionByRange(partitions, *by) if partitions else placed.repartitionByRange(*by)
    packed = ranges.sortWithinPartitions(*by).select("test", "lead", "text", "opens").mapInArrow(_packed, _CHUNKS)
    dealt = packed.repartition("test").sortWithinPartitions("test", "place", "n")
    return dealt.mapInArrow(_digests, "test string, parts bigint, characters bigint, sha256 string")


def plan_digests(trials: DataFrame, requests: DataFrame, order: list[Column]) -> DataFrame:
    """Per test, how many requests its plan has and the SHA-256 of their texts, one after the
    other in plan order. trials: trial_id, test and what `order` needs; requests: trial_id,
    request (as `rendered` gives it; trials without one are left out).

    Texts are shuffled twice, by trial and by their place, to as many tasks as keep each at
    some `PER_TASK` of them."""
    partitions = max(int(trials.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-trials.count() // PER_TASK))
    texts = requests.filter("request is not null").select("trial_id", "request")
    rows = trials.repartition(partitions, "trial_id").join(texts.repartition(partitions, "trial_id"), "trial_id")
    rows = rows.withColumns({"lead": F.lit(""), "text": F.col("request"), "opens": F.lit(False)})
    return text_digests(rows, order, partitions).select("test", F.col("parts").alias("requests"), F.col("sha256").alias("requests_sha256"))


#: Token counts that providers report for parts of the input.
MODALITIES = ("text_tokens", "audio_tokens", "video_tokens", "image_tokens")
_BY_MODALITY = "struct<prompt_token_count:bigint,tool_use_prompt_token_count:bigint,candidates_token_count:bigint,thoughts_token_count:bigint,prompt_tokens_details:array<struct<modality:string,token_count:bigint>>>"
_BY_DETAILS = f"struct<prompt_tokens:bigint,completion_tokens:bigint,prompt_tokens_details:struct<{','.join(f'{m}:bigint' for m in MODALITIES)}>,completion_tokens_details:struct<reasoning_tokens:bigint>>"


def _parsed_once(report: Column, schema: str, counted) -> Column:
    """`counted` of a report that is parsed once for all its fields; null without one."""
    return F.transform(F.array(F.from_json(report, schema)), lambda u: F.when(u.isNotNull(), counted(u)))[0]


def usage_by_modality(report: Column) -> Column:
    """Token counts of a report (JSON text) that lists the input by modality; null without one."""

    def counted(u: Column) -> Column:
        count = lambda name: F.coalesce(u[name], F.lit(0))
        details = F.coalesce(u["prompt_tokens_details"], F.array())
        of = lambda kind: F.aggregate(F.filter(details, lambda d: F.upper(d["modality"]) == kind), F.lit(0).cast("bigint"), lambda s, d: s + F.coalesce(d["token_count"], F.lit(0)))
        thoughts = count("thoughts_token_count")
        return F.struct((count("prompt_token_count") + count("tool_use_prompt_token_count")).alias("input_tokens"), (count("candidates_token_count") + thoughts).alias("output_tokens"), of("TEXT").alias("text_tokens"), of("VIDEO").alias("video_tokens"), of("AUDIO").alias("audio_tokens"), thoughts.alias("thoughts_tokens"))

    return _parsed_once(report, _BY_MODALITY, counted)


def usage_by_details(report: Column) -> Column:
    """Token counts of a report (JSON text) with named details; what it doesn't name is null."""

    def counted(u: Column) -> Column:
        named = [u["prompt_tokens_details"][m].alias(m) for m in MODALITIES]
        return F.struct(F.coalesce(u["prompt_tokens"], F.lit(0)).alias("input_tokens"), F.coalesce(u["completion_tokens"], F.lit(0)).alias("output_tokens"), *named, u["completion_tokens_details"]["reasoning_tokens"].alias("reasoning_tokens"))

    return _parsed_once(report, _BY_DETAILS, counted)


def error_code(code: Column) -> Column:
    """A provider's error code without case, dots and underscores."""
    return F.translate(F.lower(code), "_.", "")
