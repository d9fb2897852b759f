"""Typed validation of study, test, price and instrument documents, thousands in one plan.

Documents are VARIANT values. A map of rules, one per field, says what each kind of document
holds; documents are walked level by level inside their row, and every value that breaks a
rule gives a row `field: reason`. There are as many levels as the rules are deep, whatever
the documents hold; the rules are a constant of this module.

Values are not coerced: an integer in quotes is a text. What holds between fields is judged
only where the fields themselves are sound."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: patterns of names, ids and amounts
NAME = r"^[a-z0-9][a-z0-9_]*$"
TEST_NAME = r"^[A-Za-z0-9][A-Za-z0-9_-]*$"
MODEL_ID = r"^m[1-9][0-9]*$"
CLIP_ID = r"^c_[a-z2-7]{8}$"
AMOUNT = r"^[0-9]+(\.[0-9]+)?$"
POSITIVE_AMOUNT = r"^(?=.*[1-9])[0-9]+(\.[0-9]+)?$"
URL = r"^https?://[^\s/?#]+[^\s]*$"
VARIABLE = r"^[A-Za-z_][A-Za-z0-9_]*$"
#: What is said of some patterns in place of the pattern.
SAID = {AMOUNT: 'must be a non-negative decimal string, for example "0.30"', POSITIVE_AMOUNT: 'must be a decimal string greater than 0, for example "4"'}


@dataclass(frozen=True)
class Rule:
    """A field by its path, in which `[]` stands for each element of a list and `{}` for each
    value of a mapping. kind: object, map, list, text, int, number, bool, value (text or int)
    or any. keys: pattern of a mapping's keys; unique: what the elements of a list are called
    that may not repeat; by: the field of an element that may not repeat."""

    path: str
    kind: str
    need: bool = False
    null: bool = False
    ge: float | None = None
    gt: float | None = None
    le: float | None = None
    lt: float | None = None
    pattern: str | None = None
    choices: tuple[str, ...] | None = None
    least: int | None = None
    most: int | None = None
    keys: str | None = None
    unique: str | None = None
    by: str | None = None


def _text(path: str, **more) -> Rule:
    return Rule(path, "text", **more)


def _rate(path: str, need: bool = False) -> Rule:
    return Rule(path, "number", need, ge=0, le=1)


_VERSION = Rule("schema_version", "int", True, choices=("1",))

# fixed values: the fields of each kind of document, in order
STUDY = (
    _VERSION,
    Rule("seed", "int", True, ge=0, lt=2**63),
    Rule("instruments", "list", True, unique="instrument"),
    _text("instruments[]", pattern=NAME),
    Rule("models", "list", True, least=1, unique="model id", by="id"),
    Rule("models[]", "object"),
    _text("models[].id", need=True, pattern=MODEL_ID),
    _text("models[].provider", need=True, choices=("fake", "gemini", "qwen")),
    _text("models[].model", need=True),
    Rule("models[].settings", "object"),
    Rule("models[].settings.temperature", "number", gt=0),
    Rule("models[].settings.fps", "number", null=True, gt=0),
    Rule("models[].settings.seed_supported", "bool"),
    _text("models[].settings.media_resolution", null=True, choices=("low", "medium", "high")),
    _text("models[].settings.thinking_level", null=True, choices=("minimal", "low", "medium", "high")),
    _text("models[].settings.base_url", null=True, pattern=URL),
    _text("models[].settings.reasoning_effort", null=True, pattern=r"\S"),
    _text("models[].settings.api_key_env", null=True, pattern=VARIABLE),
    Rule("models[].max_output_tokens", "int", True, gt=0),
    Rule("models[].limits", "object", True),
    Rule("models[].limits.max_seconds", "number", True, gt=0),
    Rule("models[].limits.max_bytes", "int", True, gt=0),
    Rule("models[].limits.inline_base64", "bool"),
    Rule("models[].fake", "object", null=True),
    Rule("models[].fake.input_tokens", "int", ge=0),
    Rule("models[].fake.output_tokens", "int", ge=0),
    *[_rate(f"models[].fake.{n}_rate") for n in ("invalid", "transient", "refusal", "fatal")],
    *[_text(f"models[].fake.{n}", choices=("random", "faithful", "unfaithful")) for n in ("fidelity", "perception")],
    Rule("media", "object"),
    *[Rule(f"media.{n}", "int", gt=0) for n in ("height", "video_kbps", "audio_kbps", "fps")],
    Rule("session", "object"),
    Rule("session.practice_clips", "int", ge=0),
    Rule("session.repeats", "int", ge=1),
    Rule("session.max_retries", "int", ge=0),
    _text("session.pairing", choices=("all_pairs",)),
    Rule("session.retry", "object"),
    Rule("session.retry.transient_retries", "int", ge=0),
    Rule("session.retry.backoff_initial_s", "number", ge=0),
    Rule("session.retry.backoff_max_s", "number", ge=0),
    Rule("concurrency", "int", ge=1),
    Rule("thresholds", "object", True),
    _rate("thresholds.persona_fidelity_min", True),
    _rate("thresholds.invalid_rate_max", True),
    Rule("thresholds.leak_tolerance", "object", True),
    Rule("thresholds.leak_tolerance.duration_s", "number", True, ge=0),
    Rule("thresholds.leak_tolerance.loudness_lufs", "number", True, ge=0),
    _rate("thresholds.perception_min"),
    Rule("personas", "object", True),
    Rule("personas.big_five", "any"),
    Rule("personas.nars_bands", "list", unique="band"),
    _text("personas.nars_bands[]", choices=("low", "high")),
    Rule("personas.quotas", "object", True),
    *[r for n in ("age_band", "gender", "cultural_region", "robot_experience") for r in (Rule(f"personas.quotas.{n}", "list", True, least=1, unique="level"), _text(f"personas.quotas.{n}[]"))],
    Rule("screening", "object"),
    Rule("screening.fidelity_repeats", "int", ge=1),
    _text("screening.nars_instrument", pattern=NAME),
)
TEST = (
    _VERSION,
    _text("test", need=True, pattern=TEST_NAME),
    _text("kind", need=True, choices=("pilot", "screening", "main")),
    Rule("instruments", "list", True, least=1, unique="instrument"),
    _text("instruments[]", pattern=NAME),
    Rule("models", "list", null=True, unique="model id"),
    _text("models[]", pattern=MODEL_ID),
    Rule("clips", "list", unique="clip"),
    _text("clips[]", pattern=CLIP_ID),
    Rule("practice", "list"),
    Rule("practice[]", "object"),
    _text("practice[].instrument", need=True, pattern=NAME),
    Rule("practice[].clips", "list", True, least=1, most=2),
    _text("practice[].clips[]", pattern=CLIP_ID),
    Rule("practice[].answer", "map", True),
    Rule("practice[].answer{}", "value"),
    Rule("session", "object"),
    Rule("session.practice_clips", "int", null=True, ge=0),
    Rule("session.repeats", "int", null=True, ge=1),
    Rule("session.max_retries", "int", null=True, ge=0),
    _text("session.pairing", null=True, choices=("all_pairs",)),
    Rule("checks", "list"),
    Rule("checks[]", "object"),
    _text("checks[].instrument", need=True, pattern=NAME),
    _text("checks[].item", need=True, pattern=NAME),
    Rule("checks[].clips", "list", True, least=1, most=2, unique="clip"),
    _text("checks[].clips[]", pattern=CLIP_ID),
    Rule("checks[].expected", "value", True),
)
PRICES = (
    _VERSION,
    Rule("models", "map", True, keys=MODEL_ID),
    Rule("models{}", "object"),
    _text("models{}.input_usd_per_mtok", need=True, pattern=AMOUNT),
    _text("models{}.output_usd_per_mtok", need=True, pattern=AMOUNT),
    _text("models{}.media_tokens_per_s", need=True, pattern=AMOUNT),
    _text("models{}.chars_per_token", need=True, pattern=POSITIVE_AMOUNT),
)
INSTRUMENT = (
    _VERSION,
    _text("name", need=True, pattern=NAME),
    _text("version", need=True, least=1),
    Rule("draft", "bool"),
    Rule("self_report", "bool"),
    _text("citation", null=True, least=1),
    _text("instructions", need=True, least=1),
    Rule("prompt_variants", "map", True),
    _text("prompt_variants{}", least=1),
    Rule("items", "list", True, least=1, unique="item id", by="id"),
    Rule("items[]", "object"),
    _text("items[].id", need=True, pattern=NAME),
    _text("items[].type", need=True, choices=("likert", "pairwise", "free_text")),
    _text("items[].text", need=True, least=1),
    Rule("items[].points", "int", null=True, ge=2, le=11),
    Rule("items[].anchors", "object", null=True),
    _text("items[].anchors.low", need=True, least=1),
    _text("items[].anchors.high", need=True, least=1),
    Rule("items[].options", "list", null=True),
    _text("items[].options[]", least=1),
    Rule("keys", "map", null=True),
    Rule("keys{}", "object"),
    _text("keys{}.construct", need=True, choices=("openness", "conscientiousness", "extraversion", "agreeableness", "neuroticism", "nars")),
    Rule("keys{}.reversed", "bool", True),
    _text("keys{}.subscale", null=True, choices=("s1", "s2", "s3")),
)
RULES: dict[str, tuple[Rule, ...]] = {"study": STUDY, "test": TEST, "prices": PRICES, "instrument": INSTRUMENT}


def _get(path: str, kind: str = "string") -> str:
    return f"try_variant_get(v, '$.{path}', '{kind}')"


def _has(path: str) -> str:
    found = f"try_variant_get(v, '$.{path}', 'variant')"
    return f"({found} is not null and not is_variant_null({found}))"


def _only(name: str, provider: str) -> tuple[str, str, str]:
    return "models[]", f"{_has('settings.' + name)} and {_get('provider')} <> '{provider}'", f"settings.{name}: only allowed for provider: {provider}"


_SELF = "try_variant_get(v, '$', 'string')"
_HOST = r"regexp_replace(regexp_extract(lower(" + _get("settings.base_url") + r"), '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\\.$', '')"
_TYPE = _get("type")
# fixed values: what holds between fields: path of the object, where it does not hold (SQL over the object v), the reason
BETWEEN: dict[str, tuple[tuple[str, str, str], ...]] = {
    "study": (
        ("models[].model", f"trim({_SELF}) = ''", "must be a pinned model version, not empty"),
        ("models[].model", f"lower(trim({_SELF})) like '%latest'", "is not pinned; name an exact model version"),
        ("models[]", f"{_has('fake')} and {_get('provider')} <> 'fake'", "fake: only allowed for provider: fake"),
        *[_only(n, "gemini") for n in ("fps", "media_resolution", "thinking_level")],
        *[_only(n, "qwen") for n in ("base_url", "reasoning_effort")],
        ("models[]", f"{_get('provider')} = 'qwen' and not {_has('settings.base_url')}", "settings.base_url: required for provider: qwen"),
        (
            "models[]",
            f"{_get('provider')} = 'qwen' and {_HOST} rlike '(^|[.])aliyuncs[.]com$' and ({_get('limits.max_bytes', 'long')} > 9900000 or not coalesce({_get('limits.inline_base64', 'boolean')}, true))",
            "limits: hosted qwen (Model Studio) takes a Clip only inline as a base64 string under 10 MB: set max_bytes <= 9900000 and inline_base64: true",
        ),
        *[("models[]", f"{_get('provider')} = 'fake' and try_variant_get(v, '$.settings.{n}', 'variant') is not null", f"settings.{n}: not allowed for provider: fake") for n in ("api_key_env", "seed_supported")],
        ("media.height", "try_variant_get(v, '$', 'long') % 2 = 1", "must be even (H.264 yuv420p needs an even frame height)"),
        ("session.retry", f"coalesce({_get('backoff_max_s', 'double')}, 60) < coalesce({_get('backoff_initial_s', 'double')}, 2)", "backoff_max_s must be at least backoff_initial_s"),
        *[(f"personas.quotas.{n}", "exists(try_variant_get(v, '$', 'array<string>'), x -> trim(x) = '')", "levels must be non-empty strings") for n in ("age_band", "gender", "cultural_region", "robot_experience")],
    ),
    "test": (
        ("models", "size(try_variant_get(v, '$', 'array<string>')) = 0", "must list at least one model id, or be omitted for all"),
        ("", f"size({_get('checks', 'array<variant>')}) > 0 and {_get('kind')} <> 'screening'", "checks: only allowed in a kind: screening Test"),
    ),
    "prices": (),
    "instrument": (
        ("prompt_variants", "not map_contains_key(try_variant_get(v, '$', 'map<string,variant>'), 'default')", "must contain a 'default' variant"),
        ("items[]", f"{_TYPE} = 'likert' and not {_has('points')}", "likert item needs 'points'"),
        ("items[]", f"{_TYPE} = 'likert' and not {_has('anchors')}", "likert item needs 'anchors' (low, high)"),
        *[("items[]", f"{_TYPE} = '{t}' and ({_has('points')} or {_has('anchors')})", f"{t} item takes no 'points' or 'anchors'") for t in ("pairwise", "free_text")],
        ("items[]", f"{_TYPE} = 'pairwise' and {_has('options')} and (size({_get('options', 'array<string>')}) <> 2 or get({_get('options', 'array<string>')}, 0) = get({_get('options', 'array<string>')}, 1))", "pairwise 'options' must be two distinct labels, e.g. [A, B]"),
        *[("items[]", f"{_TYPE} = '{t}' and {_has('options')}", f"{t} item takes no 'options'") for t in ("likert", "free_text")],
        ("items", "size(array_distinct(transform(try_variant_get(v, '$', 'array<variant>'), x -> try_variant_get(x, '$.type', 'string') = 'pairwise'))) > 1", "an Instrument is either all pairwise items or has none"),
        ("keys{}", f"{_get('construct')} = 'nars' and not {_has('subscale')}", "subscale: required for construct nars (s1, s2 or s3)"),
        ("keys{}", f"{_get('construct')} <> 'nars' and {_has('subscale')}", "subscale: only allowed for construct nars"),
        ("", "exists(map_keys(try_variant_get(v, '$.keys', 'map<string,variant>')), k -> not exists(try_variant_get(v, '$.items', 'array<variant>'), x -> try_variant_get(x, '$.id', 'string') = k))", "keys: not an item of this Instrument"),
        ("", "exists(map_keys(try_variant_get(v, '$.keys', 'map<string,variant>')), k -> exists(try_variant_get(v, '$.items', 'array<variant>'), x -> try_variant_get(x, '$.id', 'string') = k and try_variant_get(x, '$.type', 'string') <> 'likert'))", "keys: only likert items can be keyed"),
        ("", f"coalesce({_get('self_report', 'boolean')}, false) and exists(try_variant_get(v, '$.items', 'array<variant>'), x -> not coalesce(map_contains_key(try_variant_get(v, '$.keys', 'map<string,variant>'), try_variant_get(x, '$.id', 'string')), false))", "keys: a self_report Instrument must key every item"),
    ),
}


_FACTS = "pos:int,kind:string,nullable:boolean,ge:decimal(38,6),gt:decimal(38,6),le:decimal(38,6),lt:decimal(38,6),pattern:string,regex:string,said:string,choices:array<string>,least:int,most:int,keys:string,what:string,by:string,needs:array<struct<name:string,pos:int>>"

_NAMES = ("kind", "nullable", "ge", "gt", "le", "lt", "pattern", "regex", "said", "choices", "least", "most", "what", "by", "needs")


def _parent(path: str) -> str:
    """The path one level up."""
    return path[:-2] if path.endswith(("[]", "{}")) else path.rpartition(".")[0]


def _rules() -> Column:
    """The rules of a document's kind, a map from path to what holds there. It is a constant of
    the plan, so no row carries it."""
    out = None
    for doc_kind, listed in RULES.items():
        rules = (Rule("", "object"), *listed)
        found = {}
        for pos, r in enumerate(rules):
            needs = [{"name": c.path.rpartition(".")[2], "pos": i} for i, c in enumerate(rules) if c.need and c.path != r.path and _parent(c.path) == r.path]
            facts = {"pos": pos, "kind": r.kind, "nullable": r.null, "ge": r.ge, "gt": r.gt, "le": r.le, "lt": r.lt, "pattern": r.pattern, "regex": _to_the_end(r.pattern), "said": SAID.get(r.pattern), "choices": r.choices}
            found[r.path] = facts | {"least": r.least, "most": r.most, "keys": r.keys, "what": r.unique, "by": r.by, "needs": needs}
        held = F.from_json(F.lit(json.dumps(found)), f"map<string,struct<{_FACTS}>>")
        out = F.when(F.col("doc_kind") == doc_kind, held) if out is None else out.when(F.col("doc_kind") == doc_kind, held)
    return out


def _quoted(x: Column) -> Column:
    return F.concat(F.lit("'"), x, F.lit("'"))


def _listed(choices: Column) -> Column:
    """'a', 'b' or 'c'; numbers bare."""
    named = F.transform(choices, lambda c: F.when(c.rlike("^[0-9]+$"), c).otherwise(_quoted(c)))
    n = F.size(named)
    return F.when(n == 1, F.get(named, 0)).otherwise(F.concat(F.array_join(F.slice(named, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" or "), F.get(named, n - 1)))


def _number(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"\.?0+$", "")


def _to_the_end(pattern: str | None) -> str | None:
    """A pattern whose `$` is not content with a line break at the end."""
    return pattern[:-1] + r"\z" if pattern and pattern.endswith("$") else pattern


def _said(text: str, *parts: Column) -> Column:
    return F.format_string(text, *parts)


def _own_problem() -> Column:
    """What is wrong with a node by itself; null if nothing is."""
    shape, kind = F.col("shape"), F.col("kind")
    text, size = F.col("text"), F.size(F.try_variant_get("v", "$", "array<variant>"))
    whole, real = F.try_variant_get("v", "$", "decimal(38,0)"), F.try_variant_get("v", "$", "double")
    against = lambda holds, limit: F.when(shape == "INTEGER", holds(whole, F.col(limit))).otherwise(holds(real, F.col(limit).cast("double")))
    numeric = shape.isin("INTEGER", "NUMBER")
    typed = (
        F.when((kind == "object") & (shape != "OBJECT"), "input should be a mapping").when((kind == "map") & (shape != "OBJECT"), "input should be a valid dictionary").when((kind == "list") & (shape != "ARRAY"), "input should be a valid list")
        .when((kind == "text") & F.col("choices").isNull() & (shape != "STRING"), F.coalesce("said", F.lit("input should be a valid string"))).when((kind == "int") & F.col("choices").isNull() & (shape != "INTEGER"), "input should be a valid integer")
        .when((kind == "number") & ~numeric, "input should be a valid number").when((kind == "bool") & (shape != "BOOLEAN"), "input should be a valid boolean").when((kind == "value") & ~shape.isin("INTEGER", "STRING"), "input should be a text or an integer")
    )
    choice = F.col("choices").isNotNull() & ~(F.coalesce(F.array_contains("choices", text), F.lit(False)) & (shape == F.when(kind == "text", "STRING").otherwise("INTEGER")))
    length = F.when(kind == "text", F.char_length(text)).when(kind == "list", size)
    short, long = length < F.col("least"), length > F.col("most")
    items = lambda n: F.when(n == 1, "item").otherwise("items")
    limits = F.coalesce(*[
        F.when(numeric & F.col(limit).isNotNull() & against(holds, limit), _said(f"input should be {text_of} %s", _number(F.col(limit))))
        for limit, text_of, holds in (("ge", "greater than or equal to", lambda x, y: x < y), ("gt", "greater than", lambda x, y: x <= y), ("le", "less than or equal to", lambda x, y: x > y), ("lt", "less than", lambda x, y: x >= y))
    ])
    sizes = (
        F.when(short & (kind == "text"), _said("string should have at least %s character", F.col("least").cast("string"))).when(short, _said("list should have at least %s %s after validation, not %s", F.col("least").cast("string"), items(F.col("least")), length.cast("string")))
        .when(long, _said("list should have at most %s %s after validation, not %s", F.col("most").cast("string"), items(F.col("most")), length.cast("string")))
    )
    pattern = F.when(F.col("regex").isNotNull() & ~F.rlike(text, F.col("regex")), F.coalesce("said", F.concat(F.lit("string should match pattern "), _quoted(F.col("pattern")))))
    found = F.coalesce(typed, F.when(choice, F.concat(F.lit("input should be "), _listed(F.col("choices")))), limits, sizes, pattern)
    return F.when(~(F.col("nullable") & (shape == "VOID")), found)


def _repeated() -> Column:
    """The first element of a list, or of a field of its elements, that stood there before."""
    values = F.expr("transform(try_variant_get(v, '$', 'array<variant>'), x -> case when by is null then try_variant_get(x, '$', 'string') else try_element_at(try_variant_get(x, '$', 'map<string,string>'), by) end)")
    return F.get(F.filter(values, lambda x, i: F.array_position(values, x) < i + 1), F.lit(0))


def _shape(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, INTEGER, NUMBER, BOOLEAN or VOID. Integers are read as BIGINT, or as
    decimals where they have too many digits for that; 2.0 is read as a short decimal."""
    name = F.schema_of_variant(v)
    head = F.regexp_extract(name, "^[A-Z]+", 0)
    return F.when((head == "BIGINT") | name.rlike(r"^DECIMAL\((19|[23][0-9]),0\)$"), "INTEGER").when(head.isin("DECIMAL", "DOUBLE", "FLOAT"), "NUMBER").otherwise(head)


def _known(nodes: Column, rules: Column) -> Column:
    """The nodes with r, the rule of their path, and their place, which for members that have a
    name of their own is the rule's."""
    ruled = F.transform(nodes, lambda n: F.struct(n.alias("n"), F.try_element_at(rules, n["path"]).alias("r")))

    def placed(x: Column) -> Column:
        n = x["n"]
        at = F.when(n["named"], F.coalesce(x["r"]["pos"], F.lit(1 << 19) + n["at"])).otherwise(n["at"])
        return F.struct(n["field"].alias("field"), n["path"].alias("path"), F.concat(n["above"], F.array(at)).alias("place"), n["key"].alias("key"), n["v"].alias("v"), x["r"].alias("r"), n["keys"].alias("keys"))

    return F.transform(ruled, placed)


def _children(nodes: Column, rules: Column) -> Column:
    """The members, values and elements of the nodes that may have some. What is no object, or no
    list, has none, since it is read as null."""

    def of(n: Column) -> Column:
        kind, none = n["r"]["kind"], F.lit(None).cast("string")
        dotted = lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit("."), b))

        def child(field: Column, path: Column, at: Column, named: Column, key: Column, v: Column) -> Column:
            return F.struct(field.alias("field"), path.alias("path"), n["place"].alias("above"), at.alias("at"), named.alias("named"), key.alias("key"), v.alias("v"), n["r"]["keys"].alias("keys"))

        def member(e: Column, i: Column) -> Column:
            path = F.when(kind == "map", F.concat(n["path"], F.lit("{}"))).otherwise(dotted(n["path"], e["key"]))
            return child(dotted(n["field"], e["key"]), path, i, kind == "object", e["key"], e["value"])

        def element(x: Column, i: Column) -> Column:
            return child(dotted(n["field"], i.cast("string")), F.concat(n["path"], F.lit("[]")), i, F.lit(False), none, x)

        members = F.transform(F.map_entries(F.try_variant_get(n["v"], "$", "map<string,variant>")), member)
        elements = F.transform(F.try_variant_get(n["v"], "$", "array<variant>"), element)
        return F.when(kind.isin("object", "map"), members).when(kind == "list", elements)

    return _known(F.flatten(F.filter(F.transform(nodes, of), lambda x: x.isNotNull())), rules)


#: Places after those of all fields: unknown fields, repeated elements, what doesn't hold between fields.
_REPEATED, _BETWEEN = 1 << 20, 1 << 21


def problems(documents: DataFrame) -> DataFrame:
    """doc_id, field, reason and place (its order in the document, as an array) of everything
    that is wrong with documents (doc_id, which is their key, doc_kind, json as text). field is
    empty for the document as a whole. A text that is no JSON, or null, has one problem.

    Documents are spread by doc_id over all tasks, however few files or row groups they come
    from; a document is then taken apart and its problems brought together in the same task."""
    spread = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.filter(F.col("doc_kind").isin(*RULES)).select("doc_id", "doc_kind", "json").repartition(spread, "doc_id").select("doc_id", "doc_kind", F.try_parse_json("json").alias("v"))
    none, rules = F.lit(None).cast("string"), _rules()
    root = F.struct(F.lit("").alias("field"), F.lit("").alias("path"), F.array().cast("array<int>").alias("place"), none.alias("key"), F.col("v").alias("v"), F.try_element_at(rules, F.lit("")).alias("r"), none.alias("keys"))
    levels = docs.select("doc_id", "doc_kind", F.array(root).alias("l0"))
    deep = max(r.path.count(".") + r.path.count("[]") + r.path.count("{}") + 1 for rs in RULES.values() for r in rs)
    for i in range(deep):
        levels = levels.withColumn(f"l{i + 1}", _children(F.col(f"l{i}"), rules))
    nodes = levels.select("doc_id", "doc_kind", F.explode(F.concat(*[f"l{i}" for i in range(deep + 1)])).alias("n"))
    nodes = nodes.select("doc_id", "doc_kind", "n.field", "n.path", "n.place", "n.key", "n.v", _shape(F.col("n.v")).alias("shape"), F.col("n.keys").alias("key_pattern"), F.col("n.r").isNull().alias("unknown"), *[F.col("n.r")[c].alias(c) for c in _NAMES])
    # objects and lists would be written out as JSON
    nodes = nodes.withColumn("text", F.when(~F.col("shape").isin("OBJECT", "ARRAY"), F.try_variant_get("v", "$", "string")))
    nodes = nodes.withColumn("own", F.when(F.col("v").isNull(), "not a JSON document").when(F.col("unknown"), "extra inputs are not permitted").otherwise(_own_problem()))
    sound = F.col("own").isNull() & (F.col("shape") != "VOID")

    def problem(when: Column, reason: Column, place: Column, field: Column | None = None, later: bool = False) -> Column:
        return F.when(when, F.struct((F.col("field") if field is None else field).alias("field"), reason.alias("reason"), place.alias("place"), F.lit(later).alias("later")))

    last = lambda n: F.concat("place", F.array(F.lit(n)))
    below = lambda name: F.when(F.col("field") == "", name).otherwise(F.concat("field", F.lit("."), name))
    found = [problem(F.col("own").isNotNull(), F.col("own"), F.col("place"))]
    found.append(problem(F.col("key_pattern").isNotNull() & ~F.rlike("key", F.regexp_replace("key_pattern", r"\$$", r"\\z")), F.concat(F.lit("string should match pattern "), _quoted(F.col("key_pattern"))), last(-1)))
    again = _repeated()
    found.append(problem(sound & F.col("what").isNotNull() & again.isNotNull(), _said("duplicate %s '%s'", F.col("what"), again), last(_REPEATED), later=True))
    nothing = F.array().cast("array<struct<field:string,reason:string,place:array<int>,later:boolean>>")
    between = F.when(~sound, nothing)
    for doc_kind, listed in BETWEEN.items():
        for path in dict.fromkeys(path for path, _, _ in listed):
            wrong = [problem(F.expr(f"coalesce({wrong}, false)"), F.lit(reason), last(_BETWEEN + i), later=True) for i, (at, wrong, reason) in enumerate(listed) if at == path]
            between = between.when((F.col("doc_kind") == doc_kind) & (F.col("path") == path), F.array(*wrong))
    lost = F.filter("needs", lambda x: ~F.array_contains(F.col("members"), x["name"]))
    lost = F.when(F.col("members").isNotNull(), F.transform(lost, lambda x: F.struct(below(x["name"]).alias("field"), F.lit("field required").alias("reason"), F.concat("place", F.array(x["pos"])).alias("place"), F.lit(False).alias("later"))))
    every = F.filter(F.concat(F.array(*found), F.coalesce(between, nothing), F.coalesce(lost, nothing)), lambda x: x.isNotNull())
    nodes = nodes.withColumn("members", F.when(sound & (F.col("kind") == "object"), F.map_keys(F.try_variant_get("v", "$", "map<string,variant>"))))
    per = nodes.select("doc_id", F.explode(every).alias("p")).groupBy("doc_id").agg(F.collect_list("p").alias("all"))

    def stands(x: Column) -> Column:
        """What is judged later counts if nothing in it is wrong, and only the first such reason of an object."""
        inside = lambda f: (x["field"] == "") | (f == x["field"]) | f.startswith(F.concat(x["field"], F.lit(".")))
        return ~x["later"] | ~F.exists("all", lambda y: inside(y["field"]) & (~y["later"] | (y["field"] != x["field"]) | (y["place"] < x["place"])))

    return per.select("doc_id", F.explode(F.filter("all", stands)).alias("p")).select("doc_id", "p.field", "p.reason", "p.place")


def summaries(found: DataFrame) -> DataFrame:
    """doc_id and its problems as one text, in order, `field: reason` parted by `; `."""
    line = F.when(F.col("field") == "", F.col("reason")).otherwise(F.concat("field", F.lit(": "), "reason"))
    listed = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    return found.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "; ").alias("problem"))


def price_problems(studies: DataFrame, prices: DataFrame) -> DataFrame:
    """study, model_id, problem: models without a price and prices without a model. studies:
    study, model_id; prices: study, model_id."""
    both = studies.distinct().withColumn("a", F.lit(1)).join(prices.distinct().withColumn("b", F.lit(1)), ["study", "model_id"], "full_outer")
    said = F.when(F.col("b").isNull(), "field required (a Model of the study)").when(F.col("a").isNull(), "not a Model id of the study")
    return both.select("study", "model_id", said.alias("problem")).filter("problem is not null")


def reference_problems(listed: DataFrame, instruments: DataFrame, models_listed: DataFrame, models: DataFrame, practice: DataFrame) -> DataFrame:
    """test, place, code and field of what tests refer to wrongly, in the order it is found:
    instruments first, then models, then practice examples.

    listed: test, pos, instrument. instruments: name, enabled, self_report. models_listed: test,
    pos, model_id. models: model_id. practice: test, pos, instrument."""
    known = listed.join(instruments, listed.instrument == instruments.name, "left")
    code = F.when(F.col("name").isNull(), "unknown_instrument").when(F.col("self_report"), "instrument_not_allowed").when(~F.col("enabled"), "unknown_instrument")
    at = lambda group, field: [F.array(F.lit(group), F.col("pos")).alias("place"), F.concat(F.lit(f"{field}."), F.col("pos").cast("string")).alias("field")]
    one = known.select("test", *at(0, "instruments"), code.alias("code")).filter("code is not null")
    two = models_listed.join(models, "model_id", "left_anti").select("test", *at(1, "models"), F.lit("config_invalid").alias("code"))
    three = practice.join(listed.select("test", "instrument").distinct(), ["test", "instrument"], "left_anti").select("test", *at(2, "practice"), F.lit("unknown_instrument").alias("code"))
    return one.union(two).union(three).select("test", "place", "code", "field")
