"""Identifiers and the sort keys that go with them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def agent_id(persona: Column | str, model: Column | str) -> Column:
    return F.concat_ws("-", _c(persona), _c(model))


def session_id(test: Column | str, agent: Column | str, repeat: Column | str) -> Column:
    return F.concat(_c(test), F.lit("/"), _c(agent), F.lit("/r"), _c(repeat).cast("string"))


def trial_id(session: Column | str, index: Column | str) -> Column:
    return F.concat(_c(session), F.lit("/t"), _c(index).cast("string"))


def pair_id(instrument: Column | str, a: Column | str, b: Column | str) -> Column:
    return F.concat_ws(":", _c(instrument), F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b)))


def run_number(run_id: Column | str) -> Column:
    """n of `s<n>`; 0 for every other name."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(_c(run_id), r"^s([1-9][0-9]*)$", 1), F.lit("")), F.lit("9" * 18)), F.lit(0)).cast("bigint")


def persona_number(persona_id: Column | str) -> Column:
    """n of `p<n>` and `p<n>-m<n>`, null for other names."""
    return F.expr("bigint(null)") if persona_id is None else F.nullif(F.regexp_extract(_c(persona_id), r"^p([0-9]+)", 1), F.lit("")).cast("bigint")


def natural_key(text: Column | str) -> Column:
    """Orders digit runs as numbers and `*` before everything else: an array of structs,
    which Spark can sort by."""
    part = lambda p: F.struct(
        F.when(p == "*", -1).when(p.rlike("^[0-9]"), 0).otherwise(1).alias("kind"),
        F.when(p.rlike("^[0-9]"), F.lpad(p, 40, "0")).otherwise(F.lit("")).alias("number"),
        F.when(p.rlike("^[0-9]"), F.lit("")).otherwise(p).alias("text"),
    )
    return F.transform(F.regexp_extract_all(_c(text), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1)), part)


def test_name_problem(name: Column | str) -> Column:
    """Why a name can't be a test's; null if it can."""
    name = _c(name)
    return (
        F.when(name.isNull() | (name == ""), "empty")
        .when(F.length(name) > 64, "too_long")
        .when(~name.rlike(r"^[a-z0-9][a-z0-9_-]*$"), "bad_characters")
        .when(name.rlike(r"^s[1-9][0-9]*$"), "reserved_run_id")
        .when(name.endswith("-attrition"), "reserved_suffix")
    )


def condition_parts(text: Column | str) -> Column:
    """factor and level of `factor=level`, trimmed; null without `=` or with an empty side."""
    text = _c(text)
    at = F.instr(text, "=")
    factor, level = F.trim(F.substring(text, F.lit(1), at - 1)), F.trim(F.substring(text, at + 1, F.length(text)))
    return F.when((at > 0) & (factor != "") & (level != ""), F.struct(factor.alias("factor"), level.alias("level")))
