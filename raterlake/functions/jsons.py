"""Canonical JSON and strict answer parsing.

Spark's JSON readers accept trailing text, repeated keys and constants that are no JSON,
so the strict parse runs in an Arrow-batched Python function; the checks on its result
are expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: one fenced block around an answer.
FENCED = re.compile(r"```[A-Za-z0-9_+-]*[ \t]*\n?(.*?)\n?[ \t]*```", re.DOTALL)


def canonical(value: object) -> str:
    """Sorted keys, no blanks, text unescaped, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _kind(v: object) -> str:
    if isinstance(v, bool) or v is None:
        return "other"
    return {int: "int", str: "string"}.get(type(v), "other")


def strict_answer(raw: str | None) -> tuple[str | None, list[tuple[str, str, str | None]] | None]:
    """A structural reason, or the (key, kind, value) entries of one JSON object."""
    if raw is None:
        return "not_json", None
    text = raw.strip()
    block = FENCED.fullmatch(text)
    if block:
        text = block[1].strip()
    seen: list[list[tuple[str, object]]] = []

    def pairs(found: list[tuple[str, object]]) -> dict:
        seen.append(found)
        return dict(found)

    try:
        value = json.loads(text, parse_constant=_no_constant, object_pairs_hook=pairs)
    except (ValueError, RecursionError):
        return "not_json", None
    if not isinstance(value, dict):
        return "not_object", None
    if len(seen[-1]) != len(value):  # the outermost object is closed last
        return "duplicate_item", None
    return None, [(k, _kind(v), str(v) if _kind(v) != "other" else None) for k, v in value.items()]


_ENTRY = T.StructType([T.StructField(c, T.StringType()) for c in ("key", "kind", "value")])


@F.pandas_udf(T.StructType([T.StructField("problem", T.StringType()), T.StructField("entries", T.ArrayType(_ENTRY))]))
def parsed(raw: pd.Series) -> pd.DataFrame:
    out = [strict_answer(r) for r in raw]
    return pd.DataFrame({"problem": [p for p, _ in out], "entries": [None if e is None else [{"key": k, "kind": t, "value": v} for k, t, v in e] for _, e in out]})


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Any JSON text in canonical form; null stays null."""
    return text.map(lambda t: None if t is None else canonical(json.loads(t)))


def stamp(text: Column) -> Column:
    """SHA-256 of the canonical form of a JSON text."""
    return F.sha2(canonical_json(text), 256)
