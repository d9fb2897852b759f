"""Explicit schemas of the study tables; nothing is inferred from data."""

from __future__ import annotations

import json

from pyspark.sql import types as T

LAYOUT_VERSION = 1

#: The life cycle of a trial, in order, and where it ends.
TRIAL_STATES = ("planned", "sent", "valid", "invalid", "refused", "failed")
TERMINAL_STATES = ("valid", "invalid", "refused", "failed")
RUNNING_STATES = ("planned", "sent")
#: Counters of the attrition reports.
ATTRITION_COUNTS = ("trials", "invalid", "refused", "failed", "failed_fatal", "failed_transient", "failed_exhausted")
#: The five traits, the most significant bit of a profile first.
TRAITS = ("openness", "conscientiousness", "extraversion", "agreeableness", "neuroticism")

MONEY = "decimal(38,12)"


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()), "map<string,string>": T.MapType(T.StringType(), T.StringType()), MONEY: T.DecimalType(38, 12),
}


def _schema(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split(" ") for c in columns.split(", "))])


TABLES: dict[str, T.StructType] = {
    "clips": _schema("clip_id string, sha256 string, duration_s double, size_bytes bigint, width int, height int, fps double, loudness_lufs double, pushed_at timestamp"),
    "tests": _schema("name string, kind string, path string, sha256 string, openable boolean, registered_at timestamp, paused_reason string"),
    "test_clips": _schema("test string, clip_id string, role string"),
    "trials": _schema("trial_id string, test string, session_id string, trial_index int, instrument string, clip_ids array<string>, pair_id string, position int, prompt_variant string, order_seed bigint, repeat int, agent_id string, persona_id string, model_id string, state string, attempt int, seq bigint"),
    "attempts": _schema("trial_id string, attempt int, seed bigint, handle string, sent_at timestamp, answered_at timestamp, category string, valid boolean, invalid_reason string, answer_json string"),
    "ledger": _schema(f"trial_id string, attempt int, model_id string, reserved_usd {MONEY}, actual_usd {MONEY}"),
    "ceiling_changes": _schema(f"seq bigint, ts timestamp, previous_usd {MONEY}, ceiling_usd {MONEY}, test string, command string"),
    "screening_runs": _schema("run_id string, kind string, screening_test string, started_at timestamp, status string, superseded_by string, settings_hashes map<string,string>, instrument_hash string"),
    "screening_results": _schema("pos bigint, run_id string, model_id string, agent_id string, instrument string, outcome string, score double, threshold double, settings_hash string, instrument_hash string, detail string, pair_checks int, source_study string, source_hash string"),
    "screening_exclusions": _schema("test string, agent_id string, persona_id string, model_id string, instrument string, reason string"),
    "screening_stamps": _schema("test string, model_id string, instrument string, settings_hash string, instrument_hash string, runs array<string>"),
    "blinding_key": _schema("clip_id string, factor string, level string, pos bigint"),
    "personas": _schema("id string, big_five map<string,string>, nars string, age_band string, gender string, cultural_region string, robot_experience string"),
}

#: Columns that identify a row of each table.
KEYS = {
    "clips": ["clip_id"],
    "tests": ["name"],
    "test_clips": ["test", "clip_id"],
    "trials": ["trial_id"],
    "attempts": ["trial_id", "attempt"],
    "ledger": ["trial_id", "attempt"],
    "ceiling_changes": ["seq"],
    "screening_runs": ["run_id"],
    "screening_results": ["run_id", "instrument", "model_id", "agent_id"],
    "screening_exclusions": ["test", "agent_id"],
    "screening_stamps": ["test", "model_id", "instrument"],
    "personas": ["id"],
}


def documents() -> dict[str, dict]:
    """The schemas as JSON documents, by table, with the layout version."""
    return {name: {"layout_version": LAYOUT_VERSION, "schema": json.loads(schema.json())} for name, schema in TABLES.items()}
