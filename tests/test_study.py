"""Reports and exports of a stored study."""

from __future__ import annotations

import csv
from decimal import Decimal
from pathlib import Path

import pytest

from raterlake.errors import EngineError
from raterlake.operators import export, study
from raterlake.sources import tables

ITEMS = [("rate", "warm", "likert", None, 0), ("rate", "kind", "likert", None, 1)]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    out = tables.study(spark)
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    out = tables.with_rows(out, "tests", make([("s1", "main", None), ("s2", "main", "ceiling")], "name string, kind string, paused_reason string"))
    trial = lambda n, state, persona: (f"t{n}", "s1", f"s1/{persona}-m1/r1", n, "rate", [f"c{n}"], 1, f"{persona}-m1", persona, "m1", state, 1)
    out = tables.with_rows(out, "trials", make([trial(1, "valid", "p1"), trial(2, "refused", "p2")], "trial_id string, test string, session_id string, trial_index int, instrument string, clip_ids array<string>, repeat int, agent_id string, persona_id string, model_id string, state string, attempt int"))
    out = tables.with_rows(out, "attempts", make([("t1", 1, 5, "ok", True, '{"kind":2,"warm":4}'), ("t2", 1, 6, "refused", None, None)], "trial_id string, attempt int, seed long, category string, valid boolean, answer_json string"))
    out = tables.with_rows(out, "ledger", make([("t1", 1, "m1", Decimal("0.5"), Decimal("0.25")), ("t2", 1, "m1", Decimal("0.5"), None)], "trial_id string, attempt int, model_id string, reserved_usd decimal(38,12), actual_usd decimal(38,12)"))
    out = tables.with_rows(out, "ceiling_changes", make([(1, Decimal("5")), (2, Decimal("10"))], "seq long, ceiling_usd decimal(38,12)"))
    out = tables.with_rows(out, "blinding_key", make([("c1", "speed", "fast", 1), ("c2", "speed", "slow", 2)], "clip_id string, factor string, level string, pos long"))
    out = tables.with_rows(out, "personas", make([(f"p{i}", {"openness": "high"}, "low", "x", "w", "e", "none") for i in (1, 2)], "id string, big_five map<string,string>, nars string, age_band string, gender string, cultural_region string, robot_experience string"))
    folder = str(tmp_path_factory.mktemp("study") / "s")
    tables.write(out, folder)
    return tables.read(spark, folder)


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "instrument string, item_id string, type string, options array<string>, pos int")


def test_status_report(store):
    got = study.status_report(store)
    assert tuple(got["footer"].first()) == (Decimal("0.75"), Decimal("10"), Decimal("9.25"))
    rows = {(r.test, r.model, r.agent): r for r in got["rollup"].collect()}
    assert rows[("s1", "*", "*")].trials == 2 and rows[("s2", "*", "*")].trials == 0 and rows[("s2", "*", "*")].paused == "ceiling"
    docs = {(r.test, r.agent): r.document for r in got["documents"].collect()}
    assert docs[("s1", "p2-m1")] == '{"planned":0,"sent":0,"valid":0,"invalid":0,"refused":1,"failed":0,"trials":1,"retried":0}'


def test_export_study(spark, store, tmp_path):
    for _ in range(2):  # a later export takes the place of the one before
        study.export_study(store, "s1", items(spark), str(tmp_path / "out"), single_file=True)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"] and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["attrition", "tidy"]
    [part] = (tmp_path / "out/tidy").glob("part-*")
    rows = list(csv.DictReader(part.open()))
    assert [(r["clip_id"], r["item"], r["response"], r["speed"], r["openness"], r["status"]) for r in rows] == [("c1", "warm", "4", "fast", "high", "valid"), ("c1", "kind", "2", "fast", "high", "valid"), ("c2", "warm", "", "slow", "high", "refused"), ("c2", "kind", "", "slow", "high", "refused")]


def test_a_failed_export_leaves_the_old_one(spark, store, tmp_path):
    from pyspark.sql import functions as F

    folder = str(tmp_path / "out")
    export.write_together(spark, {"a": spark.range(1)}, folder, True)
    with pytest.raises(Exception, match="no luck"):
        export.write_together(spark, {"a": spark.range(2), "b": spark.range(1).select(F.raise_error(F.lit("no luck")).cast("string").alias("x"))}, folder, True)
    assert [p.name for p in Path(folder).iterdir()] == ["a"] and [p.name for p in tmp_path.iterdir()] == ["out"] and spark.read.option("header", True).csv(f"{folder}/a").count() == 1


def test_unknown_references_are_refused(spark, store, tmp_path):
    with pytest.raises(EngineError, match="unknown_reference"):
        study.export_study(store, "s1", items(spark, [("other", "x", "likert", None, 0)]), str(tmp_path / "o"))
    with pytest.raises(EngineError, match="unknown_test"):
        study.export_study(store, "zz", items(spark), str(tmp_path / "o"))
