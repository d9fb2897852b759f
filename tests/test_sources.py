"""Files, the store and streams."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from raterlake import schema
from raterlake.errors import EngineError
from raterlake.plans import driverdata as d, queries
from raterlake.sources import files, tables
from raterlake.streaming import archive as stream

from .conftest import SF


def test_archive_last_line_wins_and_fragments(spark, tmp_path):
    good = lambda n, raw: json.dumps({"trial_id": "x", "attempt": n, "raw": raw})
    (tmp_path / "a.jsonl").write_text("\n".join([good(1, "old"), '{"cut', good(2, "b"), good(1, "new"), good(3, "never ended")]))
    lines = files.classified(files.archive_lines(spark, str(tmp_path / "a.jsonl")))
    kinds = {r.line_no: r.kind for r in lines.collect()}
    assert kinds == {0: "record", 1: "fragment", 2: "record", 3: "record", 4: "unterminated"}
    counts = files.line_counts(files.archive_lines(spark, str(tmp_path / "a.jsonl"))).first()
    assert (counts.lines, counts.records, counts.fragments, counts.corrupt) == (5, 3, 1, 0)  # the end that was cut off counts for nothing
    got = {(r.trial_id, r.attempt): r.raw for r in files.read_archive(spark, str(tmp_path / "a.jsonl")).collect()}
    assert got == {("x", 1): "new", ("x", 2): "b"}


@pytest.mark.parametrize("split", [16, 100, 1000])
def test_archive_lines_over_many_ranges(spark, tmp_path, split):
    """Lines of a file that is split into ranges of bytes keep their places, whatever they hold."""
    rng = random.Random(split)
    folder, expected = tmp_path / "arch", []
    folder.mkdir()
    for name, end in (("a", b"\n"), ("b", b""), ("c", b"\n"), ("d", b"\n"), ("e", b"")):
        lines = [rng.choice([b"", "é🙂".encode() * rng.randint(0, 40), b"x" * rng.randint(0, 300), b'{"a": 1}\r']) for _ in range(rng.randint(1, 60))]
        lines = [b"\xef\xbb\xbf" + lines[0], *lines[1:]] if name == "d" else lines
        if name == "c":
            lines = []
        if not end and not lines[-1]:
            lines[-1] = b"tail"
        (folder / name).write_bytes(b"\n".join(lines) + end if lines else b"")
        expected += [(name, i, x.removeprefix(b"\xef\xbb\xbf").decode(), bool(end) or i < len(lines) - 1) for i, x in enumerate(lines)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = sorted(files.archive_lines(spark, str(folder)).collect(), key=lambda r: r.pos)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r.path.rsplit("/", 1)[1], r.line_no, r.line, r.complete) for r in rows] == expected
    assert [r.pos for r in rows] == list(range(len(expected)))


def test_missing_files_are_empty(spark, tmp_path):
    assert files.archive_lines(spark, str(tmp_path / "none")).count() == 0 and files.read_archive(spark, str(tmp_path / "none")).count() == 0
    assert files.blinding_key(spark, str(tmp_path / "none.csv")).count() == 0


@pytest.mark.parametrize("line", ['{"trial_id": 1, "attempt": 1}', '{"trial_id": "x", "attempt": "1"}', '{"trial_id": "x"}', "[1]", '{"trial_id": "x", "attempt": 1.5}'])
def test_archive_with_other_json_is_corrupt(spark, tmp_path, line):
    (tmp_path / "a.jsonl").write_text(line + "\n")
    with pytest.raises(Exception, match="archive_corrupt"):
        files.read_archive(spark, str(tmp_path / "a.jsonl")).collect()


def test_blinding_key_keeps_the_last_row(spark, tmp_path):
    (tmp_path / "k.csv").write_text("clip_id,factor,level\nc1,speed,slow\nc1,kind,a\nc1,speed,fast\n")
    got = {(r.clip_id, r.factor): r.level for r in files.blinding_key(spark, str(tmp_path / "k.csv")).collect()}
    assert got == {("c1", "speed"): "fast", ("c1", "kind"): "a"}
    (tmp_path / "q.csv").write_text('clip_id,factor,level\nc1,speed,"a ""b"", c"\nc2,speed,\\x\nc1,speed,last')
    assert {r.clip_id: r.level for r in files.blinding_key(spark, str(tmp_path / "q.csv")).collect()} == {"c1": "last", "c2": "\\x"}


def test_panel_ids(spark, tmp_path):
    person = lambda i: {"id": i, "big_five": {"openness": "high"}, "nars": None, "age_band": "x", "gender": "w", "cultural_region": "e", "robot_experience": "none"}
    (tmp_path / "ok.json").write_text(json.dumps([person("p1"), person("p2")]))
    (tmp_path / "bad.json").write_text(json.dumps([person("p1"), person("p3")]))
    assert files.panel(spark, str(tmp_path / "ok.json")).count() == 2
    with pytest.raises(EngineError, match="panel_invalid"):
        files.panel(spark, str(tmp_path / "bad.json"))


def test_settings(spark):
    assert files.settings("a: 1\nb: {c: [1, 2]}\n") == {"a": 1, "b": {"c": [1, 2]}}
    assert files.settings("x: &x {a: 1}\ny: {<<: *x, b: 2}\n")["y"] == {"a": 1, "b": 2}
    for text in ("a: 1\na: 2\n", "a: [1\n"):
        with pytest.raises(EngineError, match="config_invalid"):
            files.settings(text)
    doc = {"name": "i", "items": [{"id": "a", "type": "likert", "points": 5}], "keys": {"a": {"construct": "warm", "reversed": True}}}
    assert tuple(files.instruments(spark, [doc]).first()) == ("i", "a", "likert", 5, None, 0, "warm", True, None)


def test_texts_and_appends(spark, tmp_path):
    (tmp_path / "c.md").write_bytes("é\n".encode())
    row = files.whole_texts(spark, str(tmp_path / "c.md")).first()
    assert row.text == "é\n" and len(row.sha256) == 64
    df = spark.createDataFrame([("x", None)], "b string, a string")
    for _ in range(2):
        files.append_archive(df, str(tmp_path / "arch"))
    assert [r.value for r in spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "arch")).collect()] == ['{"a":null,"b":"x"}'] * 2


def test_later_appends_win(spark, tmp_path):
    for i, raw in enumerate(("old", "middle", "new")):
        df = spark.createDataFrame([("t1", 1, raw), (f"t{i + 2}", 1, "own")], "trial_id string, attempt int, raw string")
        assert files.append_archive(df, str(tmp_path / "arch")) == i + 1
    got = {r.trial_id: r.raw for r in files.read_archive(spark, str(tmp_path / "arch")).collect()}
    assert got == {"t1": "new", "t2": "own", "t3": "own", "t4": "own"}


def test_tables_of_a_study(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(list(rows), "clip_id string, duration_s double")
    t = tables.study(spark, clips=make(("c1", 1.0)))
    after = tables.with_rows(t, "clips", make(("c2", 2.0)))
    assert t["clips"].count() == 1 and after["clips"].count() == 2 and tables.exists(after, "clips", "clip_id = 'c2'") and not tables.exists(t, "tests")
    assert after["clips"].schema == schema.TABLES["clips"]
    for bad in (make(("c1", 1.0)), make(("c9", 1.0), ("c9", 2.0))):
        with pytest.raises(EngineError, match="duplicate_key"):
            tables.with_rows(t, "clips", bad)
    with pytest.raises(EngineError, match="unknown_table"):
        tables.with_rows(t, "nope", make(("c1", 1.0)))
    assert [r.clip_id for r in tables.scan(after, "clips", ["c2", "c7"]).collect()] == ["c2"] and tables.scan(after, "clips").count() == 2
    assert [r.clip_id for r in tables.scan(after, "clips", make(("c1", 0.0), ("c1", 0.0))).collect()] == ["c1"]
    tables.write(after, str(tmp_path / "s"))
    again = tables.read(spark, str(tmp_path / "s"))
    assert again["clips"].count() == 2 and again["tests"].count() == 0 and set(again) == set(schema.TABLES)
    assert tables.read(spark, str(tmp_path / "none"))["clips"].count() == 0
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write(t, str(tmp_path / "s"))
    assert set(schema.documents()) == set(schema.TABLES)


def test_stream_equals_batch(spark, tmp_path):
    rows = [("x", 1, "transient", "1.5", "2026-01-01T00:10:00Z", 0), ("x", 1, "ok", "2.5", "2026-01-01T00:20:00Z", 3), ("y", 1, "ok", "4", "2026-01-01T02:00:00Z", 2)]
    names = ("trial_id", "attempt", "category", "cost_usd", "at", "line_no")
    (tmp_path / "in").mkdir()
    state: dict = {}

    def write(batch, _):
        for r in batch.collect():
            state[(r.trial_id, r.attempt)] = (r.category, float(r.cost_usd))

    for i, part in enumerate((rows[:1], rows[1:])):
        (tmp_path / f"in/{i}.json").write_text("".join(json.dumps(dict(zip(names, r))) + "\n" for r in part))
        stream.fold_into(stream.response_stream(spark, str(tmp_path / "in")), write, str(tmp_path / "cp")).awaitTermination()
    assert state == {("x", 1): ("ok", 2.5), ("y", 1): ("ok", 4.0)}
    q = stream.spend_by_window(stream.response_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("spend").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((float(r.cost_usd), r.lines) for r in spark.table("spend").collect()) == [(4.0, 1), (4.0, 2)]


def test_lines_are_numbered_where_they_are_read(spark, tmp_path):
    (tmp_path / "a").write_text("x\ny\n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = files.archive_lines(spark, str(tmp_path))
        plan = lines._jdf.queryExecution().executedPlan().toString()
        found = [(r.pos, r.line) for r in lines.collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(found) == [(0, "x"), (1, "y")]
    # ranges go to the lines: a shuffle would bring ranges of 128 MB together in one task
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan.split("BroadcastHashJoin")[0]


def test_places_are_counted_without_a_set_of_them(spark):
    out = queries.archive_fragments(spark, SF)
    [placed] = [r for r in out.collect() if r.kind == "placed"]
    assert placed.lines == placed.characters + 1 == d.attempts(spark, SF).count()
    assert "count(distinct" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
