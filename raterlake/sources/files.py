"""Text sources: the request archive, the blinding key, panels, cards and settings."""

from __future__ import annotations

import json
import uuid

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..schema import TABLES

ARCHIVE = "trial_id string, attempt int, seed bigint, model_id string, request_sha256 string, raw string, category string, ts string"


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _hadoop(spark, path)
    return fs.exists(at)


def scratch_folder(spark: SparkSession) -> str:
    """A name for a new folder in the one that the session shares with its executors; it goes when
    the session ends. Without `spark.checkpoint.dir` only a local session has such a folder."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise EngineError("no_shared_folder", "spark.checkpoint.dir is not set")
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/raterlake-{sc.applicationId}"
    path = f"{shared.rstrip('/')}/files-{uuid.uuid4().hex}"
    fs, at = _hadoop(spark, path)
    fs.deleteOnExit(at)
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows, written to a folder of their own in the shared one and read again; it goes when
    the session ends."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, pos, line, complete of every line of an append-only archive, a file or a
    folder of `append_archive`. line_no counts within the file, pos over all files in order of
    path, which for appended ones is the order of the appends. An unterminated last line is
    not complete: its writer was cut off. A missing archive has no lines.

    Files are split by byte ranges, so one of any size is read in parallel and no task holds
    more than a line. Lines are numbered inside each range as they are read; ranges are
    shifted by the lines of those before, of which there is a row per range."""
    if not exists(spark, path):
        return spark.createDataFrame([], "path string, line_no bigint, pos bigint, line string, complete boolean")
    text = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    lines = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    # the reader hands out the bytes of the lines as they are, so that they tell whether the last one was ended; a byte order mark is left out
    ranges = lines.groupBy("path", "range").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes"), F.max("size").alias("size"))
    order, before = Window.partitionBy("path").orderBy("range"), lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    files = ranges.groupBy("path").agg(F.sum("n").alias("in_file"), (F.max("size") - F.sum("bytes")).isin(-1, 2).alias("cut"))
    files = files.withColumn("before_file", F.coalesce(F.sum("in_file").over(before(Window.orderBy("path"))), F.lit(0)))
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(before(order)), F.lit(0))).join(files, "path").select("path", "range", "first", "before", "in_file", "before_file", "cut")
    out = lines.drop("size").join(F.broadcast(ranges), ["path", "range"]).withColumn("line_no", F.col("before") + F.col("id") - F.col("first"))
    return out.select("path", "line_no", (F.col("before_file") + F.col("line_no")).alias("pos"), "line", (~F.col("cut") | (F.col("line_no") < F.col("in_file") - 1)).alias("complete"))


def classified(lines: DataFrame) -> DataFrame:
    """Adds kind: `unterminated` (the last line of a writer that was cut off, which counts for
    nothing), `fragment` (no JSON), `corrupt` (JSON without a text trial_id and a whole
    attempt) or `record`, and the key and record of records."""
    value = F.expr("try_parse_json(line)")
    tid, attempt = F.expr("try_variant_get(try_parse_json(line), '$.trial_id', 'string')"), F.expr("try_variant_get(try_parse_json(line), '$.attempt', 'int')")
    typed = (F.expr("schema_of_variant(variant_get(try_parse_json(line), '$.trial_id', 'variant'))") == "STRING") & (F.expr("schema_of_variant(variant_get(try_parse_json(line), '$.attempt', 'variant'))") == "BIGINT")
    kind = F.when(~F.col("complete"), "unterminated").when(value.isNull(), "fragment").when(F.coalesce(typed, F.lit(False)), "record").otherwise("corrupt")
    rows = lines.withColumn("kind", kind)
    record = F.col("kind") == "record"
    return rows.withColumn("trial_id", F.when(record, tid)).withColumn("attempt", F.when(record, attempt))


def line_counts(lines: DataFrame) -> DataFrame:
    """Per file of an archive: its lines, and how many are records, fragments and corrupt."""
    kinds = [F.count(F.when(F.col("kind") == k, 1)).alias(f"{k}s" if k != "corrupt" else k) for k in ("record", "fragment", "corrupt", "unterminated")]
    return classified(lines).groupBy("path").agg(F.count("*").alias("lines"), *kinds)


def last_lines(rows: DataFrame) -> DataFrame:
    """The last record of each key, by path (where there is one), then line_no."""
    order = F.struct(*[c for c in ("path", "line_no") if c in rows.columns])
    records = rows.filter("kind = 'record'")
    keep = [c for c in records.columns if c not in ("trial_id", "attempt")]
    return records.groupBy("trial_id", "attempt").agg(F.max_by(F.struct(*keep), order).alias("r")).select("trial_id", "attempt", "r.*")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The winning records, typed. A corrupt line fails the read."""
    rows = classified(archive_lines(spark, path))
    bad = F.when(F.col("kind") == "corrupt", F.raise_error(F.concat(F.lit("archive_corrupt: line "), F.col("line_no").cast("string"))))
    rows = rows.withColumn("_bad", bad).filter("_bad is null").drop("_bad")
    return last_lines(rows).withColumn("record", F.from_json("line", ARCHIVE)).select("path", "line_no", "record.*")


def blinding_key(spark: SparkSession, path: str) -> DataFrame:
    """clip_id, factor, level of long CSV files, one row per clip and factor: the last line
    wins, by order of path and place in the file. A missing file has no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], "clip_id string, factor string, level string, pos bigint")
    rows = archive_lines(spark, path).filter("line_no > 0 and line <> ''")
    cells = rows.select("pos", F.from_csv("line", "clip_id string, factor string, level string", {"escape": '"'}).alias("r")).select("pos", "r.*")
    return cells.groupBy("clip_id", "factor").agg(F.max_by("level", "pos").alias("level"), F.max("pos").alias("pos"))


def panel(spark: SparkSession, path: str) -> DataFrame:
    """The personas of a JSON list; ids must be p1, p2, ... in order."""
    rows = spark.read.schema(TABLES["personas"]).option("multiLine", True).json(path)
    found = [r.id for r in rows.select("id").collect()]
    if found != [f"p{i + 1}" for i in range(len(found))]:
        raise EngineError("panel_invalid", "ids must be p1, p2, ... in order")
    return rows


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text and sha256 of the bytes of every file."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"))


class _Strict(yaml.SafeLoader):
    pass


def _mapping(loader: yaml.SafeLoader, node: yaml.MappingNode) -> dict:
    keys = [loader.construct_object(k, deep=True) for k, _ in node.value if k.tag != "tag:yaml.org,2002:merge"]
    if len(keys) != len(set(map(str, keys))):
        raise EngineError("config_invalid", f"repeated key near line {node.start_mark.line + 1}")
    loader.flatten_mapping(node)
    return {loader.construct_object(k, deep=True): loader.construct_object(v, deep=True) for k, v in node.value}


_Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, _mapping)


def settings(text: str) -> dict:
    """A YAML document; repeated keys are refused."""
    try:
        return yaml.load(text, Loader=_Strict)
    except yaml.YAMLError as err:
        raise EngineError("config_invalid", str(err)) from err


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("json", "problem")]))
def _as_json(text: pd.Series) -> pd.DataFrame:
    out = []
    for t in text:
        try:
            value = settings(t or "")
            problem = "file is empty" if value is None else None if isinstance(value, dict) else f"top level must be a mapping, got {type(value).__name__}"
        except EngineError as err:
            value, problem = None, f"invalid YAML: {str(err).removeprefix('config_invalid: ')}"
        # what JSON hasn't, as a date, becomes something that no rule of a field accepts
        out.append((None if problem else json.dumps(value, default=lambda x: [str(x)]), problem))
    return pd.DataFrame(out, columns=["json", "problem"])


def yaml_documents(texts: DataFrame) -> DataFrame:
    """The rows of texts (text and any others) with json, the YAML document as JSON for
    `documents.problems`, or problem, why there is none: it is empty, no YAML, repeats a key,
    or isn't a mapping. Documents are parsed in batches in the tasks."""
    return texts.withColumn("_d", _as_json("text")).select(*texts.columns, "_d.json", "_d.problem")


def instruments(spark: SparkSession, documents: list[dict]) -> DataFrame:
    """instrument, item_id, type, points, options, pos, construct, reversed, subscale of the
    items that instrument documents (name, items, keys) list."""
    rows = []
    for doc in documents:
        keys = doc.get("keys") or {}
        for pos, item in enumerate(doc["items"]):
            k = keys.get(item["id"], {})
            rows.append((doc["name"], item["id"], item["type"], item.get("points"), item.get("options"), pos, k.get("construct"), k.get("reversed"), k.get("subscale")))
    return spark.createDataFrame(rows, "instrument string, item_id string, type string, points int, options array<string>, pos int, construct string, reversed boolean, subscale string")


def append_archive(df: DataFrame, path: str) -> int:
    """Rows as JSON lines, added to an archive folder; nulls are written. Each append is a
    numbered folder of its own, so later ones sort after earlier ones; the number is given
    back. One writer appends at a time: the folder of another's number is refused."""
    spark = df.sparkSession
    fs, folder = _hadoop(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    number = max([int(n[7:]) for n in names if n.startswith("append-") and n[7:].isdigit()], default=0) + 1
    lines = df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode("errorifexists").text(f"{path.rstrip('/')}/append-{number:012d}")
    return number


def load_json(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError as err:
        raise EngineError("config_invalid", str(err)) from err
