"""Study tables as DataFrames: explicit schemas, keys that may not repeat, Parquet folders.

A study is a dict of its tables. What changes it takes such a dict and gives a new one, so a
change that is refused has changed nothing; writing is left to the caller, who writes a study
as a whole to a new folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..schema import KEYS, TABLES
from . import files

Study = dict[str, DataFrame]


def _conform(df: DataFrame, table: str) -> DataFrame:
    """The columns of the table in order and type; missing ones are null."""
    if table not in TABLES:
        raise EngineError("unknown_table", table)
    cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table].fields]
    return df.select(*cols)


def study(spark: SparkSession, **given: DataFrame) -> Study:
    """All tables of a study, the ones not given empty."""
    out = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
    for name, df in given.items():
        out = with_rows(out, name, df)
    return out


def with_table(t: Study, table: str, rows: DataFrame) -> Study:
    """The study with other rows in a table; refused if keys repeat."""
    rows, key = _conform(rows, table), KEYS.get(table)
    if key:
        twice = rows.groupBy(*key).count().filter("count > 1").first()
        if twice is not None:
            raise EngineError("duplicate_key", f"{table}: {twice.asDict()}")
    return {**t, table: rows}


def with_rows(t: Study, table: str, rows: DataFrame) -> Study:
    """The study with rows added to a table; refused if keys repeat among all of them."""
    new = _conform(rows, table)
    return with_table(t, table, t[table].union(new))


def exists(t: Study, table: str, predicate: str = "true") -> bool:
    return not t[table].filter(predicate).isEmpty()


def scan(t: Study, table: str, ids: list[str] | DataFrame | None = None, column: str = "clip_id") -> DataFrame:
    """A table, of the rows with the listed ids only if there is a list (or a DataFrame of the
    column, which is joined)."""
    if ids is None:
        return t[table]
    if isinstance(ids, DataFrame):
        return t[table].join(ids.select(column), column, "left_semi")
    return t[table].filter(F.col(column).isin(*ids))


def write(t: Study, folder: str) -> None:
    """Every table as Parquet in a folder that isn't there yet."""
    for name, df in t.items():
        df.write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/{name}")


def read(spark: SparkSession, folder: str) -> Study:
    """The tables of a folder; those that aren't there are empty, columns that a file lacks null."""
    at = lambda name: f"{folder.rstrip('/')}/{name}"
    return {name: spark.read.schema(schema).parquet(at(name)) if files.exists(spark, at(name)) else spark.createDataFrame([], schema) for name, schema in TABLES.items()}
