"""Is one table the same as another, and the digests that prove what was copied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsons


def differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """The rows that two tables with the same columns don't hold equally often, with more: by
    how many the first has more (negative: fewer). Order and nulls don't matter; no rows mean
    that the tables are equal. One shuffle, summed before it."""
    columns = one.columns
    both = one.select(*columns, F.lit(1).alias("_n")).union(other.select(*columns, F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("_n").alias("more")).filter("more <> 0")


def canonical(columns: list[str]) -> Column:
    """A row as canonical JSON: names in order, no blanks, nulls written."""
    return jsons.canonical_json(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))


def table_digest(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A digest of a table (or per group of `by`) that doesn't depend on the order of its rows.

    Rows are hashed on their own; the hashes, cut into 256 lots by their first byte, are
    hashed in order lot by lot, then the lots in order, so that no task meets all of them."""
    by = by or []
    hashed = rows.select(*by, F.sha2(canonical([c for c in rows.columns if c not in by]), 256).alias("h"))
    lots = hashed.groupBy(*by, F.substring("h", 1, 2).alias("lot")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("lot", "d"))), lambda x: x["d"])
    return lots.groupBy(*by).agg(F.sha2(F.array_join(listed, ""), 256).alias("digest"))


def source_hash(files: DataFrame, rows: DataFrame, order: str, by: list[str] | None = None) -> DataFrame:
    """SHA-256 of `{"panel": {file: sha256}, "results": [rows]}` as canonical JSON, per group of
    `by`. files: name, sha256. rows: the results in `order`, which itself is left out.

    The text holds a panel's files and screening results, as many as it has personas and
    models; each row becomes its JSON before they meet."""
    by = by or []
    columns = [c for c in rows.columns if c != order and c not in by]
    name = F.regexp_extract(canonical(["name"]), r'(?s)^\{"name":(.*)\}$', 1)
    one = files.select(*by, "name", F.concat(name, F.lit(':"'), "sha256", F.lit('"')).alias("t")).groupBy(*by).agg(_in_order("name", "t").alias("panel"))
    two = rows.select(*by, order, canonical(columns).alias("t")).groupBy(*by).agg(_in_order(order, "t").alias("results"))
    both = one.join(two, by, "left") if by else one.crossJoin(F.broadcast(two))  # one row each
    text = F.concat(F.lit('{"panel":{'), F.coalesce("panel", F.lit("")), F.lit('},"results":['), F.coalesce("results", F.lit("")), F.lit("]}"))
    return both.select(*by, F.sha2(text, 256).alias("source_hash"))


def _in_order(order: str, text: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), ",")


def copied_panel(frames: DataFrame, other: DataFrame, files: DataFrame, results: DataFrame, order: str) -> DataFrame:
    """One row: whether two studies' persona frames (any columns) hold the same rows, so that a
    panel may be copied, and the hash of what is copied; null where it may not."""
    same = differences(frames, other).agg((F.count("*") == 0).alias("same_frame"))
    both = same.crossJoin(F.broadcast(source_hash(files, results, order)))  # one row each
    return both.select("same_frame", F.when(F.col("same_frame"), F.col("source_hash")).alias("source_hash"))
