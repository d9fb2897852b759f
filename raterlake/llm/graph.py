"""Connected components of an undirected graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node that each node with an edge reaches.

    Alternates large-star and small-star steps: every node hands its smallest neighbour
    to the larger ones, then to the smaller ones, until only stars are left. Minima are
    pre-aggregated before each shuffle and the rounds grow with the logarithm of the
    longest path, so a long chain or a hub of millions needs no single task. Nulls and
    loops are ignored; no edges give no rows."""
    scratch = Scratch(edges.sparkSession)
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a is not null and b is not null and a <> b").distinct()
    e = scratch.table(e)
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a")
        new = scratch.table(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct())
        scratch.drop(e)
        e, was, state = new, state, _state(new)
        if state == was:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
