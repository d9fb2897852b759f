"""Do hidden conditions show in plain properties of the clips?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts

#: Metrics compared value by value, with the difference they allow.
EXACT = {"width": 0.0, "height": 0.0, "fps": 0.01}


def leak_report(key: DataFrame, clips: DataFrame, tolerance: dict[str, float]) -> DataFrame:
    """factor, metric, level, n, mean, max_diff, tolerance, flagged.

    Metrics of EXACT are compared clip by clip, the others by their means. The largest
    difference of two sets of values is that of their ends, so levels are summed first and
    only levels are joined; clips never meet clips."""
    tolerances = {m: EXACT.get(m, t) for m, t in tolerance.items()}
    metrics = list(tolerances)
    last = key.groupBy("clip_id", "factor").agg(F.max_by("level", "pos").alias("level"))
    values = last.join(clips.select("clip_id", *[F.col(m).cast("double").alias(m) for m in metrics]), "clip_id")
    long = values.unpivot(["factor", "level"], metrics, "metric", "x")
    per = long.groupBy("factor", "metric", "level").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    exact = F.col("metric").isin(*EXACT)
    # the largest difference to any other level follows from the two lowest and the two
    # highest ends among all levels of the factor
    low, high = F.when(exact, F.col("lo")).otherwise(F.col("mean")), F.when(exact, F.col("hi")).otherwise(F.col("mean"))
    per = per.withColumn("low", low).withColumn("high", high)
    ends = per.filter("low is not null").groupBy("factor", "metric").agg(F.min(F.struct("low", "level")).alias("first"), F.max(F.struct("high", "level")).alias("last"))
    other = per.filter("low is not null").join(ends, ["factor", "metric"])
    second = other.groupBy("factor", "metric").agg(F.min(F.when(F.col("level") != F.col("first.level"), F.col("low"))).alias("low2"), F.max(F.when(F.col("level") != F.col("last.level"), F.col("high"))).alias("high2"))
    full = per.join(ends, ["factor", "metric"], "left").join(second, ["factor", "metric"], "left")
    lowest = F.when(F.col("level") == F.col("first.level"), F.col("low2")).otherwise(F.col("first.low"))
    highest = F.when(F.col("level") == F.col("last.level"), F.col("high2")).otherwise(F.col("last.high"))
    diff = F.when(F.col("low").isNotNull(), F.greatest(F.col("high") - lowest, highest - F.col("low")))
    allowed = F.create_map(*[x for m, t in tolerances.items() for x in (F.lit(m), F.lit(float(t)))])[F.col("metric")]
    full = full.withColumn("max_diff", diff).withColumn("tolerance", allowed)
    return full.select("factor", "metric", "level", "n", "mean", "max_diff", "tolerance", F.coalesce(F.col("max_diff") > F.col("tolerance"), F.lit(False)).alias("flagged"))


def report_texts(report: DataFrame) -> DataFrame:
    """The report as it is written: numbers to four decimals, empty where there is none."""
    return report.select("factor", "metric", "level", *[texts.four_decimals(c).alias(c) for c in ("mean", "max_diff")])
