"""The archive and the ledger as streams.

The last line of a key wins, which dropDuplicates (it keeps the first) can't give; each
micro-batch is therefore folded into the state of its keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.numbers import total


def response_stream(spark: SparkSession, path: str, schema: str = "trial_id string, attempt int, category string, cost_usd decimal(38,12), at timestamp, line_no bigint") -> DataFrame:
    """JSON lines that appear in a folder."""
    return spark.readStream.schema(schema).json(path)


def last_wins(stream: DataFrame) -> DataFrame:
    """Per trial and attempt, the category and cost of the last line so far (update mode)."""
    last = F.max_by(F.struct("category", "cost_usd", "at"), "line_no")
    return stream.groupBy("trial_id", "attempt").agg(last.alias("r"), F.max("line_no").alias("line_no")).select("trial_id", "attempt", "line_no", "r.*")


def spend_by_window(stream: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Spend and lines per window of event time; later lines than the watermark are dropped."""
    return stream.withWatermark("at", late).groupBy(F.window("at", size)).agg(total(F.col("cost_usd")).alias("cost_usd"), F.count("*").alias("lines")).select("window.start", "window.end", "cost_usd", "lines")


def fold_into(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs what is there, batch by batch; `write` must replace the keys of a batch, so a
    batch that is run twice changes nothing."""
    return last_wins(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
