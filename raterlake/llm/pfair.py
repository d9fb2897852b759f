"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of equally many documents and gets an integer weight out of
`PERIOD`. Its i-th block in a period (from 0) is released at floor(i * PERIOD / weight)
and due at ceil((i + 1) * PERIOD / weight); in every slot the released block that is due
first goes next, ties by the later of the next releases, then by name. Such a schedule
exists for every set of weights that adds up to the period and repeats each period, so
after any number of slots every source is less than one block away from its share.

Only the one period is worked out on the driver: its length is a parameter, or the number
of sources where there are more of these. Where a document goes follows from its source and
its place in it alone; a table of the sources' weights and slots is joined to the rows.
Places come from a seeded shuffle: documents are dealt to buckets of bounded size by hash,
buckets are counted range by range, and only rows within one bucket are numbered, so a
source that holds a third of all rows is spread over the cluster.

No row is dropped: when a source is used up its slots stay empty, and slots below
`horizon` (of every row the same) are those where no source has run out.

Defined results: null sources form one source of their own; repeated rows get places of
their own; sources without a given weight share what the named ones leave in proportion
to the square root of their blocks; an empty table gives an empty table; all columns of
the input are kept but for those that bear the name of an added one; the caller sets the
prefix of these names.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

PERIOD = 1000
BLOCK = 64
BUCKET = 4096
#: Buckets that are counted on together.
RANGE = 1024


def integer_weights(shares: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Shares as parts of the period by largest remainder, one at least for each."""
    if len(shares) > period:
        period = len(shares)
    total = sum(shares.values())
    exact = {k: max(v, 0) / total * (period - len(shares)) for k, v in shares.items()} if total > 0 else {k: (period - len(shares)) / len(shares) for k in shares}
    out = {k: 1 + math.floor(v) for k, v in exact.items()}
    short = period - sum(out.values())
    for k in sorted(exact, key=lambda k: (math.floor(exact[k]) - exact[k], k))[:short]:
        out[k] += 1
    return out


def schedule(weights: dict[str, int]) -> list[str]:
    """Which source each slot of one period goes to. Blocks wait in the slot of their release,
    then in a heap by deadline, so a slot costs the logarithm of the number of sources."""
    period, slots = sum(weights.values()), []
    released: list[list[tuple[str, int]]] = [[] for _ in range(period)]
    ready: list[tuple[int, bool, int, str, int]] = []
    for name in weights:
        released[0].append((name, 0))
    for slot in range(period):
        for name, i in released[slot]:
            w = weights[name]
            due = -((-(i + 1) * period) // w)
            heapq.heappush(ready, (due, (i + 1) * period % w == 0, -w, name, i))
        released[slot] = []
        _, _, w, name, i = heapq.heappop(ready)
        slots.append(name)
        if i + 1 < -w:
            released[min(max((i + 1) * period // -w, slot + 1), period - 1)].append((name, i + 1))
    return slots


def target_shares(blocks: dict[str, int], given: dict[str, float] | None = None) -> dict[str, float]:
    given = {k: v for k, v in (given or {}).items() if k in blocks}
    rest = {k: math.sqrt(n) for k, n in blocks.items() if k not in given}
    left = max(0.0, 1 - sum(given.values()))
    return given | {k: left * v / sum(rest.values()) for k, v in rest.items()}


def mix(docs: DataFrame, shares: dict[str, float] | None = None, block: int = BLOCK, period: int = PERIOD, seed: int = 0, prefix: str = "mix_") -> DataFrame:
    """The rows with all their columns and, prefixed: slot (of the block), place (in the
    block), block (of the source) and horizon."""
    rows = docs.select(F.struct("*").alias("whole"), F.coalesce("source", F.lit("\x00")).alias("source"))
    sizes = {r.source: r.n for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    blocks = {k: -(-n // block) for k, n in sizes.items()}
    weights = integer_weights(target_shares(blocks, shares), period) if blocks else {}
    order = schedule(weights)
    slots: dict[str, list[int]] = {k: [] for k in weights}
    for slot, name in enumerate(order):
        slots[name].append(slot)
    length = max(1, len(order))
    ends = [slots[k][(n - 1) % weights[k]] + length * ((n - 1) // weights[k]) + 1 for k, n in blocks.items()]

    n_buckets = max(1, -(-sum(sizes.values()) // BUCKET))
    lot = F.xxhash64(F.lit(seed), F.col("whole.doc_id"), F.col("whole.text"))
    rows = rows.withColumn("lot", lot).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "lot"), F.lit(n_buckets)))
    # rows before a bucket: those of the lots of buckets before its own, and those before it in there
    counts = rows.groupBy("source", "bucket").agg(F.count("*").alias("n")).withColumn("range", F.floor(F.col("bucket") / RANGE))
    earlier = lambda keys, order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = counts.groupBy("source", "range").agg(F.sum("n").alias("n")).select("source", "range", earlier(["source"], "range").alias("before_range"))
    counts = counts.select("source", "range", "bucket", earlier(["source", "range"], "bucket").alias("inside_range")).join(ranges, ["source", "range"])
    counts = counts.select("source", "bucket", (F.col("before_range") + F.col("inside_range")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("lot", "whole.doc_id")) - 1
    rows = rows.withColumn("inside", inside).join(counts, ["source", "bucket"])
    at = F.col("before") + F.col("inside")
    rows = rows.withColumn("block", F.floor(at / block).cast("long")).withColumn("place", (at % block).cast("int"))
    plan = docs.sparkSession.createDataFrame([(k, w, slots[k]) for k, w in weights.items()], "source string, weight int, slots array<int>")
    rows = rows.join(plan, "source")
    slot = F.floor(F.col("block") / F.col("weight")) * length + F.get("slots", (F.col("block") % F.col("weight")).cast("int"))
    added = [slot.cast("long").alias(f"{prefix}slot"), F.col("place").alias(f"{prefix}place"), F.col("block").alias(f"{prefix}block"), F.lit(min(ends, default=0)).cast("long").alias(f"{prefix}horizon")]
    names = {f"{prefix}{c}" for c in ("slot", "place", "block", "horizon")}
    return rows.select(*[F.col("whole").getField(c).alias(c) for c in docs.columns if c not in names], *added)
