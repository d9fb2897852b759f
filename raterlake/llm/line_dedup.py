"""Line dedup with a suffix array over line-ID sequences, in SQL functions only.

Each document is the sequence of the IDs of its lines that hold a word.

1. Prefix doubling ranks the suffixes of all sequences: rank m orders them by their first
   2^m lines, and rank m + 1 follows from the pair of ranks at i and at i + 2^m. Ranks are
   given to distinct pairs, not to rows, by their place in a range partitioning, so no task
   orders all of them and a line that a third of all documents share is one pair. A suffix
   whose rank nobody shares leaves the race. The ranks of every round are kept.
2. The kept ranks are descended from the longest to the shortest, which takes the suffixes
   apart into longest-common-prefix intervals: an interval is a set of suffixes that share
   exactly n lines, each standing for those that share more with it. In the step of 2^m
   lines the members of an interval of n lines are grouped by rank m at i + n. Members of
   one rank make an interval of n + 2^m lines; the first of them (in order of doc_id and
   place) also stays behind to stand for the others. Each suffix but the very first of its
   line thus ends as a later member of one interval, whose n is the longest run of lines
   from there on that also starts earlier in the corpus. A suffix leaves once no repeated
   line follows its run.
3. These runs, where they have `min_lines` lines and `min_words` words at least, are merged
   within each document and deleted. The first appearance of a line is never deleted.

The only guard by default is `MIN_WORDS`: a run of fewer words in all (a lone heading or
`}`) stays. Line IDs are pairs of independent 64-bit hashes. Tables that grow with the data
are joined by sort and merge at every size, and no task holds more than the lines of one
document or the keys of one range.

Defined results: null texts stay as they are; lines without a word are never deleted and
don't part a run; rows with a null doc_id come last in order; equal rows (doc_id and
text) are treated as one sequence; an empty table gives an empty table; all columns of
the input are kept, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_LINES = 1
MIN_WORDS = 5
_LAST = (1 << 63) - 1
_SEQ = ["doc", "row_key"]
_PLACE = [*_SEQ, "pos"]
#: The first suffix of an interval, which with its number of lines names it.
_FIRST = ["first_doc", "first_key", "first_pos"]


def _has_word(line: Column) -> Column:
    return line.rlike(common.WORD_PATTERN)


def lines(docs: DataFrame) -> DataFrame:
    """doc, row_key, pos, id1, id2 and n_words of every line that holds a word."""
    rows = docs.filter("text is not null").select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), common.row_key().alias("row_key"), F.posexplode(F.filter(F.split("text", "\n"), _has_word)).alias("pos", "line"))
    return rows.select(*_PLACE, F.xxhash64("line").alias("id1"), F.xxhash64(F.lit("id2"), "line").alias("id2"), F.size(common.words("line")).alias("n_words"))


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that two suffixes share, with the first of them."""
    first, last = F.min(F.struct(*_PLACE)), F.max(F.struct(*_PLACE))
    found = rows.groupBy(*keys).agg(first.alias("first"), last.alias("last")).filter("first <> last")
    return found.select(*keys, *[F.col("first").getField(c).alias(f) for c, f in zip(_PLACE, _FIRST)])


def _ranked(rows: DataFrame, keys: list[str], scratch: common.Scratch) -> DataFrame | None:
    """The rows whose key is shared, with rank, the key's place in the order of all, and
    the first suffix that has it. None if no key is shared."""
    order = _shared(rows, keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranks = scratch.table(order.withColumn("next_rank", F.monotonically_increasing_id()))
    if ranks.isEmpty():
        return None
    out = rows.join(ranks.hint("merge"), keys).drop(*keys).withColumnRenamed("next_rank", "rank")
    return out.withColumn("later", F.struct(*_PLACE) != F.struct(*_FIRST))


def _repeated_lines(docs: DataFrame, scratch: common.Scratch) -> DataFrame | None:
    """Every suffix whose first line repeats: rank, room (repeated lines from it on, without
    a gap) and upto (words of the document's repeated lines up to and with its first). None
    if no line repeats."""
    rows = _ranked(lines(docs), ["id1", "id2"], scratch)
    if rows is None:
        return None
    rows = rows.repartition(*_SEQ).dropDuplicates(_PLACE)
    by_seq = Window.partitionBy(*_SEQ).orderBy("pos")
    rows = rows.withColumn("upto", F.sum("n_words").over(by_seq)).withColumn("island", F.col("pos") - F.row_number().over(by_seq))
    ends = F.max("pos").over(Window.partitionBy(*_SEQ, "island"))
    return scratch.table(rows.withColumn("room", (ends + 1 - F.col("pos")).cast("int")).drop("island"))


def suffix_ranks(docs: DataFrame, scratch: common.Scratch) -> list[DataFrame]:
    """For m = 0, 1, ...: the suffixes that share their first 2^m lines with another."""
    out, now, n = [], _repeated_lines(docs, scratch), 1
    while now is not None:
        out.append(now)
        after = Window.partitionBy(*_SEQ).orderBy("pos").rangeBetween(n, n)
        pairs = now.select(*_PLACE, "room", F.col("rank").alias("one"), F.max("rank").over(after).alias("two")).filter("two is not null")
        now = _ranked(pairs, ["one", "two"], scratch)
        now = None if now is None else scratch.table(now)
        n *= 2
    return out


def _open(rows: DataFrame) -> DataFrame:
    return rows.filter("n < room")


def _settled(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("n") >= F.col("room")) & (F.struct(*_PLACE) != F.struct(*_FIRST)))


def intervals(ranks: list[DataFrame], scratch: common.Scratch) -> DataFrame | None:
    """doc, row_key, pos, the first suffix of an interval and n: the run of n lines from pos
    on starts earlier, there, and no longer run does. Rows of one first suffix and n are the
    later members of one longest-common-prefix interval. None if no line repeats."""
    kind = [*_PLACE, "room", *_FIRST, "n"]
    members, done = None, []
    for m in reversed(range(len(ranks))):
        step = 1 << m
        new = ranks[m].select(*_PLACE, "room", *_FIRST, F.lit(step).alias("n"), "later")
        if m + 1 < len(ranks):
            new = new.join(ranks[m + 1].filter("later").select(*_PLACE).hint("merge"), _PLACE, "left_anti")
        new = new.select(*kind)
        if members is not None:
            able = members.filter(F.col("room") - F.col("n") >= step)
            there = ranks[m].select(*_SEQ, F.col("pos").alias("at"), F.col("rank"))
            able = able.withColumn("at", F.col("pos") + F.col("n")).join(there.hint("merge"), [*_SEQ, "at"], "left").drop("at")
            able = scratch.table(able)
            groups = able.filter("rank is not null").groupBy(*_FIRST, "n", "rank").agg(F.min(F.struct(*_PLACE)).alias("head"), F.max(F.struct(*_PLACE)).alias("last")).filter("head <> last").drop("last")
            able = able.join(groups.hint("merge"), [*_FIRST, "n", "rank"], "left")
            stays = F.when(F.col("head").isNull() | (F.col("head") == F.struct(*_PLACE)), F.struct(*_FIRST, "n"))
            goes = F.when(F.col("head").isNotNull(), F.struct(*[F.col("head").getField(c).alias(f) for c, f in zip(_PLACE, _FIRST)], (F.col("n") + step).alias("n")))
            able = able.select(*_PLACE, "room", F.explode(F.filter(F.array(stays, goes), lambda x: x.isNotNull())).alias("in")).select(*_PLACE, "room", "in.*")
            new = new.union(able.select(*kind)).union(members.filter(F.col("room") - F.col("n") < step))
        now = scratch.table(new)
        done.append(_settled(now))
        members = _open(now)
    if members is None:
        return None
    done.append(members.filter(F.struct(*_PLACE) != F.struct(*_FIRST)))
    return reduce(DataFrame.union, done).select(*_PLACE, *_FIRST, "n")


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame | None:
    """doc, row_key, lo, hi: the runs of lines (end exclusive) to delete, those that overlap
    or touch merged; None if no line repeats."""
    scratch = common.Scratch(docs.sparkSession)
    ranks = suffix_ranks(docs, scratch)
    found = intervals(ranks, scratch)
    if found is None:
        scratch.drop()
        return None
    words = ranks[0].select(*_PLACE, "n_words", "upto")
    last = words.select(*_SEQ, F.col("pos").alias("end"), F.col("upto").alias("upto_end"))
    found = found.filter(F.col("n") >= min_lines).withColumn("end", F.col("pos") + F.col("n") - 1)
    found = found.join(words.hint("merge"), _PLACE).join(last.hint("merge"), [*_SEQ, "end"]).filter(F.col("upto_end") - F.col("upto") + F.col("n_words") >= min_words)
    by_seq = Window.partitionBy(*_SEQ).orderBy("pos")
    reach = F.max("end").over(by_seq.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("opens", F.when(F.coalesce(reach, F.lit(-2)) + 1 < F.col("pos"), 1).otherwise(0))
    runs = runs.withColumn("run", F.sum("opens").over(by_seq)).groupBy(*_SEQ, "run").agg(F.min("pos").alias("lo"), (F.max("end") + 1).cast("int").alias("hi")).drop("run")
    out = common.materialise(runs)
    scratch.drop()
    return out


def marked(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """whole (the input row), n_lines (those with a word), n_removed and kept_text."""
    rows = docs.select(F.struct("*").alias("whole"))
    rows = rows.withColumn("doc", F.coalesce("whole.doc_id", F.lit(_LAST))).withColumn("row_key", common.row_key(text="whole.text"))
    runs = repeated_runs(docs, min_lines, min_words)
    if runs is None:
        rows = rows.withColumn("gone", F.lit(None).cast("array<int>"))
    else:
        gone = runs.groupBy("doc", "row_key").agg(F.flatten(F.collect_list(F.sequence("lo", F.col("hi") - 1))).alias("gone"))
        rows = rows.join(gone.hint("merge"), ["doc", "row_key"], "left")
    rows = rows.withColumn("all", F.split("whole.text", "\n"))
    rows = rows.withColumn("worded", F.filter(F.transform("all", lambda x, i: F.when(_has_word(x), i)), lambda i: i.isNotNull()))
    kept = common.let(F.col("all"), lambda a: F.transform(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.transform("gone", lambda g: F.get("worded", g))), lambda i: F.get(a, i)))
    text = F.when(F.col("gone").isNull(), F.col("whole.text")).otherwise(F.array_join(kept, "\n"))
    n_removed = F.coalesce(F.size(F.array_distinct("gone")), F.lit(0))
    return rows.select("whole", F.coalesce(F.size("worded"), F.lit(0)).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(n_removed).cast("long").alias("n_removed"), text.alias("kept_text"))


def remove_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows with all their columns, later copies cut from text (and n_chars set anew
    where it exists); rows that lost all their lines are left out."""
    rows = marked(docs, min_lines, min_words).filter("n_removed = 0 or n_removed < n_lines")
    cut = F.col("n_removed") > 0
    cols = []
    for c in docs.columns:
        value = F.col("whole").getField(c)
        if c == "text":
            value = F.when(cut, F.col("kept_text")).otherwise(value)
        elif c == "n_chars":
            value = F.when(cut, F.char_length("kept_text").cast(docs.schema[c].dataType)).otherwise(value)
        cols.append(value.alias(c))
    return rows.select(*cols)
