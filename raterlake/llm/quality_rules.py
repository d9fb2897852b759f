"""Quality rules by distribution divergence, in SQL functions only.

A document's histogram of character classes and its histogram of common words are held
against the references of its language by Jensen-Shannon distance (base 2, so from 0 to
1). Texts too short for a stable histogram are not judged by it.

* Common words of a language: the `N_COMMON` words of at most `COMMON_CHARS` characters
  that most of its documents hold. One more bin takes all other words.
* References: mean histograms of the language's documents that pass the base rules and
  are long enough. Counts cover all documents; word lists and references are tables with a
  row per language, joined to the documents.
* Documents without a lang form a language of their own.

Windows of eight words that repeat inside a text are found by hashes first; where hashes
repeat, the words themselves decide.

Defined results: a null text counts as empty, fails the base rule of 20 words and is not
kept; a language without a reference judges nothing, so its base verdict stands; repeated
rows are judged alike; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import let

N_COMMON = 32
COMMON_CHARS = 4
MIN_CHARS = 200
MIN_WORDS = 50
MAX_CHAR_DISTANCE = 0.22
MAX_WORD_DISTANCE = 0.62
WINDOW = 8
#: Languages whose word lists and references, some two kilobytes each, go to all tasks.
MAX_BROADCAST = 20_000
#: Peeled off one after the other, so each pattern meets what the earlier ones left.
CLASSES = [common.BLANK_PATTERN, r"[a-z]+", r"[A-Z]+", r"[\p{L}\p{M}]+", r"[0-9]+", r"[.,]+", r"[#*$%&|<>]+"]


def _met_twice(s: Column) -> Column:
    """Places i of the structs (s, i), sorted by s, whose s a neighbour shares; in order."""
    last = F.size(s) - 1
    twice = F.transform(s, lambda x, j: F.when(((j > 0) & (F.get(s, j - 1)["s"] == x["s"])) | ((j < last) & (F.get(s, j + 1)["s"] == x["s"])), x["i"]))
    return F.sort_array(F.filter(twice, lambda i: i.isNotNull()))


def repeated_words(w: Column, h: Column) -> Column:
    """Words of the array that lie in windows found twice or more. h: the hashes of the
    windows; where they repeat, the words themselves decide."""
    by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("s"), i.alias("i"))))
    windows = lambda p: F.sort_array(F.transform(p, lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("s"), i.alias("i"))))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda i, j: F.least(F.coalesce(F.get(p, j + 1) - i, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(windows(let(by_hash, _met_twice)), _met_twice), covered)


def _with_later(a: Column, step: int) -> Column:
    """Each value hashed with the one `step` places on."""
    return F.zip_with(a, F.slice(a, step + 1, F.size(a) + 1), lambda x, y: F.xxhash64(x, y))


def _window_hashes(w: Column) -> Column:
    """A hash of the WINDOW words from each place on, by doubling."""
    one = let(w, lambda a: _with_later(a, 1))
    two = let(one, lambda a: _with_later(a, 2))
    return let(two, lambda a: _with_later(a, 4))


def base_facts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, words, the base counts, character classes and base_failed."""
    df = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("t0"))
    df = df.withColumn("w", common.words("t0")).withColumn("t1", F.array_join("w", ""))  # leaves no blank
    for i, pattern in enumerate(CLASSES[1:], 1):
        df = df.withColumn(f"t{i + 1}", F.regexp_replace(f"t{i}", pattern, ""))
    left = [F.char_length(f"t{i}").cast("long") for i in range(len(CLASSES) + 1)]
    df = df.select("doc_id", "lang", "w", F.filter(F.split("t0", "\n"), lambda x: x.rlike(common.WORD_PATTERN)).alias("lines"), F.array(*[a - b for a, b in zip(left, left[1:])], left[-1]).alias("classes"), left[0].alias("n_chars"))
    df = df.withColumn("h", F.when(F.size("w") >= WINDOW, F.slice(_window_hashes(F.col("w")), 1, F.size("w") - (WINDOW - 1))))
    df = df.select(
        "doc_id", "lang", "w", "classes", "n_chars",
        F.size("w").cast("long").alias("n_words"),
        (F.col("n_chars") - F.col("classes")[0]).alias("word_chars"),
        F.col("classes")[6].alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) < F.size("h"), repeated_words(F.col("w"), F.col("h"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def common_words(docs: DataFrame) -> DataFrame:
    """lang and common: its words that most of its documents hold, ties by the word. Only the
    foremost of each partition are brought together to be ranked."""
    short = F.filter(common.words("text"), lambda x: F.char_length(x) <= COMMON_CHARS)
    seen = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.explode(F.array_distinct(F.transform(short, lambda x: F.lower(x)))).alias("word"))
    counted = seen.groupBy("lang", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counted.withColumn("rank", rank).filter(F.col("rank") <= N_COMMON)
    return top.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("common"))


def _with_language(rows: DataFrame, by_lang: DataFrame, n_langs: int) -> DataFrame:
    """The rows with what is known of their language, a row per language: handed to all tasks
    where there are so few that this is small, else shuffled."""
    return rows.join(F.broadcast(by_lang) if n_langs <= MAX_BROADCAST else by_lang, "lang", "left")


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of one length, each summing to 1."""
    term = F.zip_with(p, q, lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0) + F.when(b > 0, b * F.log2(2 * b / (a + b))).otherwise(0.0))
    return F.sqrt(F.greatest(F.aggregate(term, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: the base facts, char_distance, word_distance (null where not
    judged) and kept."""
    words = common.materialise(common_words(docs))
    n_langs = docs.select("lang").distinct().count()
    alphabet = [chr(0x41 + i) for i in range(N_COMMON)]
    signs = F.array(F.lit(""), *[F.lit(a) for a in alphabet])
    facts = _with_language(base_facts(docs), words, n_langs)
    marked = F.transform("w", lambda x: F.when(F.char_length(x) <= COMMON_CHARS, F.get(signs, F.array_position("common", F.lower(x)).cast("int"))))
    facts = facts.withColumn("signs", F.array_join(marked, ""))
    counts = [F.char_length("signs") - F.char_length(F.replace("signs", F.lit(a), F.lit(""))) for a in alphabet]
    facts = facts.withColumn("word_counts", F.array(*counts, F.col("n_words").cast("int") - F.char_length("signs")))
    facts = facts.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_chars", "classes", "word_counts")
    facts = common.materialise(facts)
    p = F.when(F.col("n_chars") >= MIN_CHARS, F.transform("classes", lambda x: x / F.col("n_chars")))
    q = F.when(F.col("n_words") >= MIN_WORDS, F.transform("word_counts", lambda x: x / F.col("n_words")))
    shares = facts.withColumn("p", p).withColumn("q", q)
    n_classes = len(CLASSES) + 1
    means = [F.avg(F.col("p")[i]).alias(f"p{i}") for i in range(n_classes)] + [F.avg(F.col("q")[i]).alias(f"q{i}") for i in range(N_COMMON + 1)]
    references = shares.filter("not base_failed").groupBy("lang").agg(*means)
    ref_p, ref_q = F.array(*[f"p{i}" for i in range(n_classes)]), F.array(*[f"q{i}" for i in range(N_COMMON + 1)])
    references = references.select("lang", F.when(F.col("p0").isNotNull(), ref_p).alias("ref_p"), F.when(F.col("q0").isNotNull(), ref_q).alias("ref_q"))
    judged = _with_language(shares, references, n_langs)
    out = judged.withColumn("char_distance", distance(F.col("p"), F.col("ref_p"))).withColumn("word_distance", distance(F.col("q"), F.col("ref_q")))
    far = (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return out.withColumn("kept", ~F.col("base_failed") & ~far).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance", "lang")
