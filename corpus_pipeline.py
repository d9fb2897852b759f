"""A corpus pipeline of five stages over `documents`: language identification, line dedup,
near-duplicate removal, benchmark decontamination and mixing to target weights.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept;
all but the last return the columns of `documents`. Between stages the rows are written
to the shared folder and read again, so a lost executor costs at most one stage; what a
stage has read is removed once its own rows are written.

All stages: rows with a null text leave at language identification; rows with a null doc_id
and repeated rows take part as their operators state; an empty table gives an empty table;
extra columns of `documents` are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from raterlake.llm import common, decontam, langid, line_dedup, pfair, tjoin


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    return langid.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut out; documents without a line left go."""
    return line_dedup.remove_repeated_lines(docs)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return tjoin.keep_one(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.remove_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their slot in the mix of sources."""
    return pfair.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", join_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: Language identification is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark)
    docs = before = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs)
            if i:
                scratch.drop(before)
            before = docs
    return docs
