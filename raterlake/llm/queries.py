"""The registered queries of this subpackage, and the SQL that DuckDB can run for them.

Each query applies one operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, langid, line_dedup, nbsvm, periodic, pfair, pii, quality_rules, superkmer, tjoin, url_reputation, warc
from .common import held_out, let, table, words


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("whole.doc_id", (F.col("n_overlaps") > 0).alias("contaminated"), "item_ids")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.detect(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    outcomes = url_reputation.linked_outcomes(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return url_reputation.judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.marked(table(spark, sf_dir, "documents"))
    return out.select("whole.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = nbsvm.score(docs, nbsvm.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = superkmer.remove_repeated_windows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pfair.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "mix_slot", "mix_place", "mix_block", "mix_horizon")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tjoin.jaccard_groups(table(spark, sf_dir, "documents"), k=4, percent=85).select("doc_id", "n_shingles", "component_id")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, of which every tenth (by the hash of doc_id) repeats a stretch of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(w):
        n = F.greatest(F.size(w), F.lit(1))
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return let(F.struct(a.alias("a"), p.alias("p")), lambda s: F.transform(w, lambda x, i: F.when(i < s["a"], x).otherwise(F.get(w, s["a"] + F.pmod(i - s["a"], s["p"])))))

    return docs.select("doc_id", F.when(h % 10 == 0, F.array_join(let(words("text"), tail), " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.collapse_runs(with_planted_runs(table(spark, sf_dir, "documents")))

    def better(a, b):  # exact: length / period as a cross product; runs come by start, then period
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)

    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    out = out.withColumn("top", F.aggregate("runs", none, better))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"), F.col("top.period").alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_decontamination, op3_quality_rules, op4_pii, op5_url_filter, op6_line_dedup, op7_quality_classifier, op8_substring_dedup, op9_source_mixing, op10_ngram_jaccard_join, op11_periodic_runs, op12_source_divergence, op13_warc_pages, pipeline)}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return SQL
