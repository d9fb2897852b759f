"""Source divergence audit by integer-dictionary encoding.

For each language, how far the word use of each source lies from every other source, and
by which terms a source stands out from its language. Shares are smoothed and scaled to
integers, so sums and ties are exact.

* Terms become integers in each chunk of rows: its distinct terms are sorted, every term
  gets its place among them, and a bincount per (lang, source) group leaves one row per
  group and term. These are summed before and after one shuffle.
* The kept terms of all languages are sorted by range and numbered, so ids preserve UTF-8
  order. Terms of one language whose ids share the higher bits are a chunk of at most
  `CHUNK` terms; a chunk's counts are a dense matrix, sources by terms, in one task.
* A chunk task finds its ids by searchsorted, adds up the divergence of every two sources
  and keeps the ten strongest terms of each source; sums and final ranks are Spark
  aggregates over those. Beyond `SOURCES` sources a language is cut into blocks of sources,
  and every two blocks meet in a task of their own, so no task grows with the corpus, the
  vocabulary or the number of sources.

The result has a row for every ordered pair of sources of a language; that is its size.

Defined results: null lang, source or text count as empty; rows are documents, whatever
their doc_id, so repeated rows count as often as they stand there; a group without terms
has smoothed shares only; a language without kept terms has pairs of value 0 and no terms; a
language with one source has no pairs; an empty table gives an empty table; other columns
are not read. Exact for up to 9 * 10^15 term occurrences in a language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, kernels

MIN_DOCS = 10
TOP = 10
#: Terms of a chunk (a power of two) and sources of a block.
CHUNK = 1 << 14
SOURCES = 64
#: Shares are parts of this, one step being three decimals.
SCALE_STEPS = 3

_OTHER = np.ones(256, dtype=bool)
_OTHER[0x80:] = False
_OTHER[0x41:0x5B] = False
_OTHER[0x61:0x7B] = False


def _groups_of(chunk: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The group of each row, and a row of each group."""
    lang, source = (chunk.column(c).dictionary_encode().indices.to_numpy() for c in ("lang", "source"))
    _, first, group = np.unique(lang.astype(np.int64) * chunk.num_rows + source, return_index=True, return_inverse=True)
    return group, first


def _count(batches):
    for chunk in kernels.chunks(batches):
        data, off = kernels.utf8(chunk.column("text"))
        w = kernels.find_words(kernels.lower_ascii(data), off, _OTHER)
        if not len(w.start):
            continue
        codes = kernels.pick(w, np.arange(len(w.start))).dictionary_encode()
        order = pc.array_sort_indices(codes.dictionary)
        terms, place = codes.dictionary.take(order), np.empty(len(order), dtype=np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        ids = place[codes.indices.to_numpy()]
        per_doc, n = np.unique(w.row * len(terms) + ids, return_counts=True)
        group, rows = _groups_of(chunk)
        key, at = np.unique(group[per_doc // len(terms)] * len(terms) + per_doc % len(terms), return_inverse=True)
        occurrences, docs = np.bincount(at, weights=n).astype(np.int64), np.bincount(at)
        texts = terms.cast(pa.large_string()).cast(pa.string())
        for i in range(0, len(key), 1 << 16):
            part = slice(i, i + (1 << 16))
            of = pa.array(rows[key[part] // len(terms)])
            yield pa.RecordBatch.from_arrays(
                [chunk.column("lang").take(of), chunk.column("source").take(of), texts.take(pa.array(key[part] % len(terms))), pa.array(occurrences[part]), pa.array(docs[part])],
                names=["lang", "source", "term", "n", "docs"],
            )


def shares(counts: np.ndarray, total: np.ndarray, n_terms: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / (total + 2 * n_terms)), digit by digit, so that nothing overflows."""
    rest, out, whole = counts + 2, np.zeros_like(counts), total + 2 * n_terms
    for _ in range(SCALE_STEPS):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _compare(top: int):
    def compare(key, table):
        """key: lang, chunk, one block of sources and another. Rows with place -1 name the sources."""
        lang, chunk, one, other = (k.as_py() for k in key)
        place = table.column("place").to_numpy()
        heads, cells = table.filter(pa.array(place < 0)), table.filter(pa.array(place >= 0))
        if not heads.num_rows:
            return _FOUND.empty_table()
        heads = heads.take(pc.sort_indices(heads, [("source", "ascending")]))
        names, size, n_terms = heads.column("source").combine_chunks(), heads.column("size")[0].as_py(), heads.column("n_terms")[0].as_py()
        ids = pc.index_in(cells.column("source").combine_chunks(), names).to_numpy(zero_copy_only=False).astype(np.int64)
        base = heads.column("base")[0].as_py()
        place, n = cells.column("place").to_numpy() - base, cells.column("n").to_numpy()
        counts = np.zeros((len(names), size), dtype=np.int64)
        counts[ids, place] = n
        p = shares(counts, heads.column("group_n").to_numpy()[:, None], n_terms)
        block = heads.column("block").to_numpy()
        a, b, values, places = [], [], [], []
        for i in np.flatnonzero(block == one).tolist():
            partners = np.flatnonzero(block == other)
            partners = partners[partners > i] if one == other else partners
            for at in range(0, len(partners), SOURCES):
                some = partners[at : at + SOURCES]
                a += [i] * len(some)
                b += some.tolist()
                values += apart(p[i], p[some]).sum(axis=1).tolist()
        places += [-1] * len(a)
        if one == other:
            q = shares(cells.column("lang_term_n").to_numpy(), cells.column("lang_n").to_numpy(), n_terms)
            mine = p[ids, place]
            above = np.flatnonzero(mine > q)
            value = apart(mine[above], q[above])
            order = np.lexsort((place[above], -value, ids[above]))
            own = ids[above][order]
            first = np.searchsorted(own, own)
            best = order[np.arange(len(own)) - first < top]
            a += ids[above][best].tolist()
            b += ids[above][best].tolist()
            values += value[best].tolist()
            places += place[above][best].tolist()
        place = np.array(places, dtype=np.int64)
        return pa.table([pa.array([lang] * len(a), pa.string()), names.take(pa.array(a, pa.int64())), names.take(pa.array(b, pa.int64())), pa.array(np.where(place < 0, -1, chunk * CHUNK + base + place)), pa.array(values, pa.int64())], schema=_FOUND)

    return compare


_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("id", pa.int64()), ("value", pa.int64())])


def _numbered(terms: DataFrame) -> DataFrame:
    """Kept terms with ids in the order of lang, then term; not without gaps."""
    return terms.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").withColumn("id", F.monotonically_increasing_id())


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (`pair` or `term`), item (another source, or a term), value and rank.
    A term is kept for a language if at least `min_docs` of its documents hold it."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark)
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counts = scratch.table(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_term_n")).filter(F.col("docs") >= min_docs)
    kept = scratch.table(_numbered(kept.drop("docs")))
    cells = scratch.table(counts.join(kept, ["lang", "term"]).select("lang", "source", "id", "n", "lang_term_n"))
    scratch.drop(counts)

    sizes = kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("lang_term_n").alias("lang_n"))
    used = cells.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = scratch.table(rows.select("lang", "source").groupBy("lang", "source").agg(F.lit(1).alias("one")).join(used, ["lang", "source"], "left").select("lang", "source", F.coalesce("group_n", F.lit(0).cast("long")).alias("group_n")))
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    n_blocks = -(-most // SOURCES)

    chunk, place = F.shiftright("id", CHUNK.bit_length() - 1).alias("chunk"), F.col("id").bitwiseAND(CHUNK - 1)
    chunks = kept.groupBy("lang", chunk).agg(F.count("*").alias("size"), F.min(place).alias("base"))  # ids of a language are without gaps here
    heads = chunks.join(groups, "lang").join(sizes, "lang")
    heads = heads.select("lang", "source", "chunk", F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("lang_term_n"), "group_n", "lang_n", "n_terms", "size", "base")
    body = cells.join(sizes, "lang").select("lang", "source", chunk, place.alias("place"), "n", "lang_term_n", F.lit(0).cast("long").alias("group_n"), "lang_n", *[F.lit(0).cast("long").alias(c) for c in ("n_terms", "size", "base")])
    block = F.pmod(F.xxhash64("source"), F.lit(n_blocks)).alias("block")
    both = heads.union(body).select("*", block).withColumn("partner", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))) if n_blocks > 1 else F.lit(0))
    both = both.withColumn("one", F.least("block", "partner")).withColumn("other", F.greatest("block", "partner"))
    found = both.groupBy("lang", "chunk", "one", "other").applyInArrow(_compare(top), "lang string, source string, other string, id long, value long")
    found = common.materialise(found)
    scratch.drop(cells)

    summed = found.filter("id < 0").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    summed = summed.union(summed.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    names = groups.select("lang", "source")
    pairs = names.join(names.withColumnRenamed("source", "other"), "lang").filter("source <> other").join(summed, ["lang", "source", "other"], "left")
    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.coalesce("value", F.lit(0)).cast("long").alias("value")).withColumn("rank", F.row_number().over(ordered))
    best = found.filter("id >= 0").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "id"))).filter(F.col("rank") <= top)
    terms = best.join(kept.select("lang", "id", "term"), ["lang", "id"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.union(terms)
