"""Language identification: sparse multinomial logistic regression on TF-IDF character
n-grams, trained by follow-the-regularised-leader with elastic-net penalties, then
calibrated by one temperature.

Features are character 1- to 3-grams of the lower-cased text, where every run of
characters that are not letters counts as one blank, hashed into 2^15 cells; a cell's
value is (1 + log tf) * idf and the vector has length one. Document frequencies are
counted over all training rows. The weights are fitted on at most `PER_LANG` rows of
each language (chosen by a hash of doc_id, shared out by the counted sizes), by FTRL
passes that run inside the executors: each of `SHARDS` tasks continues from the mean
state of the last pass. A part of that sample is kept from fitting and sets the
temperature, with short cuts of its texts beside the whole ones, so that the score of a
few words is not that of a page. The model has a fixed size, whatever the input: of more
than `MAX_LANGS` labels, those with most rows are learned.

Defined results: null texts and texts without a letter get `und` with score 0; with no
labelled training row at all every text gets `und`; training skips rows with a null
text, lang or doc_id; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels
from .kernels import U

CELLS = 1 << 15
PER_LANG = 1500
SHARDS = 6
PASSES = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-5
#: One row in so many of the sample sets the temperature, whole and in cuts of so many characters.
CALIBRATION = 5
CUTS = (12, 40, 160)
MAX_LANGS = 256
#: Strength of the prior that log T is 0, in rows, and the grid of powers of two searched.
PRIOR = 1.0
GRID = tuple(2.0 ** (i / 8) for i in range(-64, 65))
_PIECE = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    """Code points to themselves for letters, to 0 for all else."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = c
    return out


def _codes(text: str) -> np.ndarray:
    c = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    return c[keep].astype(U)


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Cells of the text and how often each occurs; None without a letter. Long texts are
    worked off in pieces that overlap by two characters."""
    total = None
    for i in range(0, len(text or ""), _PIECE):
        c = _codes(text[max(0, i - 2) : i + _PIECE])
        if not c.any():
            continue
        c = np.concatenate((np.zeros(1, dtype=U), c, np.zeros(1, dtype=U)))
        two = c[:-1] * U(0x9E3779B1) + c[1:]
        three = two[:-1] * U(0x9E3779B1) + c[2:]
        cell = np.concatenate([((x + U(n)) * U(0x9E3779B97F4A7C15)) >> U(49) for n, x in ((1, c[c > 0]), (2, two), (3, three))])
        n = np.bincount(cell.astype(np.int64), minlength=CELLS)
        total = n if total is None else total + n
    if total is None:
        return None
    cells = np.flatnonzero(total)
    return cells, total[cells]


def _vector(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cells, n = found
    x = (1 + np.log(n)) * idf[cells]
    return cells, x / max(np.sqrt((x * x).sum()), 1e-12)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x cells
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        found = counts(text)
        if found is None or not self.langs:
            return "und", 0.0
        cells, x = _vector(found, self.idf)
        z = self.weights[:, cells] @ x / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    def run(batches):
        df, n = np.zeros(CELLS + 1, dtype=np.int64), 0
        for chunk in kernels.chunks(batches):
            for text in chunk.column("text").to_pylist():
                found = counts(text)
                if found:
                    df[found[0]] += 1
                    df[CELLS] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"cell": at.astype(np.int32), "n": df[at]})

    got = rows.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(CELLS + 1, dtype=np.int64)
    df[got["cell"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return df[:CELLS], int(df[CELLS])


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The leader that the elastic net regularises."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _shuffled(x: list, seed: int) -> list:
    return [x[i] for i in np.random.default_rng(seed).permutation(len(x))]


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass of per-coordinate FTRL over (cells, values, class) rows; changes z and n."""
    for cells, x, y in rows:
        zi, ni = z[:, cells], n[:, cells]
        w = _weights(zi, ni)
        s = w @ x
        p = np.exp(s - s.max())
        p /= p.sum()
        p[y] -= 1
        g = p[:, None] * x
        step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
        z[:, cells] = zi + g - step * w
        n[:, cells] = ni + g * g


def _pass(z: np.ndarray, n: np.ndarray, seed: int):
    """One shard's pass, from the state that all shards share."""

    def one(table: pa.Table) -> pa.Table:
        z1, n1 = z.copy(), n.copy()
        rows = [r for b in table.sort_by("doc_id").to_batches() for r in _unpacked(b)]
        ftrl(_shuffled(rows, seed), z1, n1)
        return pa.table({"z": pa.array([z1.tobytes()], pa.binary()), "n": pa.array([n1.tobytes()], pa.binary())})

    return one


def _cuts(text: str) -> list[str]:
    """A piece of each length from the middle of the text, where it is longer."""
    return [text[(len(text) - n) // 2 :][:n] for n in CUTS if n < len(text)]


def _featurise(langs: list[str], idf: np.ndarray):
    index = {x: i for i, x in enumerate(langs)}

    def run(batches):
        for chunk in kernels.chunks(batches, max_bytes=2 << 20):
            out = []
            for doc, text, lang, test in zip(*(chunk.column(c).to_pylist() for c in ("doc_id", "text", "lang", "test"))):
                for piece in (text, *_cuts(text)) if test else (text,):
                    if found := counts(piece):
                        cells, x = _vector(found, idf)
                        out.append((doc, index[lang], test, cells.astype(np.int32).tobytes(), x.astype(np.float32).tobytes()))
            cols = list(zip(*out)) or [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], names=["doc_id", "y", "test", "cells", "x"])

    return run


def _unpacked(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, int]]:
    return [(np.frombuffer(c, dtype=np.int32), np.frombuffer(x, dtype=np.float32).astype(float), y) for y, c, x in zip(*(batch.column(n).to_pylist() for n in ("y", "cells", "x")))]


def fit(docs: DataFrame) -> Model:
    """Learn from text and lang of the rows whose held_out is false."""
    rows = docs.filter("text is not null and lang is not null and doc_id is not null").filter(~common.held_out()).select("doc_id", "text", "lang")
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    sizes = {r.lang: r.n for r in most}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.ones(CELLS), np.zeros((0, CELLS)), 1.0)
    df, n_docs = _document_frequencies(rows)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, PER_LANG / sizes[lang])))])
    lot = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20)) / F.lit(1 << 20)
    sample = rows.filter(lot < share[F.col("lang")]).withColumn("test", F.pmod(F.xxhash64(F.lit("heat"), "doc_id"), F.lit(CALIBRATION)) == 0)
    sample = sample.mapInArrow(_featurise(langs, idf), "doc_id long, y int, test boolean, cells binary, x binary")
    sample = sample.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(SHARDS)).cast("int"))
    scratch = common.Scratch(docs.sparkSession)
    sample = scratch.table(sample.repartition(SHARDS, "shard").sortWithinPartitions("doc_id"))

    shape = (len(langs), CELLS)
    z, n = np.zeros(shape), np.zeros(shape)
    dealt = sample.filter("not test").select("shard", "doc_id", "y", "cells", "x")
    for k in range(PASSES):
        states = dealt.groupBy("shard").applyInArrow(_pass(z, n, k), "z binary, n binary").collect()
        if states:
            z = np.mean([np.frombuffer(s.z).reshape(shape) for s in states], axis=0)
            n = np.mean([np.frombuffer(s.n).reshape(shape) for s in states], axis=0)
    weights = _weights(z, n)

    def logits(batches):
        for batch in batches:
            got = [((weights[:, c] @ x).tolist(), y) for c, x, y in _unpacked(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in got], pa.list_(pa.float64())), pa.array([y for _, y in got], pa.int32())], names=["s", "y"])

    test = sample.filter("test").mapInArrow(logits, "s array<double>, y int").collect()
    scratch.drop()
    return Model(langs, idf, weights.astype(np.float32), _temperature(np.array([r.s for r in test]).reshape(-1, len(langs)), np.array([r.y for r in test], dtype=int)))


def _temperature(s: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss on the grid, with a prior at 1. Targets are
    smoothed by the size of the class, so that classes which part without error don't ask
    for certainty; where the loss falls up to an end of the grid, T stays at 1."""
    if not len(s):
        return 1.0
    rows, n = np.bincount(y, minlength=s.shape[1]), s.shape[1]
    sure = (rows[y] + 1) / (rows[y] + 2)
    target = np.repeat(((1 - sure) / max(n - 1, 1))[:, None], n, axis=1)
    target[np.arange(len(y)), y] = sure

    def loss(t: float) -> float:
        z = s / t
        z = z - z.max(axis=1, keepdims=True)
        z = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return float(-(target * z).sum() + PRIOR * np.log(t) ** 2)

    best = min(GRID, key=loss)
    return 1.0 if best in (GRID[0], GRID[-1]) else best


def predict(docs: DataFrame, model: Model, extra: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score of every row."""

    def run(batches):
        for chunk in kernels.chunks(batches):
            got = [model.predict(t) for t in chunk.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model | None = None, min_score: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose language is identified: not `und`, and with
    a calibrated score of `min_score` at least. The text decides alone."""
    model = model or fit(docs)

    def run(batches):
        for chunk in kernels.chunks(batches):
            got = [model.predict(t) for t in chunk.column("text").to_pylist()]
            yield chunk.filter(pa.array([x != "und" and score >= min_score for x, score in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
