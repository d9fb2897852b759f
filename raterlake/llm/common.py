"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than the six ASCII blanks.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
BLANK_PATTERN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column | str) -> Column:
    """The words of a text as an array; null and blank texts give an empty array."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_PATTERN), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it many times inside `body`, lambdas included."""
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the fifth of the ids that learners never see."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names. Without one there is none that all executors
    are sure to see, except where the driver is the only executor."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/raterlake-{sc.applicationId}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _written(df: DataFrame) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, hadoop = _filesystem(spark, path)
    fs.deleteOnExit(hadoop)
    return path, spark.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one for files of an operator's own; it goes when the session ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    fs, hadoop = _filesystem(spark, path)
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def remove(spark: SparkSession, path: str) -> None:
    fs, hadoop = _filesystem(spark, path)
    fs.delete(hadoop, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back (columnar and compressed,
    unlike a checkpoint, so it suits wide intermediate results). It stays until the
    session ends."""
    return _written(df)[1]


class Scratch:
    """Tables that an operator writes to the shared folder on its way to its result. Each
    goes as soon as it is used up, so that disk holds what is needed and no more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._held: list[tuple[DataFrame, str]] = []

    def table(self, df: DataFrame) -> DataFrame:
        path, out = _written(df)
        self._held.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes these tables, or all."""
        gone = [(t, p) for t, p in self._held if not tables or any(t is x for x in tables)]
        self._held = [(t, p) for t, p in self._held if not any(t is x for x, _ in gone)]
        for _, path in gone:
            remove(self.spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(doc_id: Column | str = "doc_id", text: Column | str = "text") -> Column:
    """Fingerprint that tells apart rows which share a doc_id."""
    text = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(F.coalesce(text, F.lit("")))
