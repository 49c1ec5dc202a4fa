"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where none is named, a session on one machine (a ``local`` master, as in
    tests) makes and sets a temporary folder, once for each Spark application; on
    a cluster that is an error, as executors don't share such a folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="wattweave-"))
    return context.getCheckpointDir().rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one, with Spark's own file systems."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts the lineage, so that a lost executor costs a read and no second
    run of what came before, and lets adaptive execution split both sides of a
    later join.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """The tables that one run of an operator stores, removed when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def store(self, df: DataFrame, label: str) -> DataFrame:
        """As :func:`stored`, and remembered."""
        path = scratch_path(self.spark, label)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Remove ``tables``; whatever was computed from them must be stored by now."""
        for table in tables:
            remove(self.spark, self.held.pop(id(table))[1])


def col(name: str) -> Column:
    """A column by its plain name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def spare(df: DataFrame, *names: str) -> list[str]:
    """``names`` made longer than any column of ``df``, so that none clashes."""
    tail = "_" * (1 + max(map(len, df.columns), default=0))
    return [n + tail for n in names]


def placed(docs: DataFrame, label: str = "placed") -> tuple[DataFrame, str, str]:
    """``docs`` with the file and row that each of its rows is stored at, and the names of those two columns.

    The two name a row for certain, even where ids repeat or are null. A
    DataFrame that isn't read straight from files is written to the shared
    folder first.
    """
    file, row = spare(docs, "file", "row")
    place = [F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)]
    if docs.inputFiles() and "_metadata" not in map(str.lower, docs.columns):
        try:
            return docs.select("*", *place), file, row
        except AnalysisException:  # a plan over files that hides where its rows are stored
            pass
    (other,) = spare(docs, "metadata")
    clash = [c for c in docs.columns if c.lower() == "_metadata"]
    at = stored(docs.withColumnsRenamed({c: other for c in clash}), label).select("*", *place)
    return at.withColumnsRenamed({other: c for c in clash}), file, row


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the length of a block, for work that ends within it."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
