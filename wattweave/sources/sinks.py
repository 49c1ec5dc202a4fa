"""Writing usage, weather and model tables."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattweave.storage import cut_lineage

MODEL_TABLES = ("model_response", "model_transition", "model_init", "model_perf", "decoded")


def write_usage(df: DataFrame, path: str, by: Sequence[str] = ("grain", "year")) -> None:
    """Parquet partitioned by grain and year; only the partitions in ``df`` are replaced."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_meter_tree(df: DataFrame, path: str, key: str = "uid", year: str = "year") -> int:
    """Writes ``<path>/<year>/<key>.csv``, a file with a header for each key and year, and returns their number.

    Spark deals rows to files and makes their text, one row a file, lines in order; tasks only store it, as Spark's
    own writer would need a folder for each key. A null key or year is named ``null``; keys must be plain names.
    """
    columns = [c for c in df.columns if c not in (key, year)]
    lines = F.array_sort(F.collect_list(F.to_csv(F.struct(*columns))))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(n) for c, n in ((year, "folder"), (key, "file"))]
    files = df.groupBy(*named).agg(F.concat_ws("\n", F.lit(",".join(columns)), lines, F.lit("")).alias("text"))

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        folders = set()
        for batch in batches:
            for folder, file, text in zip(batch["folder"], batch["file"], batch["text"], strict=True):
                if not re.fullmatch(r"[A-Za-z0-9-][A-Za-z0-9._-]*", file):
                    raise ValueError(f"no file name: {file}")
                if folder not in folders:
                    fs.create_dir(f"{root}/{folder}", recursive=True)
                    folders.add(folder)
                with fs.open_output_stream(f"{root}/{folder}/{file}.csv", compression=None) as out:
                    out.write(text.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    return files.mapInPandas(store, "n long").agg(F.sum("n")).first()[0] or 0


def write_new_tables_only(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows of keys that the table at ``path`` lacks, and returns those keys, as stored before the write."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fresh = df
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        have = spark.read.parquet(path).select(F.col(key).cast(dict(df.dtypes)[key]).alias(key)).distinct()
        fresh = df.join(have, key, "left_anti")
    keys = cut_lineage(fresh.select(key).distinct())
    fresh.write.mode("append").partitionBy(key).parquet(path)
    return keys


def write_weather_table(df: DataFrame, table: str, key: str = "zip", replace: str = "table") -> None:
    """A catalog table partitioned by ``key``. ``replace="partitions"`` replaces those in ``df`` alone; others keep their files."""
    if replace not in ("table", "partitions"):
        raise ValueError(f"replace must be table or partitions, not {replace}")
    spark = df.sparkSession
    if replace == "table" or not spark.catalog.tableExists(table):
        df.repartition(key).write.mode("overwrite").partitionBy(key).saveAsTable(table)
        return
    rows = df.select(*spark.table(table).columns).repartition(key)
    mode = "spark.sql.sources.partitionOverwriteMode"  # an insert into a catalog table reads it from the session alone
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        rows.write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(mode, before)


def save_models(models: Mapping[str, DataFrame], path: str) -> None:
    for name, df in models.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_models(spark: SparkSession, path: str, names: Sequence[str] = MODEL_TABLES) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def fill_states(table: DataFrame, n_states: int, values: Sequence[str], key: str = "uid", state: str = "state") -> DataFrame:
    """A row for each key and state 1..n; values of missing states are 0."""
    full = table.select(key).distinct().withColumn(state, F.explode(F.sequence(F.lit(1), F.lit(n_states))))
    joined = full.join(table, [key, state], "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in values})
