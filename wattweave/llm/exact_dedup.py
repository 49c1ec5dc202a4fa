"""Exact deduplication as a stateful stream over document digests.

``documents -> arrivals (digest, identifier, locator) -> stream -> state``

The stream groups arrivals by digest and keeps one state row for each digest in
RocksDB, a disk-backed store, with no watermark and so no expiry: the smallest
identifier, the locator (file and row) of its content and the number of
arrivals. Later runs of the stream on the same checkpoint add to that state
(``update_state``, ``read_state``). When the stream
has taken what is there, the state is read as a table and joined to the
arrivals. Where a digest was hit again, the full bytes of the hit are compared
with the bytes at the stored locator; rows whose bytes differ from them (a
digest collision) are regrouped by their bytes.

Only DataFrame functions run on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BREAK, Scratch, col, placed, remove, scratch_path, settings, stored

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Each store would else reserve 4 MB of disk, whatever it holds.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WORD_BREAK, " ")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def update_state(arrivals: str, checkpoint: str, spark: SparkSession, files_per_batch: int = 1000) -> None:
    """Run the stream over the arrival files not seen yet; the state stays in ``checkpoint``."""
    with settings(spark, STATE):
        stream = (
            spark.readStream.schema(spark.read.parquet(arrivals).schema)
            .option("maxFilesPerTrigger", files_per_batch)
            .parquet(arrivals)
            .groupBy("digest")
            .agg(F.min(F.struct("id", "file", "row")).alias("first"), F.count(F.lit(1)).alias("arrivals"))
        )
        (
            stream.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )


def read_state(checkpoint: str, spark: SparkSession) -> DataFrame:
    """(digest, first, arrivals): one row for each digest that the stream has met, as a stored table."""
    with settings(spark, STATE):
        state = spark.read.format("statestore").load(checkpoint)
        first, arrivals = (f"`{f.name}`" for f in state.schema["value"].dataType.fields)
        return stored(
            state.select(
                F.col("key.digest").alias("digest"), F.col(f"value.{first}").alias("first"), F.col(f"value.{arrivals}").alias("arrivals")
            ),
            "state",
        )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_hex,
) -> DataFrame:
    """One row for each row of ``docs``: which row of its text stays.

    Returns id, file, row (the row's own place), keep_id, group_size, kept,
    digest. Of rows with equal normalised texts that with the smallest id stays;
    a null id sorts before all others; rows that also share the id are told
    apart by file and row. Null text is empty text; rows of empty text are one
    group. Repeated rows are copies like any others. An empty table gives an
    empty result. Other columns, whatever their names, are not read.
    """
    return _dedup(*placed(docs), id_col, text_col, digest)


def _dedup(at: DataFrame, file: str, row: str, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """:func:`exact_dedup` of rows whose places are in the columns ``file`` and ``row``."""
    spark = at.sparkSession
    scratch = Scratch(spark)
    source = at.select(col(id_col).alias("id"), col(text_col).alias("text"), F.col(file).alias("file"), F.col(row).alias("row"))
    body = normalised(F.col("text"))
    path = scratch_path(spark, "arrivals")
    source.select("id", digest(body).alias("digest"), "file", "row").write.parquet(path)
    arrivals = spark.read.parquet(path)

    checkpoint = scratch_path(spark, "dedup-state")
    update_state(path, checkpoint, spark)
    state = read_state(checkpoint, spark)
    remove(spark, checkpoint)

    # Full bytes of the hits against the bytes at the stored locator. The hits grow
    # with the input, so they are never broadcast, at any size.
    repeated = scratch.store(
        arrivals.join(state.where("arrivals > 1").select("digest", "first"), "digest").select("digest", "first", "file", "row"),
        "hits",
    )
    texts = scratch.store(
        source.select("file", "row", "text").join(repeated.hint("merge"), ["file", "row"]).select("file", "row", "digest", "first", body.alias("body")),
        "hit-texts",
    )
    keepers = texts.where((F.col("first.file") == F.col("file")) & (F.col("first.row") == F.col("row"))).select(
        "digest", F.col("body").alias("kept_body")
    )
    odd = stored(
        texts.join(keepers.hint("merge"), "digest").where(F.col("body") != F.col("kept_body")).select("file", "row", "digest", "body"),
        "collisions",
    )
    scratch.drop(repeated, texts)
    regrouped = odd.join(
        odd.join(arrivals.select("id", "file", "row"), ["file", "row"])
        .groupBy("digest", "body")
        .agg(F.min(F.struct("id", "file", "row")).alias("own_first"), F.count(F.lit(1)).alias("own_size")),
        ["digest", "body"],
    ).select("file", "row", "digest", "own_first", "own_size")

    moved = regrouped.groupBy("digest").agg(F.count(F.lit(1)).alias("moved"))
    grouped = (
        state.join(moved, "digest", "left")
        .select("digest", "first", (F.col("arrivals") - F.coalesce("moved", F.lit(0))).alias("arrivals"))
    )
    plain = arrivals.join(odd.select("file", "row"), ["file", "row"], "left_anti").join(stored(grouped, "groups"), "digest")
    same = plain.select("id", "file", "row", "digest", F.col("first").alias("f"), F.col("arrivals").alias("n"))
    other = arrivals.join(regrouped.drop("digest"), ["file", "row"]).select(
        "id", "file", "row", "digest", F.col("own_first").alias("f"), F.col("own_size").alias("n")
    )
    return same.unionByName(other).select(
        "id",
        "file",
        "row",
        F.col("f.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        ((F.col("f.file") == F.col("file")) & (F.col("f.row") == F.col("row"))).alias("kept"),
        "digest",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` does not keep; same columns, whatever their names.

    Null text is empty text, so one row without text stays; of copies with a
    null id one row stays, before those with an id. An empty table stays empty.
    """
    at, file, row = placed(docs)
    kept = _dedup(at, file, row, id_col, text_col, sha256_hex).where("kept").select(F.col("file").alias(file), F.col("row").alias(row))
    return at.join(kept.hint("merge"), [file, row], "left_semi").select(*map(col, docs.columns))
