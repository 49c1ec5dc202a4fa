"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again;
the first four return the columns of ``documents``, further columns whatever their
names included. A null ``text`` has no language and goes in the first stage; the
later stages take one as an empty text. A null ``doc_id`` is no copy of another
in ``near_dedup`` and a value like others elsewhere; a null ``lang`` teaches
nothing; a null ``source`` is a source like others. Repeated rows are copies. An
empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattweave.llm import exact_dedup, langid, mixing, near_dedup, packing
from wattweave.llm.common import scratch_path, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not told (no text, no letter, no labelled row to learn from), or told with a posterior below one half, go."""
    return langid.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts that with the smallest id stays, a null id first; of rows that share it, one."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (0.80 of the five-word shingles) the document with the smallest id stays; texts without words and null ids stay."""
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and the last time as far, as the mix takes them; texts without words give nothing."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, each with its place in a sequence; every row is a document."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Posteriors and tokens can't be had in SQL; tests hold run() against the stages written out in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
