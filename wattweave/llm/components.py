"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _digest(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum; two numbers reach the driver."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2**31))).alias("h"),
    ).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u moves to the smallest of u's neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(id, component_id) for every id that has a link to another id.

    ``component_id`` is the smallest id that can be reached. Links may come in
    either direction and more than once; links with a null end and links of an
    id to itself count for nothing; an empty table gives an empty table. The
    rounds keep only links between an id and a smaller one, are written to the
    shared folder, and end when a round changes nothing.
    """
    scratch = Scratch(links.sparkSession)
    edges = scratch.store(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct(),
        "edges",
    )
    seen = _digest(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        before, edges = edges, scratch.store(_small_star(_large_star(edges)), "edges")
        now = _digest(edges)
        scratch.drop(before)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)
