"""Near-duplicate embeddings by a subspace pigeonhole join.

Two unit vectors with cosine c are at squared distance 2 - 2c. Vectors are
scaled to length one, rotated by one random orthogonal matrix, which spreads a
difference evenly, and cut into blocks of a few dimensions. If a pair keeps the
whole budget of squared distance, it keeps in at least one block that block's
share by dimensions. Each block is range-joined under its share: a grid over the
block's space, each vector in its own cell and in every cell that its ball
reaches and that comes later, so that each pair of cells meets once. The union of the
candidates is verified on the whole vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col
from .components import connected_components

BLOCK = 8
#: A cell's side in radii of the range join; at 2 or more a ball leaves its cell on one side of a dimension at most.
SIDE = 3.0
COORDS = [f"c{i}" for i in range(BLOCK)]


@lru_cache(8)
def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(group: np.ndarray, block: int, cells: np.ndarray) -> np.ndarray:
    key = _mix(group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(block + 1))
    for column in cells.T:
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.int64).view(np.uint64))
    return key.view(np.int64)


def grid_rows(units: np.ndarray, group: np.ndarray, budget: float, rotated: np.ndarray) -> Iterator[tuple]:
    """(row, key, is home, squared reach, block coordinates) for every cell that each vector stands in or reaches."""
    dim = units.shape[1]
    y = units @ rotated
    for block, begin in enumerate(range(0, dim, BLOCK)):
        x = y[:, begin : begin + BLOCK]
        d = x.shape[1]
        # A little over the share, for the rounding of coordinates to 32 bits.
        reach = np.sqrt(budget * d / dim) * (1 + 1e-5) + 1e-6
        side = SIDE * reach
        home = np.floor(x / side)
        inside = x - home * side
        up = inside > side / 2
        gap = np.where(up, side - inside, inside)
        masks = (np.arange(1, 1 << d)[:, None] >> np.arange(d)) & 1
        row, which = np.nonzero(gap**2 @ masks.T <= reach**2)
        later = up[row, masks.argmax(axis=1)[which]]  # the first dimension that changes goes up
        row, which = row[later], which[later]
        moved = home[row] + masks[which] * np.where(up[row], 1, -1)
        with np.errstate(over="ignore"):
            keys = np.concatenate([_keys(group, block, home), _keys(group[row], block, moved)])
        rows = np.concatenate([np.arange(len(x)), row])
        coords = np.zeros((len(rows), BLOCK), dtype=np.float32)
        coords[:, :d] = x[rows]
        yield rows, keys, np.arange(len(rows)) < len(x), np.float32(reach**2 * (1 + 1e-5)), coords


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vectors in a batch."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(float)
    sizes = np.diff(offsets)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, values[offsets[rows][:, None] + np.arange(dim)]


def _cells(budget: float):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                nodes, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                for rows, matrix in _vectors(part.column(2)):
                    units = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
                    dim = matrix.shape[1]
                    group = labels[rows].astype(np.int64) * 65537 + dim
                    for row, keys, home, reach, coords in grid_rows(units, group, budget, rotation(dim)):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys), pa.array(nodes[rows[row]]), pa.array(home), pa.array(np.full(len(row), reach)), *map(pa.array, coords.T.copy())],
                            names=["key", "node", "home", "reach", *COORDS],
                        )

    return cells


def _cosine(threshold: float):
    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float)
            y = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(float)
            cuts = np.concatenate([[0], np.cumsum(np.diff(batch.column(2).offsets.to_numpy()))])[:-1].astype(np.int64)
            if not len(cuts):
                continue
            dot, xx, yy = (np.add.reduceat(v, cuts) for v in (x * y, x * x, y * y))
            keep = pa.array(dot >= threshold * np.sqrt(xx) * np.sqrt(yy))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return cosine


def near_duplicate_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``.

    Linked are vectors of the same label (an integer, not null) and length with
    cosine ``threshold`` or more. Vectors that are null, empty, zero or hold a
    null or non-finite number have no link. Equal vectors are one node in the
    joins; each counts as a link of the others. Rows that share an id are one node,
    with the links of all their vectors. Rows with a null id get a
    null component, aren't kept, and link nothing. An empty table gives an
    empty result. Columns that aren't named aren't read.
    """
    scratch = Scratch(vectors.sparkSession)
    source = vectors.select(
        col(id_col).cast("long").alias("id"), col(label_col).cast("long").alias("label"), col(vector_col).cast("array<double>").alias("vec")
    )
    finite = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    nodes = scratch.store(
        source.where(usable).groupBy("label", "vec").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")), "vectors"
    )
    budget = 2.0 - 2.0 * threshold
    schema = "key long, node long, home boolean, reach float, " + ", ".join(f"{c} float" for c in COORDS)
    cells = scratch.store(nodes.select("node", "label", "vec").mapInArrow(_cells(budget), schema), "cells")
    mine = cells.where("home").select("key", "node", "reach", *COORDS)
    theirs = cells.select("key", F.col("node").alias("other"), "home", *[F.col(c).alias(f"o{c}") for c in COORDS])
    apart = sum(((F.col(c) - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")) for c in COORDS), F.lit(0.0))
    found = mine.join(theirs, "key").where(
        (F.col("node") != F.col("other")) & (~F.col("home") | (F.col("node") < F.col("other"))) & (apart <= F.col("reach"))
    )
    pairs = scratch.store(found.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "candidates")
    left = nodes.select(F.col("node").alias("a"), F.col("label").alias("la"), F.col("vec").alias("va"))
    right = nodes.select(F.col("node").alias("b"), F.col("label").alias("lb"), F.col("vec").alias("vb"))
    links = scratch.store(
        pairs.join(left, "a").join(right, "b").where("la = lb AND size(va) = size(vb)").select("a", "b", "va", "vb").mapInArrow(_cosine(threshold), "a long, b long"),
        "links",
    )
    copies = nodes.groupBy("node").agg(F.sum("copies").alias("copies"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(copies.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.sum("copies").alias("linked"))
    component = connected_components(links, "a", "b").select(F.col("id").alias("node"), "component_id")
    known = scratch.store(
        copies.join(counted.withColumnRenamed("a", "node"), "node", "left")
        .join(component, "node", "left")
        .select("node", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "node").alias("component_id")),
        "known",
    )
    scratch.drop(cells, pairs, links)
    named = nodes.select("label", "vec", "node").join(known, "node")
    out = source.withColumn("usable", usable)
    linked = out.where("usable").join(named, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = out.where(~F.col("usable")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
