"""Whitening of embeddings on their leading principal components.

Entries become integers, so sums and the second moments about an integer centre
are exact whatever the order of tasks, and the covariance is their quotient. Spark
sums one matrix a task; the driver keeps one matrix of the vectors' dimension, whose leading
eigenpairs come from slicing its spectrum (``spectrum``). Each distinct vector
counts once in the fit; every row is projected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col
from .spectrum import leading

#: Steps in one unit of an entry.
STEPS = 256
#: Integers beyond this are taken as this: entries of 2^32 and more.
FAR = 1 << 40
#: An eigenvalue below this share of the trace is none: there is no variance to scale to one.
FLAT = 1e-12

EXACT = pa.decimal128(38, 0)


def integers(vector: Column) -> Column:
    """floor(256 c) of each entry, as array<bigint>."""
    return F.transform(vector, lambda c: F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.floor(c.cast("double") * STEPS).cast("long"))))


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite entry, nor without entries."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return F.coalesce(F.forall(vector, finite), F.lit(False)) & (F.size(vector) > 0)


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], EXACT)


def _lists(rows: list) -> pa.Array:
    flat = _decimals(v for row in rows for v in row)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), flat)


def _sums(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for x in (_matrix(b, dim) for b in batches):
            n, total = n + len(x), total + x.sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), _lists([total])], names=["n", "s"])

    return work


def exact_gram(z: np.ndarray) -> np.ndarray:
    """z'z of integers, exactly: in doubles over as few rows at once as keep every sum below 2^53."""
    most = int(np.abs(z).max(initial=0)) ** 2
    if most > 1 << 53:
        whole = z.astype(object)
        return whole.T @ whole
    step = max(1, (1 << 53) // max(1, most))
    total = np.zeros((z.shape[1], z.shape[1]), object)
    for at in range(0, len(z), step):
        part = z[at : at + step].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def _grams(dim: int, centre: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in (_matrix(b, dim) for b in batches):
            gram = exact_gram(x - centre)
            total = gram if total is None else total + gram
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), _lists(list(total))], names=["i", "v"])

    return work


class Whitener:
    """n distinct vectors with sums S, the leading eigenvalues and components of their covariance."""

    def __init__(self, n: int, sums: list[int], gram: np.ndarray, k: int):
        self.n, self.centre, self.rest = n, centre_of(n, sums), None
        self.rest = np.array([s - n * int(c) for s, c in zip(sums, self.centre, strict=True)], object)
        exact = n * gram - np.outer(self.rest, self.rest)
        cov = np.array([[int(v) / (n * n) for v in row] for row in exact], np.float64)
        self.trace = float(np.trace(cov))
        values, vectors = leading(cov, k)
        real = values > FLAT * self.trace
        self.values, self.vectors = values[real], vectors[:, real]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        offset = np.array([int(r) / self.n for r in self.rest])
        return ((x - self.centre) - offset) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exactly; None where a long can't hold one."""
        z = x - self.centre
        most = self.n * int(np.abs(z).max(initial=0)) + max(abs(int(r)) for r in self.rest)
        if most * most * z.shape[1] < 1 << 63:
            return ((self.n * z - self.rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        whole = ((self.n * z.astype(object) - self.rest) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in whole]


def centre_of(n: int, sums: list[int]) -> np.ndarray:
    """The whole numbers nearest to the mean."""
    return np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)


def _moments(dim: int, model: Whitener) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k = len(model.values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, moment = 0, np.zeros(k), np.zeros((k, k))
        for x in (_matrix(b, dim) for b in batches):
            if len(x):
                w = model.whiten(x)
                own = w.mean(axis=0)
                share, gap = len(w) / (n + len(w)), own - mean
                moment = moment + (w - own).T @ (w - own) + np.outer(gap, gap) * n * share
                n, mean = n + len(w), mean + gap * share
        if n:
            yield pa.RecordBatch.from_pylist([{"n": n, "mean": mean.tolist(), "moment": moment.ravel().tolist()}])

    return work


def identity_error(fit: DataFrame, dim: int, model: Whitener) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity; centred, then multiplied."""
    k, n = len(model.values), model.n
    parts = fit.mapInArrow(_moments(dim, model), "n long, mean array<double>, moment array<double>").cache()
    mean = [v / n for v in parts.agg(F.array(*[F.sum(F.col("n") * F.col("mean")[i]) for i in range(k)])).first()[0]]
    gap = [F.col("mean")[i] - F.lit(mean[i]) for i in range(k)]
    cov = parts.agg(F.array(*[F.sum(F.col("moment")[k * i + j] + F.col("n") * gap[i] * gap[j]) for i in range(k) for j in range(k)])).first()[0]
    parts.unpersist()
    return float(np.abs(np.array(cov).reshape(k, k) / n - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """One row for each usable row and component: id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds a null or non-finite entry are dropped;
    where vectors differ in length, those of the commonest length (the longer of
    two as common) are kept. Entries are integers from floor(256 c), of 2^40 at most
    in size. Components are numbered from 1 by falling eigenvalue, their largest
    coordinate positive; of equal eigenvalues any basis. Components without variance
    are left out, so a table of one distinct vector gives no rows, as does an empty one.
    ``deviation`` is null where a long can't hold it. Repeated rows and ids, null
    ids too, each have their rows. Columns other than the two named are not read.
    """
    spark = vectors.sparkSession
    kind = vectors.select(col(id_col)).schema[0].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vector = col(vector_col)
    clean = vectors.where(usable(vector)).select(col(id_col).alias("id"), integers(vector).alias("x"))
    common = clean.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common["dim"]
    clean = clean.where(F.size("x") == dim)
    scratch = Scratch(spark)
    fit = scratch.store(clean.select("x").distinct(), "distinct-vectors")
    parts = fit.mapInArrow(_sums(dim), "n long, s array<decimal(38,0)>")
    n, sums = parts.agg(F.sum("n"), F.array(*[F.sum(F.col("s")[j]) for j in range(dim)])).first()
    sums = [int(s) for s in sums]
    rows = fit.mapInArrow(_grams(dim, centre_of(n, sums)), "i int, v array<decimal(38,0)>").groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(dim)]).alias("v"))
    gram = np.array([[int(v) for v in r["v"]] for r in sorted(rows.collect())], object)  # dim x dim
    model = Whitener(n, sums, gram, components)
    k = len(model.values)
    if not k:
        scratch.drop(fit)
        return spark.createDataFrame([], schema)
    error = identity_error(fit, dim, model)
    scratch.drop(fit)
    explained = model.values / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, dim)
            m = len(x)
            deviation = pa.array(model.deviation(x), pa.int64())
            each = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch.column(0).take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n, np.int64)),
                deviation.take(each),
                pa.array(model.whiten(x).ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return clean.mapInArrow(project, schema)
