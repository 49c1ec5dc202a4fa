"""Viterbi and forward-backward passes over series of any length.

A series is cut into chunks. What a chunk does to a vector of states is a K x K
operator, folded in each task: (+, x) with a scale for each row for the smoothed shares,
(max, +) for the likeliest path. A scan over the few operators of a series gives the vectors at
the bounds of its chunks, from which each chunk is finished on its own. The
path goes backwards in the same way: a chunk maps each state after it to the
state it begins with.

The operator of a row is "emit, then move": the move away from a row has the
covariate of that row, so no row needs its neighbour. After the last row nothing
moves any more. numpy works on batches of chunks within a task; Spark deals the chunks, scans
their operators and puts the path together.

A series of up to ``WHOLE`` chunks needs none of this: its rows are gathered by series, and both passes
run over them where they lie (:func:`_passed`), so nothing but its rows is shuffled and nothing is stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattweave.spread import ordered_rank
from wattweave.storage import cut_lineage

#: Rows of a chunk.
CHUNK = 256
#: Chunks of a series that is passed over in one piece.
WHOLE = 16


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _positive(x: Column) -> Column:
    return F.greatest(x, F.lit(1e-300))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def _times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _share(v: Column) -> Column:
    """``v`` divided by its sum."""
    return _let(_positive(_sum(v)), lambda s: F.transform(v, lambda x: x / s))


def _best_after(v: Column, m: Column) -> Column:
    """Row vector times matrix in (max, +)."""
    low = F.transform(v, lambda x: F.lit(float("-inf")))
    return F.aggregate(F.zip_with(v, m, lambda x, row: F.transform(row, lambda y: x + y)), low, lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)))


def model_rows(fits: DataFrame) -> DataFrame:
    """(uid, resp, init, tran): a model in one row, states in order, from the long table of fits."""
    of = lambda kind, order, value: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(*order, value.alias("v"))))), lambda s: s["v"])
    line = F.struct("a", "b", "sd")
    flat = fits.groupBy("uid").agg(of("response", ["state"], line).alias("resp"), of("init", ["state"], F.col("a")).alias("init"), of("transition", ["state", "to_state"], F.struct("a", "b")).alias("flat"))
    k = F.size("resp")
    return flat.select("uid", "resp", "init", F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.slice("flat", i * k + 1, k)).alias("tran"))


def pieces(df: DataFrame, obs: str, t: str, key: str, ts: str, size: int) -> DataFrame:
    """(uid, chunk, rows): the rows of a series with a covariate, in order of time, ``size`` at a time; ``rows`` is array<struct<place, ts, y, x, last>>."""
    rows = df.where(F.col(t).isNotNull() & ~F.isnan(F.col(t).cast("double"))).select(F.col(key).alias("uid"), F.col(ts).alias("ts"), F.col(obs).cast("double").alias("y"), F.col(t).cast("double").alias("x"))
    placed = ordered_rank(rows.where(F.col("uid").isNotNull()), [F.col("ts"), F.col("x"), F.col("y")], "place", by=["uid"])
    ends = placed.groupBy("uid").agg(F.max("place").alias("n"))
    row = F.struct("place", "ts", "y", "x", (F.col("place") == F.col("n")).alias("last"))
    chunk = F.floor((F.col("place") - 1) / size).alias("chunk")
    return placed.join(ends, "uid").groupBy("uid", chunk).agg(F.array_sort(F.collect_list(row)).alias("rows"))


def dealt(chunks: DataFrame) -> DataFrame:
    """``chunks`` stored, 256 a task or fewer, those of one series too."""
    stored = cut_lineage(chunks)
    tasks = max(chunks.sparkSession.sparkContext.defaultParallelism, stored.count() // 256)
    return cut_lineage(stored.repartition(tasks))


def chunked(df: DataFrame, models: DataFrame, obs: str, t: str, key: str, ts: str) -> DataFrame:
    """(uid, chunk, rows, resp, tran): the :func:`pieces` of a series, with its model; chunks are dealt evenly, those of one series too."""
    return dealt(pieces(df, obs, t, key, ts, CHUNK).join(models.select("uid", "resp", "tran"), "uid"))


def log_density(y: np.ndarray, x: np.ndarray, beta: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """... x T x K log densities of lines in x; a missing observation has density 1."""
    beta, sd = beta[..., None, :, :], sd[..., None, :]
    out = -0.5 * ((y[..., None] - beta[..., 0] - x[..., None] * beta[..., 1]) / sd) ** 2 - np.log(sd) - 0.5 * np.log(2 * np.pi)
    return np.where(np.isnan(y)[..., None], 0.0, out)


def moves(x: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """... x T x K x K shares of the moves away from each row, by its own covariate."""
    z = b0[..., None, :, :] + b1[..., None, :, :] * x[..., None, None]
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


#: What the passes read of a chunk, as flat arrays: observations, covariates, lines and logits of moves of its model, and whether the series ends there.
_READ = ["y", "x", "ends", "ra", "rb", "rs", "ta", "tb"]


def _read(chunks: DataFrame, *held: Column | str) -> DataFrame:
    """``held`` and the arrays of ``_READ``."""
    of = lambda v, f: F.transform(v, lambda r: r[f])
    flat = lambda f: F.flatten(F.transform("tran", lambda row: of(row, f)))
    ends = F.exists("rows", lambda r: r["last"])
    return chunks.select(*held, of("rows", "y").alias("y"), of("rows", "x").alias("x"), ends.alias("ends"), *[of("resp", f).alias(n) for f, n in (("a", "ra"), ("b", "rb"), ("sd", "rs"))], flat("a").alias("ta"), flat("b").alias("tb"))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float)


def _lists(values: np.ndarray, *lengths: np.ndarray) -> pa.Array:
    """Nested lists of ``values``; lengths from the inner lists to the outer."""
    out = pa.array(values.ravel())
    for n in lengths:
        out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), out)
    return out


class _Part:
    """Chunks of models of one size, padded to one length: on padded rows nothing is seen and nothing moves."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        self.k, self.n = k, batch.num_rows
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        self.lengths = np.diff(column("x").offsets.to_numpy())
        at = np.arange(self.lengths.max())
        self.rows = at < self.lengths[:, None]
        x, y = np.zeros(self.rows.shape), np.full(self.rows.shape, np.nan)
        x[self.rows], y[self.rows] = _numbers(column("x")), _numbers(column("y"))
        model = {name: _numbers(column(name)).reshape(self.n, -1) for name in ("ra", "rb", "rs", "ta", "tb")}
        last = column("ends").to_numpy(zero_copy_only=False).astype(bool)[:, None] & (at == self.lengths[:, None] - 1)
        self.lb = log_density(y, x, np.stack([model["ra"], model["rb"]], axis=-1), model["rs"])
        self.top = self.lb.max(axis=-1)
        self.b = np.exp(self.lb - self.top[..., None])
        a = moves(x, model["ta"].reshape(-1, k, k), model["tb"].reshape(-1, k, k))
        with np.errstate(divide="ignore"):
            stay = np.log(np.eye(k))
        self.a = np.where(self.rows[..., None, None], a, np.eye(k))
        self.la = np.where(self.rows[..., None, None], np.where(last[..., None, None], 0.0, np.log(np.maximum(a, 1e-300))), stay)


def _by_size(use: Callable[[pa.RecordBatch, int], dict[str, pa.Array]], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``use`` on the chunks of each size of model, 256 at most at a time; columns of the batch that it doesn't give are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(batch.schema.get_field_index("ra")).offsets.to_numpy())
            for k in np.unique(sizes):
                rows = np.flatnonzero(sizes == k)
                for at in range(0, len(rows), 256):
                    part = batch.take(pa.array(rows[at : at + 256]))
                    made = use(part, int(k))
                    yield pa.RecordBatch.from_arrays([made[n] if n in made else part.column(part.schema.get_field_index(n)) for n in names], names=names)

    return run


def _folded(batch: pa.RecordBatch, k: int) -> dict[str, pa.Array]:
    """What each chunk does to a vector, summing (rows ``v`` with their log scale ``l``) and choosing the best (``m``)."""
    c = _Part(batch, k)
    v, logs = np.broadcast_to(np.eye(k), (c.n, k, k)), np.zeros((c.n, k))
    with np.errstate(divide="ignore"):
        m = np.broadcast_to(np.log(np.eye(k)), (c.n, k, k))
    for t in range(c.b.shape[1]):
        v = (v * c.b[:, t, None, :]) @ c.a[:, t]
        scale = np.maximum(v.sum(axis=-1), 1e-300)
        v, logs = v / scale[..., None], logs + np.log(scale)
        m = ((m + c.lb[:, t, None, :])[..., None] + c.la[:, t, None]).max(axis=-2)
    logs = logs + (c.top * c.rows).sum(axis=1)[:, None]
    each, all_k = np.full(c.n * k, k), np.full(c.n, k)
    p = pa.StructArray.from_arrays([pa.array(logs.ravel()), _lists(v, each)], names=["l", "v"])
    return {"p": pa.ListArray.from_arrays(pa.array(np.arange(c.n + 1) * k, pa.int32()), p), "m": _lists(m, each, all_k)}


def _trace(c: _Part, u: np.ndarray, w: np.ndarray, q: np.ndarray, ends: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """gamma, delta, the path for each of the first ``ends`` states that may follow, and the log-likelihood, given what stands before (``u``, ``q``) and after (``w``)."""
    alpha, beta, delta = np.empty_like(c.b), np.empty_like(c.b), np.empty_like(c.b)
    back, logs = np.empty(c.b.shape, dtype=np.int32), np.zeros(c.n)
    for t in range(c.b.shape[1]):
        row = u * c.b[:, t]
        scale = np.maximum(row.sum(axis=-1, keepdims=True), 1e-300)
        alpha[:, t] = row / scale
        logs += np.log(scale[:, 0])
        u = (alpha[:, t, None, :] @ c.a[:, t])[:, 0]
        q = q + c.lb[:, t]
        q = q - q.max(axis=-1, keepdims=True)
        score = np.exp(q)
        delta[:, t] = score / score.sum(axis=-1, keepdims=True)
        ways = q[..., None] + c.la[:, t]
        back[:, t], q = ways.argmax(axis=-2), ways.max(axis=-2)
    path, state = np.empty((c.n, ends, c.b.shape[1]), dtype=np.int32), np.broadcast_to(np.arange(ends), (c.n, ends))
    for t in reversed(range(c.b.shape[1])):
        beta[:, t] = (c.a[:, t] @ w[..., None])[..., 0]
        w = c.b[:, t] * beta[:, t]
        w = w / np.maximum(w.max(axis=-1, keepdims=True), 1e-300)
        state = np.take_along_axis(back[:, t], state, axis=1)
        path[:, :, t] = state + 1
    gamma = alpha * beta
    gamma = gamma / np.maximum(gamma.sum(axis=-1, keepdims=True), 1e-300)
    return gamma, delta, path, logs + (c.top * c.rows).sum(axis=1)


def _traced(batch: pa.RecordBatch, k: int) -> dict[str, pa.Array]:
    """Each row's shares and scores, given the bounds of its chunk, and for each state after the chunk the likeliest path through it."""
    c = _Part(batch, k)
    u, w, q = (_numbers(batch.column(batch.schema.get_field_index(n))).reshape(c.n, k) for n in ("u", "w", "q"))
    gamma, delta, path, _ = _trace(c, u, w, q, k)
    each = np.full(int(c.lengths.sum()), k)
    return {
        "gamma": _lists(gamma[c.rows], each, c.lengths), "delta": _lists(delta[c.rows], each, c.lengths),
        "paths": _lists(path[np.broadcast_to(c.rows[:, None], path.shape)], np.repeat(c.lengths, k), np.full(c.n, k)),
        "begins": _lists(path[:, :, 0], np.full(c.n, k)),
    }


def _passed(batch: pa.RecordBatch, k: int) -> dict[str, pa.Array]:
    """A row for each hour of whole series, with state, shares and fits."""
    c, column = _Part(batch, k), lambda name: batch.column(batch.schema.get_field_index(name))
    init = _numbers(column("init")).reshape(c.n, k)
    gamma, delta, path, loglik = _trace(c, init, np.ones((c.n, k)), np.log(np.maximum(init, 1e-300)), 1)
    at, each, state, delta = np.repeat(np.arange(c.n), c.lengths), np.full(int(c.lengths.sum()), k), path[:, 0][c.rows], delta[c.rows]
    level, slope = (_numbers(column(name)).reshape(c.n, k)[at] for name in ("ra", "rb"))
    mean = level + slope * _numbers(column("x"))[:, None]
    flat = {name: column(name).flatten() for name in ("ts", "x", "y")}
    return flat | {
        "uid": column("uid").take(pa.array(at)), "state": pa.array(state), "delta": _lists(delta, each), "gamma": _lists(gamma[c.rows], each),
        "fit_max": pa.array(mean[np.arange(len(at)), state - 1]), "fit_avg": pa.array((delta * mean).sum(axis=1)), "loglik": pa.array(loglik[at]),
    }


def _operators(chunks: DataFrame) -> DataFrame:
    """(uid, chunk, p, m): what each chunk does to a vector, summing (rows with their log scale) and choosing the best."""
    uid = dict(chunks.dtypes)["uid"]
    schema = f"uid {uid}, chunk bigint, p array<struct<l:double,v:array<double>>>, m array<array<double>>"
    return _read(chunks, "uid", "chunk").mapInArrow(_by_size(_folded, ["uid", "chunk", "p", "m"]), schema)


def _bounds(operators: DataFrame, models: DataFrame) -> DataFrame:
    """(uid, chunk, u, w, q, loglik): shares and best scores before each chunk, weights of what follows it."""
    few = operators.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("chunk", "p", "m"))).alias("ops")).join(models.select("uid", "init"), "uid")

    def forward(acc: Column, c: Column) -> Column:
        weights = F.zip_with(acc["u"], c["p"], lambda x, r: F.log(_positive(x)) + r["l"])
        apart = lambda g: F.aggregate(F.zip_with(g, c["p"], lambda x, r: F.transform(r["v"], lambda y: F.exp(x - F.array_max(g)) * y)), F.transform(g, lambda x: F.lit(0.0)), _plus)
        score = _best_after(acc["q"], c["m"])
        return F.struct(
            _let(weights, lambda g: _share(apart(g))).alias("u"),
            _let(score, lambda q: F.transform(q, lambda x: x - F.array_max(q))).alias("q"),
            (acc["loglik"] + _let(weights, lambda g: F.array_max(g) + F.log(_positive(_sum(apart(g)))))).alias("loglik"),
            F.concat(acc["out"], F.array(F.struct(c["chunk"].alias("chunk"), acc["u"].alias("u"), acc["q"].alias("q")))).alias("out"),
        )

    def backward(acc: Column, c: Column) -> Column:
        top = F.array_max(F.transform(c["p"], lambda r: r["l"]))
        raw = F.transform(c["p"], lambda r: F.exp(r["l"] - top) * _sum(_times(r["v"], acc["w"])))
        return F.struct(
            _let(raw, lambda w: F.transform(w, lambda x: _positive(x / _positive(F.array_max(w))))).alias("w"),
            F.concat(acc["out"], F.array(acc["w"])).alias("out"),
        )

    none = lambda kind: F.array().cast(kind)
    start = F.struct(
        F.col("init").alias("u"), F.transform("init", lambda p: F.log(_positive(p))).alias("q"), F.lit(0.0).alias("loglik"),
        none("array<struct<chunk:bigint,u:array<double>,q:array<double>>>").alias("out"),
    )
    end = F.struct(F.transform("init", lambda p: F.lit(1.0)).alias("w"), none("array<array<double>>").alias("out"))
    ahead = F.aggregate("ops", start, forward, lambda a: F.struct(a["loglik"].alias("loglik"), a["out"].alias("out")))
    behind = F.aggregate(F.reverse("ops"), end, backward, lambda a: F.reverse(a["out"]))
    scanned = few.select("uid", ahead.alias("f"), behind.alias("w"))
    each = scanned.select("uid", "f.loglik", F.explode(F.arrays_zip(F.col("f.out").alias("f"), "w")).alias("c"))
    return each.select("uid", F.col("c.f.chunk").alias("chunk"), F.col("c.f.u").alias("u"), F.col("c.w").alias("w"), F.col("c.f.q").alias("q"), "loglik")


def _finished(chunks: DataFrame) -> DataFrame:
    """Each chunk's shares and scores, its path for each state after it, and the state that path begins with."""
    held = ["uid", "chunk", "rows", "resp", "loglik"]
    kinds = dict(chunks.dtypes)
    made = {"gamma": "array<array<double>>", "delta": "array<array<double>>", "paths": "array<array<int>>", "begins": "array<int>"}
    schema = ", ".join(f"{n} {k}" for n, k in ({n: kinds[n] for n in held} | made).items())
    return _read(chunks, *held, "u", "w", "q").mapInArrow(_by_size(_traced, [*held, *made]), schema)


def _after(finished: DataFrame) -> DataFrame:
    """(uid, chunk, after): the state of the row that follows each chunk on the likeliest path; after the last any, as its last row points all ways alike."""
    few = finished.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("chunk", "begins"))).alias("maps"))
    start = F.struct(F.lit(1).alias("s"), F.array().cast("array<struct<chunk:bigint,after:int>>").alias("out"))
    step = lambda acc, c: F.struct(F.element_at(c["begins"], acc["s"]).alias("s"), F.concat(acc["out"], F.array(F.struct(c["chunk"].alias("chunk"), acc["s"].alias("after")))).alias("out"))
    return few.select("uid", F.explode(F.aggregate(F.reverse("maps"), start, step, lambda a: a["out"])).alias("m")).select("uid", "m.chunk", "m.after")


def likelihoods(df: DataFrame, fits: DataFrame, obs: str, t: str, key: str, ts: str) -> DataFrame:
    """uid, loglik of every series that has a model: the operators of its chunks are enough."""
    models = cut_lineage(model_rows(fits))
    bounds = _bounds(_operators(chunked(df, models, obs, t, key, ts)), models)
    return bounds.groupBy("uid").agg(F.max("loglik").alias("loglik"))


def decode(df: DataFrame, fits: DataFrame, obs: str, t: str, key: str, ts: str) -> DataFrame:
    """uid, ts, x, y, state, delta, gamma, fit_max, fit_avg, loglik of every row whose series has a model; x is the covariate, y the observation."""
    models = cut_lineage(model_rows(fits))
    known = F.col(t).isNotNull() & ~F.isnan(F.col(t).cast("double")) & F.col(key).isNotNull()
    rows = df.where(known).select(F.col(key).alias("uid"), F.col(ts).alias("ts"), F.col(obs).cast("double").alias("y"), F.col(t).cast("double").alias("x"))
    long = rows.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WHOLE * CHUNK).select("uid")
    if long.isEmpty():
        return _whole(rows, models)
    long = cut_lineage(long)
    return _whole(rows.join(long, "uid", "left_anti"), models).unionByName(_pieced(rows.join(long, "uid", "left_semi"), models))


def _whole(rows: DataFrame, models: DataFrame) -> DataFrame:
    """:func:`decode` of series of up to ``WHOLE`` chunks: gathered by series, and both passes over each in one piece."""
    series = rows.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("ts", "x", "y", F.lit(True).alias("last")))).alias("rows"))
    kinds = dict(rows.dtypes)
    made = {"uid": kinds["uid"], "ts": kinds["ts"], "x": "double", "y": "double", "state": "int", "delta": "array<double>", "gamma": "array<double>", "fit_max": "double", "fit_avg": "double", "loglik": "double"}
    read = _read(series.join(models, "uid"), "uid", "init", F.transform("rows", lambda r: r["ts"]).alias("ts"))
    return read.mapInArrow(_by_size(_passed, list(made)), ", ".join(f"{n} {k}" for n, k in made.items()))


def _pieced(rows: DataFrame, models: DataFrame) -> DataFrame:
    """:func:`decode` of longer series, by chunks."""
    chunks = chunked(rows, models, "y", "x", "uid", "ts")
    bounds = cut_lineage(_bounds(_operators(chunks), models))
    finished = cut_lineage(_finished(chunks.join(bounds, ["uid", "chunk"])))
    traced = finished.join(_after(finished), ["uid", "chunk"])
    path = F.element_at("paths", F.col("after"))
    rows = traced.select("uid", "resp", "loglik", F.explode(F.arrays_zip("rows", path.alias("state"), "delta", "gamma")).alias("r"))
    mean = F.transform("resp", lambda s: s["a"] + s["b"] * F.col("x"))
    flat = rows.select("uid", "loglik", F.col("r.rows.ts").alias("ts"), F.col("r.rows.x").alias("x"), F.col("r.rows.y").alias("y"), F.col("r.state").alias("state"), F.col("r.delta").alias("delta"), F.col("r.gamma").alias("gamma"), "resp")
    return flat.withColumn("mean", mean).select(
        "uid", "ts", "x", "y", "state", "delta", "gamma", F.element_at("mean", F.col("state")).alias("fit_max"), _sum(_times(F.col("delta"), F.col("mean"))).alias("fit_avg"), "loglik"
    )
