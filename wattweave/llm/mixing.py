"""Mixing sources to target weights by Sainte-Lague apportionment.

Seats are single tokens at every size of input. Highest quotients hand the
tokens of the whole mix to the sources in proportion to their targets, and each
source's to its shards in proportion to their tokens; what would go over a
limit of 3 times the size goes to the others. A source has as many shards as its
tokens need. In a shard the documents stand in the order of a seeded hash as one
stream, cut into blocks of equal size. The quota takes the whole stream as often
as it fits; what remains of it goes to blocks in the order of a second seeded
hash, each whole until the last, of which the first tokens are taken.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, col, placed, spare, stored

CYCLE = (5, 2, 1)
TIMES = 3
#: Tokens of a block, and of a shard about.
BLOCK = 2048
SHARD = 1 << 25


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycle_weights(names: list[str | None]) -> dict[str | None, float]:
    """5, 2, 1 and again, over the sources by code point, null last."""
    order = sorted((n for n in names if n is not None)) + [n for n in names if n is None]
    return {n: float(CYCLE[i % len(CYCLE)]) for i, n in enumerate(order)}


def targets(sizes: np.ndarray, weights: np.ndarray, total: float, times: float = 3.0) -> np.ndarray:
    """``total`` shared by weight; nobody gets over ``times`` its size, what is over goes to the others by weight."""
    limit, out, capped = sizes * times, np.zeros(len(sizes)), np.zeros(len(sizes), dtype=bool)
    while True:
        free = ~capped
        out[capped] = limit[capped]
        if not free.any():
            return out
        out[free] = (total - limit[capped].sum()) * weights[free] / weights[free].sum()
        over = free & (out > limit)
        if not over.any():
            return out
        capped |= over


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by the highest quotients votes / (2k + 1); ties go to the earlier row.

    A divisor search finds nearly all of them at once, and single quotients
    settle the rest, so that the work doesn't grow with the seats.
    """
    votes = np.asarray(votes, dtype=float)
    out = np.zeros(len(votes), dtype=np.int64)
    if seats <= 0 or votes.sum() <= 0:
        return out
    low, high = 0.0, 2 * (seats + len(votes)) / votes.sum()
    for _ in range(200):  # the largest multiplier that hands out no more than the seats
        middle = (low + high) / 2
        if np.floor(votes * middle + 0.5).sum() <= seats:
            low = middle
        else:
            high = middle
    out = np.floor(votes * low + 0.5).astype(np.int64)
    while out.sum() < seats:
        out[np.argmax(votes / (2 * out + 1))] += 1
    return out


def apportion(votes: np.ndarray, limits: np.ndarray, seats: int) -> np.ndarray:
    """Seats by :func:`sainte_lague`, at most ``limits``; what a limit cuts off goes to the other rows."""
    votes, limits = np.asarray(votes, dtype=float), np.asarray(limits, dtype=np.int64)
    out, capped = np.zeros(len(votes), dtype=np.int64), np.zeros(len(votes), dtype=bool)
    while True:
        out[capped] = limits[capped]
        out[~capped] = sainte_lague(votes[~capped], min(seats, int(limits.sum())) - int(limits[capped].sum()))
        over = ~capped & (out > limits)
        if not over.any():
            return out
        capped |= over


def quotas(shards: pd.DataFrame, weights: dict[str | None, float]) -> pd.DataFrame:
    """source, shard, size -> also source_size, target, quota (tokens)."""
    shards = shards.sort_values(["rank", "shard"]).reset_index(drop=True)
    sources = shards.groupby("rank").agg(source=("source", "first"), source_size=("size", "sum")).reset_index()
    total = int(sources["source_size"].sum())
    by_source = np.array([weights[None if pd.isna(s) else s] for s in sources["source"]])
    sources["target"] = targets(sources["source_size"].to_numpy(float), by_source, float(total))
    sources["seats"] = apportion(sources["target"].to_numpy(), TIMES * sources["source_size"].to_numpy(), int(round(sources["target"].sum())))
    shards = shards.merge(sources.drop(columns="source"), on="rank")
    shards["quota"] = 0
    for _, own in shards.groupby("rank"):
        shards.loc[own.index, "quota"] = apportion(own["size"].to_numpy(), TIMES * own["size"].to_numpy(), int(own["seats"].iloc[0]))
    return shards


def _hash(seed: int, *parts: Column) -> Column:
    """The MD5 of the seed and the parts as text, in hexadecimal."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def _number(mark: Column) -> Column:
    """The first 60 bits of a hexadecimal hash."""
    return F.conv(F.substring(mark, 1, 15), 16, 10).cast("long")


def _blocks(shards: DataFrame, seed: int, block: int) -> DataFrame:
    """rank, shard, block, got: the tokens that each block of a shard gives to what remains of the shard's quota."""
    size = F.least(F.lit(block), F.col("shard_size") - F.col("block") * block)
    before = F.sum("own").over(
        Window.partitionBy("rank", "shard").orderBy("drawn", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) - F.col("own")
    return (
        shards.where("rest > 0")
        .select("rank", "shard", "rest", "shard_size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("shard_size") - 1) / block))).alias("block"))
        .select("rank", "shard", "block", "rest", size.alias("own"), _hash(seed, F.col("rank"), F.col("shard"), F.col("block")).alias("drawn"))
        .select("rank", "shard", "block", F.greatest(F.lit(0), F.least("own", F.col("rest") - before)).alias("got"))
        .where("got > 0")
    )


def plan_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: dict[str | None, float] | None = None, seed: int = 7, shard: int = SHARD, block: int = BLOCK, keep: dict[str, str] | None = None,
) -> DataFrame:
    """What the mix takes of each row: id, size, source_size, target, taken (words, repeats counted), and ``keep``.

    ``weights`` defaults to 5, 2, 1, repeating over the sources by code point,
    null last. A source of null is a source like others; a text that is null or
    has no word has size 0 and gives nothing. No row gives more than 3 times its
    size. Rows are dealt to shards and ordered by a hash of seed and id (then by
    size and ``keep``), so reruns agree; repeated rows are rows of their own.
    One row for each source and each shard (of about ``shard`` words) reaches the
    driver. An empty table gives an empty result. Columns that aren't named
    aren't read; ``keep`` names further ones to be handed on, as column -> name.
    """
    keep = keep or {}
    sized = stored(
        docs.select(
            col(id_col).alias("id"), col(source_col).alias("source"), word_count(col(text_col)).alias("size"), _hash(seed, col(id_col)).alias("mark"),
            F.monotonically_increasing_id().alias("key"), *[col(c).alias(n) for c, n in keep.items()],
        ),
        "sizes",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    order = sorted((r["source"] for r in sources if r["source"] is not None)) + [None] * any(r["source"] is None for r in sources)
    shards_of = {r["source"]: max(1, -(-r["size"] // shard)) for r in sources}
    ranks = docs.sparkSession.createDataFrame(
        [(s, i, shards_of[s]) for i, s in enumerate(order)], "r_source string, rank int, shards long"
    )
    # A row for each source, as the weights name them.
    dealt = sized.join(F.broadcast(ranks), F.col("source").cast("string").eqNullSafe(F.col("r_source"))).withColumn("shard", F.pmod(_number(F.col("mark")), F.col("shards")))
    cells = dealt.groupBy("rank", "shard").agg(F.sum("size").alias("size")).toPandas()
    cells["source"] = [order[r] for r in cells["rank"]]
    plan = quotas(cells, weights or cycle_weights(order)) if len(cells) else cells.assign(source_size=[], target=[], quota=[])
    rows = [tuple(t(x) for t, x in zip((int, int, int, int, float, int), r, strict=True)) for r in plan[["rank", "shard", "size", "source_size", "target", "quota"]].itertuples(index=False)]
    passes = F.when(F.col("shard_size") > 0, F.least(F.floor(F.col("quota") / F.col("shard_size")), F.lit(TIMES))).otherwise(F.lit(0)).cast("long")
    fixed = docs.sparkSession.createDataFrame(rows, "rank int, shard long, shard_size long, source_size long, target double, quota long").withColumn("passes", passes)
    fixed = fixed.withColumn("rest", F.when(F.col("passes") >= TIMES, F.lit(0)).otherwise(F.col("quota") - F.col("passes") * F.col("shard_size")))
    end = F.sum("size").over(
        Window.partitionBy("rank", "shard").orderBy("mark", "id", "size", *keep.values()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    stream = stored(
        dealt.withColumn("end", end).join(fixed, ["rank", "shard"])
        .select("id", "size", "source_size", "target", "key", "rank", "shard", (F.col("end") - F.col("size")).alias("begin"), "end", "passes", "rest", *keep.values()),
        "stream",
    )
    at = F.col("block") * block
    drawn = (
        stream.where("size > 0 AND rest > 0")
        .select("key", "rank", "shard", "begin", "end", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))).alias("block"))
        .hint("merge")
        .join(_blocks(fixed, seed, block), ["rank", "shard", "block"])
        .groupBy("key")
        .agg(F.sum(F.greatest(F.lit(0), F.least("end", at + F.col("got")) - F.greatest("begin", at))).alias("drawn"))
    )
    taken = F.col("passes") * F.col("size") + F.coalesce("drawn", F.lit(0))
    return stream.hint("merge").join(drawn, "key", "left").select("id", "size", "source_size", "target", taken.cast("long").alias("taken"), *keep.values())


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows, with the columns of ``docs`` whatever their names.

    A document taken k times in full comes k times; of what the drawn blocks take
    of it beyond that, it gives so many of its first words. ``n_chars``, where
    there is such a column, follows the text. Rows whose text is null or has no
    word give nothing; a null id or source is a value like others; an empty
    table stays empty.
    """
    at, file, row = placed(docs)
    size, taken, copy = spare(docs, "size", "taken", "copy")
    plan = plan_mix(at, keep={file: file, row: row}, **options).where("taken > 0").select(file, row, F.col("size").alias(size), F.col("taken").alias(taken))
    whole = F.floor(F.col(taken) / F.col(size))
    part = F.col(taken) - whole * F.col(size)
    drawn = at.join(plan.hint("merge"), [file, row]).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col(taken) / F.col(size)))))
    drawn = drawn.withColumn("text", F.when(F.col(copy) <= whole, F.col("text")).otherwise(first_words(F.col("text"), part)))
    if "n_chars" in docs.columns:
        drawn = drawn.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return drawn.select(*map(col, docs.columns))
