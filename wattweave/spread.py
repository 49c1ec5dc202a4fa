"""Ranks over whole tables without a task that sees all rows, and broadcasts behind a check of their size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattweave.storage import cut_lineage


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast if it has ``most`` rows or fewer; else as it is, and Spark picks the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spare(df: DataFrame, *names: str) -> list[str]:
    """``names`` made longer than any column of ``df``, so that none clashes."""
    tail = "_" * (1 + max(map(len, df.columns), default=0))
    return [n + tail for n in names]


def ordered_rank(df: DataFrame, order: Sequence[Column], name: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """Adds ``name``: each row's place from 1 in the order, within its group of ``by`` where given.

    Rows are dealt to ranges of the order, a task numbers its own range, and what
    stands before a range is the sum of the rows of earlier ranges: one number
    for each partition reaches the driver. The order should tell rows apart.
    """
    keys = [*(F.col(c) for c in by), *order]
    at, first_at = spare(df, "at", "first")
    dealt = cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()))
    part, own = F.shiftright(at, 33), F.col(at).bitwiseAND((1 << 33) - 1)
    before, total = [], 0
    for r in sorted(dealt.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        before += [F.lit(r["p"]), F.lit(total)]
        total += r["n"]
    if not total:
        return dealt.withColumn(name, F.lit(0).cast("long")).drop(at)
    placed = dealt.withColumn(name, F.create_map(*before)[part] + own + 1).drop(at)
    if not by:
        return placed
    first = placed.groupBy(*by).agg(F.min(name).alias(first_at))
    return placed.join(first, list(by)).withColumn(name, F.col(name) - F.col(first_at) + 1).select(*df.columns, name)


def running_sum(df: DataFrame, place: str, value: Column, name: str, by: Sequence[str] = (), block: int = 1 << 16) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over a row's group of ``by`` up to its ``place``, as :func:`ordered_rank` numbers them.

    Places are cut into blocks; a block is summed within a task and gets what stands
    before it, one row for each block, so no task sees a whole group.
    """
    piece, own, before, summed = spare(df, "piece", "own", "before", "summed")
    rows = df.withColumns({piece: F.floor((F.col(place) - 1) / block), own: value})
    blocks = rows.groupBy(*by, piece).agg(F.sum(own).alias(summed))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*by, piece, F.coalesce(F.sum(summed).over(earlier), F.lit(0.0)).alias(before))
    within = Window.partitionBy(*by, piece).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(blocks, [*by, piece])
    return joined.withColumn(name, F.col(before) + F.coalesce(F.sum(own).over(within), F.lit(0.0))).select(*df.columns, name)
