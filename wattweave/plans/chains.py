"""Reference structures of state chains, and how near observed chains come to them."""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattweave.plans.ranking import erfc
from wattweave.spread import small


def _allowed(name: str, i: int, j: int, k: int) -> bool:
    """Whether a structure of states 0..k-1 has the move from i to j.

    identity: stays; complete: all moves; telescope: stays, moves on by one or
    falls back to the first; fwdjump: stays or jumps to any later state, and from
    the last to the first; outlier: as telescope, and to and from the last state.
    """
    return {
        "identity": i == j,
        "complete": True,
        "telescope": j in (i, i + 1, 0),
        "fwdjump": j >= i or (i == k - 1 and j == 0),
        "outlier": j in (i, i + 1, 0, k - 1) or i == k - 1,
    }[name]


def chain_templates(spark: SparkSession, k: int) -> DataFrame:
    """template, from, to, p: in each structure every state takes its moves alike."""
    rows = []
    for name in ("identity", "complete", "telescope", "fwdjump", "outlier"):
        for i in range(k):
            moves = [j for j in range(k) if _allowed(name, i, j, k)]
            rows += [(name, i + 1, j + 1, 1 / len(moves) if j in moves else 0.0) for j in range(k)]
    return spark.createDataFrame(rows, "template string, from int, to int, p double")


def renumbered(templates: DataFrame) -> DataFrame:
    """template, perm, from, to, p: the structures under each of the K! numberings of their (few) states; ``perm`` tells which state stands in each place."""
    states = sorted(r["from"] for r in templates.select("from").distinct().collect())
    perms = [(" ".join(str(p[states.index(s)]) for s in states), s, p[states.index(s)]) for p in permutations(states) for s in states]
    table = templates.sparkSession.createDataFrame(perms, "perm string, s int, as int")
    a = table.select("perm", F.col("s").alias("from"), F.col("as").alias("_from"))
    b = table.select("perm", F.col("s").alias("to"), F.col("as").alias("_to"))
    return templates.join(a, "from").join(b, ["perm", "to"]).select("template", "perm", F.col("_from").alias("from"), F.col("_to").alias("to"), "p")


def transition_counts(states: DataFrame, key: str = "uid", ts: str = "ts", state: str = "state") -> DataFrame:
    """uid, from, to, n of the moves between consecutive rows of each series."""
    moved = states.select(key, F.lag(state).over(Window.partitionBy(key).orderBy(ts)).alias("from"), F.col(state).alias("to"))
    return moved.where(F.col("from").isNotNull()).groupBy(key, "from", "to").agg(F.count(F.lit(1)).alias("n"))


def chi2_tail(x: Column, df: Column) -> Column:
    """P(chi-square with df degrees > x): the finite series over every second degree; 1 where x or df isn't positive."""
    half, odd = x / 2, F.pmod(df, F.lit(2)) == 1
    base = F.when(odd, erfc(F.sqrt(half))).otherwise(F.exp(-half))
    first = F.when(odd, F.sqrt(half) * (2 / math.sqrt(math.pi))).otherwise(half) * F.exp(-half)
    start = F.struct(base.alias("sum"), first.alias("term"), F.when(odd, 3).otherwise(4).alias("at"))

    def step(acc: Column, _: Column) -> Column:
        return F.struct((acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * x / acc["at"]).alias("term"), (acc["at"] + 2).alias("at"))

    terms = F.floor((df - 1) / 2).cast("int")
    steps = F.when(terms > 0, F.sequence(F.lit(1), F.greatest(terms, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.when((x <= 0) | (df <= 0), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.aggregate(steps, start, step, lambda acc: acc["sum"])))


def _level_sum(term: Column) -> Column:
    """The sum of doubles in any order, rounded once: multiples of 2^-12 add up exactly (to 2^41), and so, next to it, does what is left."""
    whole = F.rint(term * 4096.0) / 4096.0
    return F.sum(whole) + F.sum(term - whole)


def _nearest(counts: DataFrame, templates: DataFrame, key: str, name: str, term: Column) -> DataFrame:
    """key, template, perm, statistic, df, p: the numbering of each structure with the least statistic (the first of those alike in four places).

    The moves from a state are one row, which meets the (few) structures where it lies: counts dealt
    by series need no further shuffle.
    """
    rows = counts.groupBy(key, "from").agg(F.sum("n").alias("_row"), F.map_from_entries(F.collect_list(F.when(F.col("to").isNotNull(), F.struct("to", "n")))).alias("_moves"))
    cells = rows.join(small(renumbered(templates)), "from").withColumn("n", F.coalesce(F.try_element_at("_moves", F.col("to")), F.lit(0)).cast("double"))
    cells = cells.withColumn("_e", F.col("_row") * F.greatest("p", F.lit(1e-6)))
    stat = cells.groupBy(key, "template", "perm").agg(_level_sum(term).alias(name))
    best = stat.groupBy(key, "template").agg(F.min(F.struct(F.round(name, 4).alias("_r"), "perm", name)).alias("_b"))
    size = templates.select(F.countDistinct("from").alias("_k"))  # one row
    out = best.crossJoin(F.broadcast(size)).select(key, "template", "_b.perm", f"_b.{name}", (F.col("_k") * (F.col("_k") - 1)).cast("int").alias("df"))
    return out.withColumn("p", 1 - chi2_tail(F.col(name), F.col("df")))


def chain_chi2(counts: DataFrame, templates: DataFrame, key: str = "uid") -> DataFrame:
    """uid, template, perm, chi2, df = K (K - 1), p (lower tail) of the best numbering; a move that a structure forbids has probability 1e-6."""
    gap = F.col("n") - F.col("_e")
    return _nearest(counts, templates, key, "chi2", gap * gap / F.col("_e"))


def chain_lr(counts: DataFrame, templates: DataFrame, key: str = "uid") -> DataFrame:
    """uid, template, perm, lr = 2 sum n log(n / expected), df, p (lower tail) of the best numbering."""
    return _nearest(counts, templates, key, "lr", F.when(F.col("n") > 0, 2 * F.col("n") * F.log(F.col("n") / F.col("_e"))).otherwise(0.0))


def chain_type(scores: DataFrame, statistic: str = "chi2", key: str = "uid") -> DataFrame:
    """uid, template: the structure with the least statistic, ties by name."""
    least = F.min(F.struct(F.round(statistic, 4).alias("_r"), "template"))
    return scores.groupBy(key).agg(least.alias("_b")).select(key, F.col("_b.template").alias("template"))
