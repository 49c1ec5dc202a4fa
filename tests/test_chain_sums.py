"""Chain statistics are sums rounded once, whatever the order of their terms, and need no shuffle beyond that of the counts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from wattweave.plans import chains


def test_sums_are_rounded_once(spark):
    rng = np.random.default_rng(1)
    groups = [[float(x) for x in rng.random(9) * 10.0 ** rng.integers(-3, 9, 9)] for _ in range(300)]
    rows = [(g, x) for g, terms in enumerate(groups) for x in terms]
    got = spark.createDataFrame(rows, "g int, x double").groupBy("g").agg(chains._level_sum(F.col("x")).alias("s")).collect()
    assert {r["g"]: r["s"] for r in got} == {g: math.fsum(terms) for g, terms in enumerate(groups)}


def test_counts_by_series_are_not_dealt_again(spark):
    counts = spark.createDataFrame([(u, a, b, 1 + u + a * b) for u in range(5) for a in (1, 2, 3) for b in (1, 2)], "uid int, from int, to int, n long").repartition(4, "uid")
    plan = chains.chain_chi2(counts, chains.chain_templates(spark, 3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(uid") == 1  # all others are of the few structures
