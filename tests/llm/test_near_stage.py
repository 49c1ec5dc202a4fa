"""The pipeline's stage of near copies, at its own threshold."""

from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F
from test_near_dedup import brute as near

from wattweave.llm import near_dedup as nd
from wattweave.llm.common import table


def test_near_copies_from_80_percent_go(spark, sf, docs):
    """A copy of 200 words with four scattered words changed shares 176 of 216 shingles, one with five changed 171 of 221."""
    rng = random.Random(5)
    rows = []
    for i in range(20):
        text = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows.append((10 * i, " ".join(text)))
        for edits in (4, 5):
            rows.append((10 * i + edits, " ".join(f"x{i}_{edits}_{k}" if k in range(20, 20 + 30 * edits, 30) else w for k, w in enumerate(text))))
    near_stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    got = {r["doc_id"] for r in near_stage(spark, docs(rows), sf).collect()}
    assert got == {i for i, (_, _, stays) in near(rows, 80).items() if stays} == {10 * i + k for i in range(20) for k in (0, 5)}
    given = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    got = {r["doc_id"] for r in near_stage(spark, table(spark, sf, "documents"), sf).collect()}
    assert got == {i for i, (_, _, stays) in near(given, 80).items() if stays}


def test_parts_bound_intersections(spark):
    """What parts leave possible is never below the true intersection, and near it; ids with several texts have no parts."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    rows = [(i, " ".join(w if rng.random() > i / 40 else f"x{rng.randrange(10**6)}" for w in base)) for i in range(12)]
    rows += [(90, ""), (91, None), (92, "one"), (93, " ".join(f"y{j}" for j in range(40_000))), (94, "a b"), (94, "b a")]
    texts = spark.createDataFrame(rows, "id long, text string")
    parts = nd.filled_parts(texts, 5)
    assert {r["node"] for r in parts.collect()} == {i for i, _ in rows} - {94}
    a = parts.select(F.col("node").alias("a"), F.col("parts").alias("pa"))
    b = parts.select(F.col("node").alias("b"), F.col("parts").alias("pb"))
    sets = {i: nd.shingle_set(nd.words_of(t)) for i, t in rows}
    slack = []
    for r in a.join(b, F.col("a") != F.col("b")).select("a", "b", nd.unshared("pa", "pb").alias("gone")).collect():
        own, other = sets[r["a"]], sets[r["b"]]
        assert len(own & other) <= len(own) - r["gone"]
        if max(r["a"], r["b"]) < 12:
            slack.append(len(own) - r["gone"] - len(own & other))
    assert sum(slack) / len(slack) < 40
    unknown = parts.limit(1).select("parts", F.lit(None).cast("array<bigint>").alias("none"))
    assert unknown.select(nd.unshared("parts", "none").alias("n")).first()["n"] == 0
