from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from wattweave.llm import embed_join
from wattweave.llm.queries import op6_embedding_near_dedup


def brute(rows, threshold=0.98):
    root, degree, groups = {r[0]: r[0] for r in rows if r[0] is not None}, defaultdict(int), defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            groups[label, len(v)].append((i, np.array(v, float)))
    for own in groups.values():
        for k, (a, x) in enumerate(own):
            for b, y in own[:k]:
                if x @ y >= threshold * np.linalg.norm(x) * np.linalg.norm(y):
                    degree[a] += 1
                    degree[b] += 1
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {i: (degree[i], find(i), find(i) == i) for i in root}


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert result(op6_embedding_near_dedup(spark, sf)) == brute(rows)


def test_planted_pairs_and_edges(spark, clash):
    rng = np.random.default_rng(0)
    rows = []
    for dim in (64, 24, 5):
        for _ in range(40):
            base = rng.normal(size=dim)
            for scale in (0.0, 0.02, 0.15, 0.2, 0.25):  # about the threshold
                step = rng.normal(size=dim)
                step *= scale * np.linalg.norm(base) / np.linalg.norm(step)
                rows.append((len(rows), [float(np.float32(x)) for x in rng.uniform(0.5, 2) * (base + step)], int(rng.integers(0, 2))))
    n = len(rows)
    rows += [(n + 1, None, 1), (n + 2, [], 1), (n + 3, [0.0] * 64, 1), (n + 4, [float("nan")] * 64, 1), (n + 5, [1.0, None], 1), (n + 6, rows[0][1], None), (n + 7, rows[0][1], rows[0][2]), (n + 8, rows[0][1], rows[0][2]), (n + 9, [float("inf"), 1.0], 1), (None, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = embed_join.near_duplicate_vectors(clash(df))
    assert out.count() == len(rows)
    got = result(out)
    assert got.pop(None) == (0, None, False)
    assert got == brute(rows)
    assert embed_join.near_duplicate_vectors(df.where("false")).count() == 0


def test_a_group_of_copies_counts_its_members(spark):
    v = spark.range(300).select(F.col("id").alias("vec_id"), F.array(*[F.lit(float(x)).cast("float") for x in range(1, 9)]).alias("embedding"), F.lit(1).alias("label"))
    assert {(r["n_links"], r["component_id"]) for r in embed_join.near_duplicate_vectors(v).collect()} == {(299, 0)}
