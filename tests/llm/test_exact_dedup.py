from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from wattweave.llm import exact_dedup
from wattweave.llm.common import scratch_path
from wattweave.llm.queries import op4_exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return {(i, min(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in op4_exact_dedup(spark, sf).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_edges(spark, docs, clash):
    rows = [(5, "a  b"), (3, "a\tb"), (4, "a\n\r b"), (9, None), (8, ""), (7, "a b "), (1, "x" * 200_000), (2, "x" * 200_000), (10, "a b"), (3, "a\tb")]
    out = exact_dedup.exact_dedup(clash(docs(rows))).collect()
    by = defaultdict(list)
    for r in out:
        by[r["id"]].append(r)
    assert len(out) == len(rows) and all(r["keep_id"] == 3 and r["group_size"] == 4 for i in (3, 4, 5) for r in by[i])
    assert [r["kept"] for r in by[3]].count(True) == 1  # one of the repeated rows
    assert by[8][0]["kept"] and by[9][0]["keep_id"] == 8 and by[7][0]["kept"] and by[10][0]["kept"]
    assert by[2][0]["keep_id"] == 1 and not by[2][0]["kept"]
    assert exact_dedup.exact_dedup(docs([])).count() == 0
    kept = exact_dedup.drop_exact_copies(docs(rows))
    assert kept.columns == docs(rows).columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 7, 8, 10]


def test_colliding_digests_are_told_apart_by_their_bytes(spark, docs):
    rows = [(i, t) for i, t in enumerate(["aa", "bb", "aa", "cc", "bb", "long", "aa", None, ""])]
    out = exact_dedup.exact_dedup(docs(rows), digest=lambda c: F.length(c).cast("string"))
    got = {(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in out.collect()}
    assert got == {(i, k, n, i == k) for i, k, n, _ in brute(rows)}


def test_state_goes_on_over_runs(spark, docs):
    arrivals, checkpoint = scratch_path(spark, "arrivals"), scratch_path(spark, "state")
    digest = exact_dedup.sha256_hex(F.col("text"))
    for part in ([(4, "a"), (5, "b")], [(1, "a"), (6, "c"), (7, "c")]):
        docs(part).select(F.col("doc_id").alias("id"), digest.alias("digest"), F.lit("f").alias("file"), F.col("doc_id").alias("row")).write.mode("append").parquet(arrivals)
        exact_dedup.update_state(arrivals, checkpoint, spark, files_per_batch=1)
    got = {(r["first"]["id"], r["arrivals"]) for r in exact_dedup.read_state(checkpoint, spark).collect()}
    assert got == {(1, 2), (5, 1), (6, 2)}
