from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
from compare import connection, difference
from pyspark.sql import functions as F

from wattweave.llm import mixing
from wattweave.llm.queries import ORACLES, op8_source_mixing


def test_quotas_are_those_of_the_highest_quotients():
    rng = np.random.default_rng(0)
    for _ in range(50):
        votes, seats = rng.integers(0, 50, rng.integers(1, 7)).astype(float), int(rng.integers(0, 60))
        want = np.zeros(len(votes), dtype=int)
        for _ in range(seats if votes.sum() else 0):
            want[np.argmax(votes / (2 * want + 1))] += 1
        assert mixing.sainte_lague(votes, seats).tolist() == want.tolist()


def test_targets_stop_at_three_sizes():
    sizes, weights = np.array([10.0, 100.0, 100.0]), np.array([5.0, 2.0, 1.0])
    t = mixing.targets(sizes, weights, 210.0)
    assert t[0] == 30 and abs(t[1] - 120) < 1e-9 and abs(t[2] - 60) < 1e-9
    assert mixing.targets(np.zeros(2), np.ones(2), 0.0).tolist() == [0, 0]


def brute(rows, seed=7, shard=mixing.SHARD, block=mixing.BLOCK):
    """taken of every (id, size, source) with distinct ids, each quotient and each token handed out on its own."""
    md5 = lambda *parts: hashlib.md5(":".join(map(str, (seed, *parts))).encode()).hexdigest()
    order = sorted({s for _, _, s in rows})
    sizes = np.array([sum(n for _, n, s in rows if s == x) for x in order])
    target = mixing.targets(sizes.astype(float), np.array([mixing.CYCLE[i % 3] for i in range(len(order))], float), float(sizes.sum()))

    def hand_out(votes, limits, seats):
        quotients = sorted((-v / (2 * k + 1), i) for i, (v, most) in enumerate(zip(votes, limits, strict=True)) for k in range(most) if v > 0)
        return [sum(i == x for _, i in quotients[:seats]) for x in range(len(votes))]

    taken = {}
    for rank, (source, seats) in enumerate(zip(order, hand_out(target.tolist(), (3 * sizes).tolist(), int(round(target.sum()))), strict=True)):
        dealt = defaultdict(list)
        for i, n, s in rows:
            if s == source:
                dealt[int(md5(i)[:15], 16) % max(1, -(-int(sizes[rank]) // shard))].append((md5(i), i, n))
        parts = sorted(dealt)
        votes = [sum(n for _, _, n in dealt[p]) for p in parts]
        for part, quota in zip(parts, hand_out(votes, [3 * v for v in votes], seats), strict=True):
            stream = [i for _, i, n in sorted(dealt[part]) for _ in range(n)]
            whole, rest = divmod(quota, len(stream)) if stream else (0, 0)
            taken |= {i: whole * n for _, i, n in dealt[part]}
            blocks = [stream[a : a + block] for a in range(0, len(stream), block)]
            drawn = [i for k in sorted(range(len(blocks)), key=lambda k: md5(rank, part, k)) for i in blocks[k]]
            for i in drawn[:rest]:
                taken[i] += 1
    return taken


def test_drawn_blocks_are_those_of_the_brute_force(spark, sf, docs):
    given = [(r["doc_id"], len((r["text"] or "").encode().split()), r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r["doc_id"]: r["taken"] for r in op8_source_mixing(spark, sf).collect()} == brute(given)
    made = [(i, (i * 37) % 23, f"s{i % 3}") for i in range(90)]
    df = docs([(i, "w " * n, "en", s) for i, n, s in made])
    got = {r["id"]: r["taken"] for r in mixing.plan_mix(df, shard=60, block=8).collect()}
    assert got == brute(made, shard=60, block=8)


def test_stage_keeps_columns_that_clash(spark, docs):
    df = docs([(1, "a b c", "en", "s"), (2, None, "en", "s"), (None, "d e", "en", None), (3, "", None, "s")])
    df = df.withColumns({c: F.lit(c) for c in ("_size", "_taken", "_copy", "size", "key", "rank", "file", "row", "__file__")})
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    rows = mixed.collect()
    assert {(r["doc_id"], r["_copy"], r["_size"], r["__file__"]) for r in rows} <= {(i, "_copy", "_size", "__file__") for i in (1, None)} and rows
    assert mixing.mix(df.where("false")).count() == 0


def test_matches_duckdb(spark, sf):
    assert difference(op8_source_mixing(spark, sf), connection(sf), ORACLES["op8_source_mixing"]) == ""


def test_whole_table(spark, sf):
    rows = op8_source_mixing(spark, sf).collect()
    again = op8_source_mixing(spark, sf).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    texts = {r["doc_id"]: (len((r["text"] or "").encode().split()), r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == {i: n for i, (n, _) in texts.items()}
    taken, size, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        s = texts[r["doc_id"]][1]
        taken[s] += r["taken"]
        size[s] += r["size"]
        target[s] = (r["source_size"], r["target"])
        assert 0 <= r["taken"] <= 3 * r["size"]
    order = sorted(size)
    want = mixing.targets(np.array([size[s] for s in order], float), np.array([mixing.CYCLE[i % 3] for i in range(len(order))], float), float(sum(size.values())))
    for s, t in zip(order, want, strict=True):
        assert target[s] == (size[s], target[s][1]) and abs(target[s][1] - t) < 1e-6 and abs(taken[s] - t) <= 0.02 * t + 2


def test_edges(spark, docs, clash):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "x y z", "en", None), (4, "x  y\tz w", "en", "b"), (4, "x  y\tz w", "en", "b"), (None, "q r", "en", "b"), (6, "w " * 50_000, "en", "c")]
    out = mixing.plan_mix(clash(docs(rows))).collect()
    assert len(out) == len(rows) and {r["id"]: r["size"] for r in out} == {1: 0, 2: 0, 3: 3, 4: 4, None: 2, 6: 50_000}
    assert all(r["target"] == 0 and r["taken"] == 0 for r in out if r["id"] in (1, 2)) and all(r["taken"] == 9 for r in out if r["id"] == 3)
    assert mixing.plan_mix(docs([])).count() == 0 and mixing.mix(docs([])).count() == 0


def test_mixed_rows_hold_what_was_taken(spark, docs):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(5 + i)), "en", f"s{i % 3}") for i in range(30)]
    plan = {r["id"]: r["taken"] for r in mixing.plan_mix(docs(rows)).collect()}
    mixed = mixing.mix(docs(rows))
    assert mixed.columns == docs(rows).columns
    words = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert words == {i: n for i, n in plan.items() if n}
    texts = dict(r[:2] for r in rows)
    assert all(texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in mixed.collect())
