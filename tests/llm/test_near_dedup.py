from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from wattweave.llm import near_dedup as nd
from wattweave.llm.components import connected_components
from wattweave.llm.queries import op3_minhash_near_dedup


def brute(rows, percent=85):
    sets = {i: nd.shingle_set(nd.words_of(t)) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    for own in held.values():
        common.update((a, b) for k, a in enumerate(own) for b in own[k + 1 :])
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_whole_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(op3_minhash_near_dedup(spark, sf)) == brute(rows)


def test_groups_of_edited_copies(spark, docs):
    """Copies with few edits hang together, also where only a chain of them links the ends; copies with many don't."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, base = [], [rng.choice(vocabulary) for _ in range(200)]
    for i in range(150):
        text = base[:]
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            text[rng.randrange(200)] = rng.choice(vocabulary)
        rows.append((1000 + i, " ".join(text)))
    chain = [rng.choice(vocabulary) for _ in range(150)]
    for i in range(12):
        chain = chain[:]
        chain[rng.randrange(150)] = rng.choice(vocabulary)
        rows.append((500 - i, " ".join(chain)))
    rows += [(i, " ".join(rng.choice(vocabulary) for _ in range(120))) for i in range(40)]
    assert result(nd.near_duplicates(docs(rows))) == brute(rows)


def test_edges(spark, docs, clash):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one\tTWO"), (6, "one two three four five six"), (7, "Ä b c d e"), (8, "ä b c d e"), (9, "x " * 300_000), (12, "one two"), (12, "one two")]
    out = nd.near_duplicates(clash(docs(rows)))
    got = result(out)
    assert out.count() == len(rows)
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True)
    assert got[4] == (1, 4, True) and got[5] == (1, 4, False) and got[12] == (1, 4, False)
    assert got[7][1] == 7 and got[8][1] == 8 and got[9] == (1, 9, True) and got[6][0] == 2
    assert nd.near_duplicates(docs([])).count() == 0
    null_id = nd.near_duplicates(docs([(None, "a b c"), (2, "a b c")])).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in null_id} == {(None, None, False), (2, 2, True)}
    assert sorted(r["doc_id"] for r in nd.drop_near_copies(docs(rows[:5])).collect()) == [1, 2, 3, 4]


def test_hashes_tell_shingles_apart_and_signatures_estimate():
    rng = random.Random(1)
    words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(3000)]
    text = " ".join(words)
    vocabulary = nd.Vocabulary()
    for t, k in ((text, 5), (text, 2), ("a b", 5), ("a", 1), ("x " * 9, 5), (" ".join(f"v{i}" for i in range(70_000)), 5)):
        n, hashes = nd.shingle_hashes(t, vocabulary, k)
        assert n == len(hashes) == len(nd.shingle_set(nd.words_of(t), k))
    a, b = np.unique(np.random.default_rng(1).integers(0, 2**63, 2000)).astype(np.uint64), None
    b = np.concatenate([a[:1400], np.random.default_rng(2).integers(0, 2**63, 600).astype(np.uint64)])
    agree = (nd.signature(a, 2000) == nd.signature(b, 2000)).mean()
    assert abs(agree - 1400 / 2600) < 0.05


def test_texts_that_collide_under_polynomial_hashes_stay_apart(spark, docs):
    """Thue-Morse strings and their complements: equal modulo 2^64 under any polynomial hash."""
    t = "a"
    for _ in range(11):
        t += t.translate(str.maketrans("ab", "ba"))
    other = t.translate(str.maketrans("ab", "ba"))
    rows = [(1, t), (2, other), (3, f"{t} x y z w"), (4, f"{other} x y z w"), (5, t)]
    assert result(nd.near_duplicates(docs(rows))) == brute(rows)


def test_members_are_compared_in_full(spark, docs, monkeypatch):
    """With digests that all collide, sets are still told apart and equal ones found."""
    features = nd._features

    def colliding(k, bands, rows):
        def out(batches):
            for batch in features(k, bands, rows)(batches):
                digest = nd.pa.array([None if d is None else b"same" for d in batch.column(2).to_pylist()], nd.pa.binary())
                yield nd.pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digest, batch.column(3)], names=batch.schema.names)

        return out

    monkeypatch.setattr(nd, "_features", colliding)
    rows = [(i, " ".join(f"w{k}_{j}" for j in range(30))) for i, k in enumerate([0, 1, 0, 2, 1, 3, 0])] + [(90, None), (91, "")]
    assert result(nd.near_duplicates(docs(rows))) == brute(rows)


def test_rows_that_share_an_id_are_one_node(spark, docs):
    words = lambda k: " ".join(f"w{k}_{j}" for j in range(40))
    edited = words(2).replace("w2_39", "new")
    rows = [(7, words(1)), (12, words(1)), (12, words(2)), (13, edited), (12, words(1)), (14, words(3)), (14, None), (20, words(4)), (21, words(5)), (20, words(5))]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in nd.near_duplicates(docs(rows)).collect()}
    assert got == {(7, 7, True), (12, 7, False), (13, 7, False), (14, 14, True), (20, 20, True), (21, 20, False)}


def test_stage_keeps_columns_that_clash(spark, docs):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, "a b c d e f"), (4, "")]
    df = docs(rows).withColumns({c: F.lit(c) for c in ("gone", "_gone", "node", "n", "bands")})
    kept = nd.drop_near_copies(df)
    assert kept.columns == df.columns and {(r["doc_id"], r["_gone"], r["n"]) for r in kept.collect()} == {(i, "_gone", "n") for i in (1, 3, None, 4)}
    assert nd.drop_near_copies(df.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(500, x) for x in range(300, 400)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["component_id"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    root = {x: x for p in links for x in p if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root if any(x in p and p[0] != p[1] and None not in p for p in links)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
