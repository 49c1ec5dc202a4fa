from __future__ import annotations

import hashlib
import random
import sys
import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import difference

from wattweave.llm import prefix_trie
from wattweave.llm.queries import ORACLES, op11_conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def own_turns(rows):
    found = {}
    for c, turn, role, text in rows:
        if c is not None:
            found.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in found.items()}


def regrafted(turns):
    out = {}
    for c, own in turns.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def brute(turns):
    nodes = {}
    for c, own in turns.items():
        for d in range(len(own) + 1):
            nodes.setdefault(tuple(own[:d]), []).append(c)
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(q[: len(p)] == p and len(q) > len(p) for q in below) for p in below)
        saved = sum((len(nodes[p]) - 1) * len([w for w in p[-1][1].replace("\x0b", " ").split() if w]) for p in below if p)
        ends = sorted(c for c in members if len(turns[c]) == len(path))
        up = min(nodes[path[:-1]]) if path else None
        out.add((min(members), len(path), up, len(members), len(children), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def rows_of(df):
    rows = df.collect()
    found = {tuple(r) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_whole_table_against_sql(spark, size):
    data = f"/root/testdata/sf{size}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{data}/conversations.parquet')")
    assert difference(op11_conversation_trie(spark, data), con, ORACLES["op11_conversation_trie"]) == ""


@pytest.mark.parametrize("shard", [1, 3, 12, 1 << 18])
def test_shards_of_any_size(spark, monkeypatch, shard):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "CHUNK", 9)
    rng = random.Random(shard)
    rows = []
    for c in range(150):
        stop = rng.randint(0, 6)
        rows += [(c, t, "user" if t % 2 else "assistant", rng.choice(["a", "b b", ""])) for t in range(stop)]
    rows += [(200 + c, t, "user", f"same {t}") for c in range(60) for t in range(4)]  # a hot conversation
    rows += [(400, t, "user", f"long {t}") for t in range(300)] + [(401, t, "user", f"long {t}") for t in range(200)]
    got = rows_of(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert got == brute(own_turns(rows))


def test_rebuilt_and_odd_rows(spark, clash):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["x", "y z", None])) for c in range(0, 90) for t in range(rng.randint(1, 5))]
    rows += [(1021, 0, "user", "alone"), (1021, 1, "assistant", "away"), (-25, 0, "user", "x"), (-20, 0, "user", "y z"), (-20, 1, "user", "q")]
    rows += [(5, None, "user", "first"), (5, 0, "user", "tie b"), (5, 0, "user", "tie a"), (5, 0, "user", "tie a"), (None, 0, "user", "nobody's")]
    df = clash(spark.createDataFrame(rows, SCHEMA)).withColumn("words", F.lit("x")).withColumn("shard", F.lit("y"))
    turns = own_turns(rows)
    assert turns[5][0] == ("user", "first")
    assert rows_of(prefix_trie.conversation_trie(df)) == brute(turns)
    assert rows_of(prefix_trie.conversation_trie(df, rebuild=prefix_trie.regraft)) == brute(regrafted(turns))
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "w " * 100_000
    (node,) = [r for r in prefix_trie.conversation_trie(spark.createDataFrame([(1, 0, "user", text), (2, 0, "user", text)], SCHEMA)).collect() if r["depth"]]
    assert node["saved_tokens"] == 100_000


def test_tree():
    rng = random.Random(2)
    lines = sorted({tuple(rng.choices(range(40), k=rng.randint(0, 5))) for _ in range(3000)})
    tree, ends = prefix_trie.build([list(x) for x in lines])
    order = tree.in_order()
    assert sorted(order) == list(range(len(tree.key)))

    def path(node):
        out = []
        while node:
            out.append(tree.key[node])
            node = tree.parent[node]
        return tuple(reversed(out))

    assert [path(e) for e in ends] == lines
    assert [path(x) for x in order] == sorted({x[:d] for x in lines for d in range(len(x) + 1)})
    flat, _ = prefix_trie.build([[k] for k in range(1 << 12)])
    height = [0] * len(flat.key)
    for node in range(1, len(flat.key)):
        for branch in (flat.low[node], flat.high[node]):
            height[branch] = height[node] + 1 if branch else 0
    assert max(height[1:]) <= 13
