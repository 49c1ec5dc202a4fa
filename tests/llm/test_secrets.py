from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from wattweave.llm import secrets
from wattweave.llm.queries import op10_secret_scan

KINDS = (
    ("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)


def brute(text):
    found = [(m.start(), rank, name, m.end()) for rank, (name, p, group, least) in enumerate(KINDS) for m in p.finditer(text or "") if len(m[group]) >= least]
    return [f"{name}:{a}:{b}" for a, _, name, b in sorted(found)]


def test_whole_table(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10_secret_scan(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(w.startswith(k[0]) for w in want) for k in KINDS)
        assert set(want) <= set(r["spans"].split(",")) or not want


def test_random_texts(spark, docs):
    rng = random.Random(4)
    parts = ["token", "Secret", "API_KEY", "apikey", "passwd", "password", ":", "=", " ", "\n", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "é", "😀", "x" * 12, "/+", "ſecret", "toKen"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 25)))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "deadbeefdeadbeef " * 9000), (1003, "token=" * 50 + "a" * 20)]
    out = secrets.scan_secrets(docs(rows)).collect()
    texts = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["rank"] < 3] == brute(texts[r["id"]]), repr(texts[r["id"]])[:200]


def test_ownership_tells_examples_from_live_ones(spark, docs, clash):
    wide, own, forge, copied = "AKIAEXAMPLE12345678", "AKIAOWNER0000000001", "ghp_" + "Zq" * 18, "ghp_" + "Yw" * 18
    rows = [(i, f"key {wide} {copied}", "en", f"s{i % 5}") for i in range(20)] + [(100, f"my {own} {forge}", "en", "s1"), (101, f"my {own}", "en", "s1"), (102, "nothing", None, None)]
    out = {r["id"]: r for r in secrets.scan_secrets(clash(docs(rows))).collect()}
    assert all(not s["live"] for s in out[3]["spans"]) and [s["kind"] for s in out[3]["spans"]] == ["access"]
    assert [(s["kind"], s["live"]) for s in out[100]["spans"]] == [("access", True), ("forge", True)] and out[100]["n_live"] == 2 and out[3]["n_example"] == 1
    assert out[102]["spans"] == []
    assert secrets.scan_secrets(docs([])).count() == 0
    assert secrets.ownership(spark.createDataFrame([], "repository string, owner string, spans array<struct<secret:string>>")).agg(F.count("*")).first()[0] == 0
