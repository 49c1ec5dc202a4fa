from __future__ import annotations

import random
import re
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import difference

from wattweave.llm import license_rules, licenses
from wattweave.llm.queries import ORACLES, op13_license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans(licenses.UPPER, licenses.LOWER)


def brute(text):
    """(words, base places, detections left) with plain loops over words."""
    words = WORD.findall((text or "").translate(ASCII))
    base = sorted((i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    line, starts = "".join(f" {w} " for w in words), {}
    at = 0
    for i, w in enumerate(words):
        starts[at] = i
        at += len(w) + 2
    starts[at] = len(words)
    found = [(starts[m.start()], starts[m.end()], rank, r.priority, r.label) for rank, r in enumerate(license_rules.rules()) for m in re.finditer(r.pattern, line)]
    gone = lambda x: any(y[0] <= x[0] and y[1] >= x[1] and (y[3] < x[3] or y[3] == x[3] and (y[0] - y[1], y[2]) < (x[0] - x[1], x[2])) for y in found)
    return len(words), base, sorted(x for x in found if not gone(x))


def same(row, text):
    n, base, found = brute(text)
    assert row["n_words"] == n and [tuple(d) for d in row["detections"]] == found, repr(text)[:300]
    for b in row["base"]:
        places = [i for i, label in base if label == b["label"]]
        assert (b["n"], b["first"], b["last"]) == (len(places), places[0], places[-1])
    assert {b["label"] for b in row["base"]} == {label for _, label in base}
    trust = [license_rules.TRUST[d[3]] for d in found] + [license_rules.TRUST[-1]] * bool(base)
    assert row["score"] == max(trust, default=0.0)


def test_rules():
    rules = license_rules.rules()
    assert len(rules) > 300 and len({(r.label, r.pattern) for r in rules}) == len(rules)
    for r in rules:
        assert r.pattern[0] == r.pattern[-1] == " " and r.keyword.strip() and r.stem[0] == " "
    assert [r.priority for r in rules] == sorted(r.priority for r in rules)


def test_sample_lines(spark, docs):
    lines = {
        "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\")": "apache-2.0",
        "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
        "neither the name of the Regents nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3-clause",
        "http://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa-4.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999": "lgpl-2.1",
        "This is free and unencumbered software released into the public domain.": "unlicense",
    }
    rows = dict(enumerate(lines))
    for r in licenses.scan_licenses(docs(list(rows.items()))).collect():
        assert lines[rows[r["id"]]] in {d["label"] for d in r["detections"]}, rows[r["id"]]
        same(r, rows[r["id"]])
    # the longer and the stronger stand, what they contain goes
    assert [(a, e, p, label) for a, e, _, p, label in brute("SPDX-License-Identifier: MIT License")[2]] == [(0, 4, 0, "mit"), (3, 5, 3, "mit")]
    assert {x[4] for x in brute("gnu general public license version 3")[2]} == {"gpl-3.0"}


def test_random_words(spark, docs, clash):
    rng = random.Random(5)
    words = "gnu general public license apache mit cc by nc sa 4 0 2 version v2 spdx identifier gpl 3 under the terms of licensed released creative commons attribution bsd clause é ſ x software".split()
    gaps = [" ", ", ", "\n\n", "-", "\t", "\x00", "<b>", " ©"]
    make = lambda n: "".join(rng.choice([w, w.upper(), w.title()]) + rng.choice(gaps) for w in rng.choices(words, k=n))
    rows = [(i, make(rng.randint(0, 40))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \n.;"), (1003, "MIT license " * 3000), (1004, "MİT license KC BY"), (1005, "CC BY"), (1005, "CC BY"), (None, "mit license"), (1006, "mitlicense xmit license"), (1007, make(6000))]
    got = licenses.scan_licenses(clash(docs(rows))).collect()
    assert len(got) == len(rows)
    texts = {}
    for k, text in rows:
        texts[k] = text
    for r in got:
        same(r, texts[r["id"]])
    assert licenses.scan_licenses(docs([])).count() == 0


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_whole_table_against_sql(spark, size):
    data = f"/root/testdata/sf{size}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data}/documents.parquet')")
    assert difference(op13_license_scan(spark, data), con, ORACLES["op13_license_scan"]) == ""
