from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wattweave.llm import packing, tokenise
from wattweave.llm.queries import op5_best_fit_packing

ODD = ["", " \n", "don't", "it's 3x", "<|endoftext|> a", "x<|startoftext|>", "İstanbul ΟΔΟΣ", "²x Ⅷ ½", "a\x1cb c", "a\u0085b c", "é é", "...,!? _a_", "Straße ŉ ſ K", "日本語 text", "a.b,c", "!!"]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path(tokenise.TOKENIZER))


def want(plain, text):
    return np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def test_ids_are_the_tokenizers(plain):
    table = tokenise.words()
    assert table.split_at_space
    ids, bounds = table.encode(pa.array(ODD))
    for i, text in enumerate(ODD):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=6))
def test_ids_of_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, bounds = tokenise.words().encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tobytes() == tokenise.words().whole(t)


def test_other_tokenizer_files_go_the_plain_way():
    table = tokenise.words(public_tokenizers.path("byte_bpe_50k.json"))
    ids, bounds = table.encode(pa.array(["Hello  there", ""]))
    assert not table.split_at_space and ids.tobytes() == table.whole("Hello  there") and bounds.tolist()[1:] == [len(ids)] * 2


def check(rows, texts, plain, capacity=packing.CAPACITY):
    """Every piece is there with its ids, and sequences are gapless and no longer than they may be."""
    cut = sorted((i, p, s, n, zlib.crc32(w[s : s + n])) for i, t in texts for w in [want(plain, t)] for p, s, n in ((k, b, min(capacity, len(w) - b)) for k, b in enumerate(range(0, len(w), capacity))))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == cut
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_whole_table(spark, sf, plain):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op5_best_fit_packing(spark, sf).collect()
    total = sum(r["length"] for r in rows)
    assert check(rows, texts, plain) <= 1.02 * -(-total // packing.CAPACITY)


def test_edges(spark, docs, clash, plain):
    texts = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "word " * 9000), (5, "b"), (6, " ".join(["x"] * 2047)), (7, " ".join(["x"] * 2048))]
    check(packing.pack(clash(docs(texts))).collect(), texts, plain)
    check(packing.pack(docs(texts), capacity=4).collect(), texts, plain, 4)
    assert packing.pack(docs([])).count() == 0


def test_exact_complements_are_used():
    rows = packing.plan({7: 3, 3: 3, 4: 2, 2: 2, 1: 2, 5: 1, 6: 1}, 10)
    used = defaultdict(int)
    for length, _, times, sequence, _ in rows:
        for k in range(times):
            used[sequence + k] += length
    assert sum(length * times for length, _, times, _, _ in rows) == 55 and len(used) == 6 and max(used.values()) == 10


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), min_size=1, max_size=12))
def test_plans_place_every_piece_once(counts):
    rows = packing.plan(counts, 30)
    ranks, filled = defaultdict(set), defaultdict(list)
    for length, first, times, sequence, offset in rows:
        for k in range(times):
            assert first + k not in ranks[length]
            ranks[length].add(first + k)
            filled[sequence + k].append((offset, length))
    assert {x: len(r) for x, r in ranks.items()} == counts and all(r == set(range(len(r))) for r in ranks.values())
    for own in filled.values():
        ends = [0, *np.cumsum([n for _, n in sorted(own)]).tolist()]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 30
