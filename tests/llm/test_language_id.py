from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import pyspark.sql.functions as F
import pytest

from wattweave.llm import langid
from wattweave.llm.queries import op1_language_id


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = op1_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95


def test_edges(spark, docs, clash):
    rows = [(i, "the cat sat on the mat and then it ran", "en", None) for i in range(20)] + [(i, "der hund lief über die straße und bellte", "de", "s") for i in range(20, 40)]
    rows += [(50, None, "en", "s"), (51, "", None, "s"), (52, "123 !!", "de", "s"), (None, "the cat", None, None), (54, "über die straße " * 60_000, None, None), (50, None, "en", "s")]
    out = langid.predict_languages(clash(docs(rows)))
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(rows)
    assert [got[i]["lang_pred"] for i in (50, 51, 52)] == ["und"] * 3 and got[50]["score"] == 0
    assert got[None]["lang_pred"] == "en" and got[None]["held_out"] is False and got[54]["lang_pred"] == "de"
    assert langid.predict_languages(docs(rows[:0])).count() == 0
    unlabelled = langid.predict_languages(docs([(1, "abc", None, None)])).first()
    assert unlabelled["lang_pred"] == "und"


def test_long_texts_score_like_their_pieces():
    model = langid.Model(["a", "b"], langid.np.log([0.5, 0.5]), langid.np.log(langid.np.random.default_rng(0).dirichlet(langid.np.ones(langid.BUCKETS), 2)))
    texts = ["ab cd " * 50, "x", "é" * 70, "ab cd " * 300_000, ""]
    alone = langid.np.concatenate([model.totals([t]) for t in texts])
    assert langid.np.allclose(model.totals(texts), alone)
    naive = sum(model.log_prob[:, b].sum(axis=1) for b, _ in langid.grams(langid.points(texts[3])))
    assert langid.np.allclose(alone[3], naive)


def brute(rows):
    """(label, posterior) of every (doc_id, text, lang), n-gram by n-gram in plain Python."""

    def grams(text):
        low = "".join(c if c.isalpha() else " " for c in text.lower())
        padded = [ord(c) for c in f" {low} "]
        for n in (2, 3):
            for i in range(len(padded) - n + 1):
                run = padded[i : i + n]
                if (n == 2 and run != [32, 32]) or (n == 3 and run[1] != 32):
                    h = 0x9E3779B9 * n & 0xFFFFFFFF
                    for c in run:
                        h = (h ^ c) * 0x85EBCA6B & 0xFFFFFFFF
                        h ^= h >> 15
                    yield (h * 0xC2B2AE35 & 0xFFFFFFFF) >> 16

    seen, prior = defaultdict(Counter), Counter()
    for i, text, lang in rows:
        if lang is not None and text is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2):
            prior[lang] += 1
            seen[lang].update(grams(text))
    labels = sorted(prior)
    size = {x: sum(seen[x].values()) + 0.5 * langid.BUCKETS for x in labels}
    logs = {x: {g: math.log((n + 0.5) / size[x]) for g, n in seen[x].items()} for x in labels}
    out = []
    for _, text, _ in rows:
        if not any(map(str.isalpha, text or "")):
            out.append(("und", 0.0))
            continue
        own = list(grams(text))
        said = [math.log(prior[x] / sum(prior.values())) + sum(logs[x].get(g, math.log(0.5 / size[x])) for g in own) for x in labels]
        best = max(range(len(labels)), key=lambda k: said[k])
        out.append((labels[best], 1 / sum(math.exp(v - said[best]) for v in said)))
    return out


def test_whole_table_against_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op1_language_id(spark, sf).collect()}
    for (i, _, _), (lang, score) in zip(rows, brute(rows), strict=True):
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-6


def test_length_does_not_change_the_rule(spark, docs):
    """Steady evidence for the rarer label wins over its prior, and keeps winning as the text gets longer."""
    rows = [(i, "ba ba", "a", "s") for i in range(4, 12)] + [(i, "ab bb", "b", "s") for i in range(100, 500)]
    texts = [(1000 + n, "ba " * n, None, "s") for n in (1, 5, 40, 200, 5_000)]
    got = {r["doc_id"]: r for r in langid.predict_languages(docs(rows + texts)).collect()}
    want = brute([(i, t, x) for i, t, x, _ in rows + texts])[-len(texts) :]
    assert [(got[i]["lang_pred"]) for i, *_ in texts] == [x for x, _ in want] and want[-1][0] == want[-2][0] == "a"
    assert all(abs(got[t[0]]["score"] - p) < 1e-6 for t, (_, p) in zip(texts, want, strict=True))


def test_too_many_labels_are_an_error(spark, docs):
    with pytest.raises(ValueError, match="labels"):
        langid.train(docs([(i, "abc", f"l{i}", "s") for i in range(5)]), max_labels=4)


def test_stage_keeps_columns_that_clash(spark, docs):
    df = docs([(i, "the cat sat", "en", "s") for i in range(8)] + [(99, None, "en", "s"), (None, "the cat", None, None)])
    df = df.withColumns({c: F.lit(c) for c in ("guess", "_guess", "label", "h", "a.b")})
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r["_guess"] for r in kept.collect()} == {"_guess"} and kept.count() == 9
    assert langid.keep_identified(df.where("false")).count() == 0


def test_stage_keeps_clean_documents(spark, docs):
    rows = [(i, "the cat sat on the mat and then it ran away from the dog", "en", "s") for i in range(30)] + [(99, "!!! 123", "en", "s"), (98, None, "en", "s")]
    kept = langid.keep_identified(docs(rows))
    assert kept.columns == docs(rows).columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(30))
    assert kept.where(F.col("text").isNull()).count() == 0
