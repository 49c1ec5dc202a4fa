"""The pipeline against stages written out in plain Python."""

from __future__ import annotations

import re
import zlib

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from test_exact_dedup import brute as exact
from test_language_id import brute as language
from test_mixing import brute as mixed
from test_near_dedup import brute as near
from test_packing import check
from tokenizers import Tokenizer

from wattweave.llm import tokenise
from wattweave.llm.common import table


def expected(rows):
    """The documents (id, text, lang, source) that each stage but the last leaves, by stage name."""
    out = {}
    told = language([(i, t, x) for i, t, x, _ in rows])
    rows = out["language_id"] = [r for r, (lang, score) in zip(rows, told, strict=True) if lang != "und" and score >= 0.5]
    stay = {i for i, k, _, _ in exact([r[:2] for r in rows]) if i == k}
    rows = out["exact_dedup"] = [r for r in rows if r[0] in stay]
    stay = {i for i, (_, _, kept) in near([r[:2] for r in rows], 80).items() if kept}
    rows = out["near_dedup"] = [r for r in rows if r[0] in stay]
    sizes = {i: len(t.encode().split()) for i, t, _, _ in rows}
    taken = mixed([(i, sizes[i], s) for i, _, _, s in rows])
    out["mix_sources"] = []
    for i, text, lang, source in rows:
        whole, part = divmod(taken[i], sizes[i])
        out["mix_sources"] += [(i, text, lang, source)] * whole
        if part:
            cut = "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", text)[:part])
            out["mix_sources"].append((i, cut, lang, source))
    return out


def rows_of(docs):
    return sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect())


def test_stages_and_run(spark, sf):
    docs = table(spark, sf, "documents")
    want, columns = expected([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]), docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf)
        path = corpus_pipeline.scratch_path(spark, name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        assert rows_of(docs) == sorted(want[name]), name
    plain = Tokenizer.from_file(public_tokenizers.path(tokenise.TOKENIZER))
    rows = corpus_pipeline.run(spark, sf).collect()
    texts = [r[:2] for r in want["mix_sources"]]
    total = sum(r["length"] for r in rows)
    assert check(rows, texts, plain) <= 1.02 * -(-total // 2048)
    assert [s[0] for s in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "pack_sequences"]


def test_run_on_odd_tables(spark, docs, tmp_path):
    """Nulls, repeated rows and further columns that clash; then no row at all."""
    english, german = "the cat sat on the mat and then it ran away", "der hund lief über die straße und bellte laut"
    rows = [(i, f"{english} w{i} x{i} y{i}", "en", f"s{i % 2}") for i in range(20)] + [(i, f"{german} u{i} v{i} z{i}", "de", None) for i in range(20, 40)]
    rows += [(50, None, "en", "s0"), (51, "", None, None), (52, "12 !!", "en", "s1"), (None, f"{english} w x y", None, "s0"), (3, f"{english} w3 x3 y3", "en", "s1")]
    names = ("_gone", "gone", "_size", "size", "_taken", "taken", "_copy", "copy", "__file__", "file", "row", "guess", "node", "_metadata")
    df = docs(rows).withColumns({c: F.lit("x") for c in names})
    df.write.parquet(f"{tmp_path}/a/documents.parquet")
    df.where("false").write.parquet(f"{tmp_path}/b/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert {r["doc_id"] for r in got} <= {r[0] for r in rows} - {50, 51, 52} and sum(r["length"] for r in got) > 100
    assert all(r["ids_crc32"] != zlib.crc32(b"") for r in got)
    stages = dict(corpus_pipeline.STAGES)
    for name in ("language_id", "exact_dedup", "near_dedup", "mix_sources"):
        kept = stages[name](spark, df, "")
        assert kept.columns == df.columns and {r["_gone"] for r in kept.collect()} == {"x"}, name
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
