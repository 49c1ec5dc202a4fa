"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in Arrow batches, adds the counts up in
Spark, and turns them into one matrix of log-probabilities (languages
x buckets), which is broadcast. Scoring hashes the n-grams of a batch of whole
texts in numpy, looks their rows up and adds them for each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, spare

ORDERS = (2, 3)
BUCKETS = 1 << 16
#: Code points hashed at once; longer texts are taken in pieces of this size.
CHUNK = 1 << 19
UNKNOWN = "und"
#: Labels that a model may have; each takes half a megabyte.
LABELS = 500


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), dtype=np.bool_)


def points(text: str) -> np.ndarray:
    """Lower-cased code points; whatever isn't a letter is 32, as are both ends."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(_letters()[raw], raw, np.uint32(32))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, position of the first code point) of the n-grams of each order.

    n-grams with a break between two of their letters don't count, nor do those
    without a letter.
    """
    letter = codes != 32
    with np.errstate(over="ignore"):
        for n in ORDERS:
            m = len(codes) - n + 1
            if m <= 0:
                continue
            h = np.full(m, 0x9E3779B9 * n & 0xFFFFFFFF, dtype=np.uint32)
            for i in range(n):
                h = (h ^ codes[i : i + m]) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
            h *= np.uint32(0xC2B2AE35)
            ok = letter[:m] | letter[1 : m + 1] if n == 2 else letter[1 : m + 1]
            at = np.flatnonzero(ok)
            yield (h[at] >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64), at


@dataclass(frozen=True)
class Model:
    labels: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # labels x BUCKETS

    def totals(self, texts: list[str]) -> np.ndarray:
        """Summed log-probabilities of each text's n-grams."""
        sums = np.zeros((len(texts), len(self.labels)))
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at + len(group) < len(texts) and (not group or size + len(texts[at + len(group)]) <= CHUNK):
                group.append(points(texts[at + len(group)]))
                size += len(group[-1])
            rows = slice(at, at + len(group))
            codes, starts = np.concatenate(group), np.cumsum([0, *map(len, group)])
            for begin in range(0, len(codes), CHUNK):  # one very long text: pieces, which overlap by n - 1
                for n, (bucket, pos) in zip(ORDERS, grams(codes[begin : begin + CHUNK + max(ORDERS) - 1]), strict=False):
                    keep = pos < CHUNK if len(codes) > CHUNK else slice(None)
                    bucket, pos = bucket[keep], pos[keep] + begin
                    cut = np.searchsorted(pos, starts)
                    filled = np.flatnonzero(np.diff(cut))
                    if len(filled):
                        for i, row in enumerate(self.log_prob):
                            sums[rows.start + filled, i] += np.add.reduceat(row.take(bucket), cut[filled])
            at += len(group)
        return sums

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The label of the highest posterior and that posterior."""
        sums = self.totals(texts) + self.log_prior
        sums -= sums.max(axis=1, keepdims=True)
        p = np.exp(sums)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return np.array(self.labels, dtype=object)[best], p[np.arange(len(texts)), best]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for label, texts in batch.groupby("label")["text"]:
            row = held.setdefault(label, np.zeros(BUCKETS, dtype=np.int64))
            codes = np.concatenate([points(t) for t in texts])
            for begin in range(0, len(codes), CHUNK):
                for bucket, pos in grams(codes[begin : begin + CHUNK + max(ORDERS) - 1]):
                    row += np.bincount(bucket[pos < CHUNK], minlength=BUCKETS)
    for label, row in held.items():
        at = np.flatnonzero(row)
        yield pd.DataFrame({"label": label, "bucket": at, "n": row[at]})


def train(
    labelled: DataFrame, text_col: str = "text", label_col: str = "lang", key: Column | None = None,
    rows_per_label: int = 4000, smoothing: float = 0.5, max_labels: int = LABELS,
) -> Model | None:
    """Fit the model on at most about ``rows_per_label`` rows of each label.

    Rows are chosen by a hash of ``key`` (the text where none is given), at a
    rate for each label that makes ``rows_per_label`` the expected count; labels
    with fewer rows use all of theirs. Priors are the shares of all labelled rows
    with a text. Rows with a null label or a null text teach nothing, those
    without a letter only their label's prior. The driver gets labels x BUCKETS
    counts at most, whatever the input's size; more than ``max_labels`` labels are
    an error. Without any labelled row there is no model: None.
    """
    rows = labelled.select(
        col(label_col).cast("string").alias("label"),
        col(text_col).alias("text"),
        (F.xxhash64(col(text_col)) if key is None else F.xxhash64(key.cast("string"))).alias("h"),
    ).where("label IS NOT NULL AND text IS NOT NULL")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(max_labels + 1).collect()}
    if len(sizes) > max_labels:
        raise ValueError(f"more than {max_labels} labels: raise max_labels, or clean the labels")
    if not sizes:
        return None
    whole = 1 << 30
    rates = F.create_map(*[F.lit(x) for label, n in sizes.items() for x in (label, int(min(1.0, rows_per_label / n) * whole))])
    counts = (
        rows.where(F.pmod("h", F.lit(whole)) < rates[F.col("label")])
        .select("label", "text")
        .mapInPandas(_count, "label string, bucket int, n long")
        .groupBy("label", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    labels = sorted(sizes)
    seen = np.full((len(labels), BUCKETS), smoothing)
    seen[counts["label"].map({x: i for i, x in enumerate(labels)}), counts["bucket"]] += counts["n"]
    prior = np.array([sizes[x] for x in labels], dtype=float)
    return Model(labels, np.log(prior / prior.sum()), np.log(seen / seen.sum(axis=1, keepdims=True)))


def identify(spark: SparkSession, model: Model | None, text: Column) -> Column:
    """struct<lang string, score double> of a text column.

    ``und`` with score 0 where the text is null or has no letter, or where there
    is no model; otherwise the learned label with the highest posterior (the
    first in code point order on a tie) and that posterior, in 0..1: plain naive
    Bayes over all n-grams of the whole text, whatever its length. As n-grams
    count as independent, the posterior of a long text is near 1 even where few
    of them speak for the label.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        for batch in batches:
            lang, value = np.full(len(batch), UNKNOWN, dtype=object), np.zeros(len(batch))
            at = [i for i, t in enumerate(batch) if fitted is not None and has_letter(t)]
            if at:
                lang[at], value[at] = fitted.predict([batch.iloc[i] for i in at])
            yield pd.DataFrame({"lang": lang, "score": value})

    return score(text)


def held_out(doc_id: Column) -> Column:
    """Whether a document stays out of training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row, learned from the rows not held out.

    A null id is never held out. Repeated rows are predicted each; an empty
    table gives an empty result; other columns aren't read.
    """
    key = col(id_col)
    model = train(docs.where(~held_out(key)), text_col, label_col, key)
    return docs.select(
        key.alias("doc_id"), held_out(key).alias("held_out"), identify(docs.sparkSession, model, col(text_col)).alias("guess")
    ).select("doc_id", "held_out", F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"))


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with their columns whatever their names, whose language is told with posterior ``least`` or more.

    Rows whose text is null or has no letter go; a null id, label or source
    doesn't matter; repeated rows stay or go together. Where no row has a label
    there is no model and no row stays. An empty table stays empty.
    """
    key = F.col("doc_id")
    model = train(docs.where(~held_out(key)), key=key)
    (guess,) = spare(docs, "guess")
    return (
        docs.withColumn(guess, identify(docs.sparkSession, model, F.col("text")))
        .where((F.col(f"{guess}.lang") != UNKNOWN) & (F.col(f"{guess}.score") >= least))
        .select(*map(col, docs.columns))
    )
