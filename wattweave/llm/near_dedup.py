"""MinHash near-duplicates with circulant signatures and exact verification.

Two permutations of the 32-bit circle make the whole signature: sigma scatters a
shingle over the circle, and coordinate k is the least pi(sigma(shingle) + k) over
the set, the same pi for every k, shifted around the circle. Bands of the
signature name buckets. A shingle's hash folds the keyed BLAKE2b hashes of its
words. Documents whose sets of hashes have one digest are one node, once each of
them has been compared in full with the node's first document.

Candidates are compared in two steps that never list all pairs of a bucket.
First, every node of a bucket meets the bucket's smallest node; true links are
contracted to components. Second, in buckets that still hold several components,
the nodes outside the bucket's largest component meet the nodes of other
components there. Links inside a component change nothing, so no link between
components is lost. Before that, the shingles that only one of these nodes holds
are counted: a pair's intersection can't be larger than what either node shares
with anybody, so a copy with too many edits of its own meets nobody. Then the
hashes are dealt over 2,048 parts: each part that one node fills and the other
doesn't holds a shingle that they don't share, so pairs whose parts differ too
much are passed over before their texts are fetched. Both are bounds, which lose
no link. Every link is confirmed on the full shingle sets of the whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, settings, spare
from .components import connected_components

SHINGLE = 5
#: A pair with similarity 0.85 shares no band with probability below 1e-6.
BANDS, ROWS = 27, 5
#: The stage of a corpus pipeline: similarity 0.80, where 40 bands miss a pair with probability 1.3e-7 (27 would with 2.2e-5).
STAGE_PERCENT, STAGE_BANDS = 80, 40
_PIECE = 2048
_FOLD = np.uint64(0x9E3779B97F4A7C15)
#: Rows of an Arrow batch, which hold whole texts or pairs of them.
BATCH = "1000"
#: Parts that a node's shingle hashes are dealt over, a bit for each.
PARTS = 2048
#: Words whose hashes a worker keeps; a fuller table is emptied between texts.
WORDS_HELD = 100_000


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], k: int = SHINGLE) -> set:
    """Distinct runs of ``k`` words; of fewer words, the whole; of none, nothing."""
    if not words:
        return set()
    if len(words) < k:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(k)), strict=False))


def _mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Vocabulary(dict):
    """word -> its number, with the keyed hashes of the words by number. Numbers hold within one text."""

    def __init__(self):
        self.hashes = np.empty(1 << 12, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.empty_like(self.hashes)])
        self.hashes[n] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=b"shingle").digest(), "little")
        self[word] = n
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self) > WORDS_HELD:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def shingle_hashes(text: str | None, vocabulary: Vocabulary, k: int = SHINGLE) -> tuple[int, np.ndarray]:
    """How many distinct shingles a text has, counted by their words, and the sorted distinct 64-bit hashes."""
    words = words_of(text)
    if not words:
        return 0, np.empty(0, dtype=np.uint64)
    own = vocabulary.numbers(words)
    width = min(k, len(words))
    n = len(words) - width + 1
    each, named, names = vocabulary.hashes[own], own[:n], len(vocabulary)
    h = np.full(n, width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            h = (h ^ each[i : i + n]) * _FOLD
            h ^= h >> np.uint64(32)
            if i:  # number the runs of i + 1 words, anew where the numbers would grow too large
                if names * len(vocabulary) >= 1 << 63:
                    distinct, named = np.unique(named, return_inverse=True)
                    names = len(distinct)
                named, names = named * len(vocabulary) + own[i : i + n], names * len(vocabulary)
        h = _mix64(h)
    return len(np.unique(named)), np.unique(h)


def _pi(x: np.ndarray) -> np.ndarray:
    """The second permutation of the circle, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    return x


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """Coordinate k: the least pi(sigma(shingle) + k). sigma takes high bits of the mixed hash."""
    sigma = (hashes >> np.uint64(32)).astype(np.uint32)
    # Shifts are spread around the circle, so that no two coordinates see neighbouring points.
    shifts = (np.arange(size, dtype=np.uint32) * np.uint32(0x9E3779B1))[:, None]
    least = np.full(size, np.uint32(0xFFFFFFFF))
    with np.errstate(over="ignore"):
        for at in range(0, len(sigma), _PIECE):
            np.minimum(least, _pi(sigma[None, at : at + _PIECE] + shifts).min(axis=1), out=least)
    return least


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.arange(1, bands + 1, dtype=np.uint64)
        for column in sig.reshape(bands, rows).astype(np.uint64).T:
            out = _mix64(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def _features(k: int, bands: int, rows: int):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, digests, signs = [], [], []
                for text in part.column(1):
                    own, h = shingle_hashes(text.as_py(), vocabulary, k)
                    n.append(own)
                    digests.append(hashlib.sha256(h.tobytes()).digest()[:16] if len(h) else None)
                    signs.append(band_hashes(signature(h, bands * rows), bands, rows) if len(h) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.list_(pa.int64()))],
                    names=["id", "n", "digest", "bands"],
                )

    return features


def _shingle_rows(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                each = [shingle_hashes(t.as_py(), vocabulary, k)[1] for t in part.column(1)]
                node = np.repeat(part.column(0).to_numpy(), [len(h) for h in each])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(each).view(np.int64))], names=["node", "shingle"])

    return rows


def held_in_common(texts: DataFrame, k: int) -> DataFrame:
    """node, own: how many of a node's shingles no other of these nodes has. One exchange on the shingle, folded in each task first.

    Ids with several rows have no entry: what is lone in one of their texts says nothing about another.
    """
    rows = texts.mapInArrow(_shingle_rows(k), "node long, shingle long")
    single = rows.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other")
    several = texts.groupBy(F.col("id").alias("node")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return single.groupBy("node").agg(F.count(F.lit(1)).alias("own")).join(several, "node", "left_anti")


def _part_rows(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for batch in batches:
            filled = np.zeros((batch.num_rows, PARTS), dtype=bool)
            for i, text in enumerate(batch.column(1)):
                filled[i, shingle_hashes(text.as_py(), vocabulary, k)[1] % np.uint64(PARTS)] = True
            words = pa.array(np.packbits(filled, axis=1).view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.FixedSizeListArray.from_arrays(words, PARTS // 64).cast(pa.list_(pa.int64()))], names=["node", "parts"]
            )

    return rows


def filled_parts(texts: DataFrame, k: int) -> DataFrame:
    """node, parts: the parts that a node's shingles fall into, as bits. Ids with several rows have no entry, as in :func:`held_in_common`."""
    single = texts.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows = 1")
    return texts.join(single, "id", "left_semi").select("id", "text").mapInArrow(_part_rows(k), "node long, parts array<bigint>")


def unshared(mine: str, other: str) -> Column:
    """How many parts ``mine`` fills and ``other`` doesn't: as many shingles at least aren't shared. 0 where either isn't known."""
    alone = F.zip_with(mine, other, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
    return F.coalesce(F.aggregate(alone, F.lit(0), lambda total, x: total + x), F.lit(0))


def _similar(k: int, percent: int):
    """Keeps the pairs whose full shingle sets reach the threshold; pairs come sorted by b."""

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, words, own = None, [], set()
        for batch in batches:
            keep = np.zeros(len(batch), dtype=bool)
            for i, (text_a, text_b) in enumerate(zip(batch["text_a"], batch["text_b"], strict=True)):
                if text_b != held:
                    held, words = text_b, words_of(text_b)
                    own = shingle_set(words, k)
                mine = words_of(text_a)
                if mine == words:
                    keep[i] = bool(words)
                    continue
                other = shingle_set(mine, k)
                both = len(own & other) if len(own) < len(other) else len(other & own)
                keep[i] = 100 * both >= percent * (len(own) + len(other) - both)
            yield batch.loc[keep, ["a", "b"]]

    return similar


def confirm(scratch: Scratch, pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links, by the full shingle sets of their texts.

    Both joins are on the same key of ``texts``, so its exchange is made once;
    adaptive execution splits the partitions of nodes with many pairs. Pairs grow
    with the input and aren't broadcast at any size.
    """
    a, b = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").hint("merge").join(a, "a").hint("merge").join(b, "b")
    with settings(scratch.spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH}):
        return scratch.store(both.mapInPandas(_similar(k, percent), "a long, b long"), "links")


def _buckets(scratch: Scratch, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The band buckets of every node, and of each bucket with several nodes the smallest (hub) and its size."""
    nodes = scratch.store(sets.select("node", "n", F.posexplode("bands").alias("band", "value")), "buckets")
    shared = scratch.store(
        nodes.groupBy("band", "value").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("node", "n")).alias("hub"))
        .where("members > 1")
        .select("band", "value", "hub.node", "hub.n"),
        "hubs",
    )
    return nodes, shared


def _open_buckets(scratch: Scratch, members: DataFrame, *keep: str) -> DataFrame:
    """Members of buckets that hold several components, with the bucket's largest component."""
    sizes = members.groupBy("band", "value", "component").agg(F.count(F.lit(1)).alias("size"))
    mixed = scratch.store(
        sizes.groupBy("band", "value")
        .agg(F.count(F.lit(1)).alias("components"), F.max_by("component", F.struct("size", "component")).alias("largest"))
        .where("components > 1")
        .select("band", "value", "largest"),
        "mixed",
    )
    held = members.join(mixed, ["band", "value"]).select("band", "value", "node", "n", "component", "largest", *keep)
    out = scratch.store(held, "open")
    scratch.drop(mixed)
    return out


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Linked are texts whose sets of ``k``-word shingles share ``percent`` % of
    their union. A text without words, or null, has an empty set and no link. A
    component's id is the smallest doc_id in it; the row with that id is kept.
    Rows that share an id are one node, with the links of all their texts; rows
    with a null id have a null component and aren't kept, and link nothing. Ties
    and repeated rows are linked like any equal texts. An empty table gives an
    empty result. Columns that aren't named aren't read.
    """
    scratch = Scratch(docs.sparkSession)
    source = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    with settings(scratch.spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH}):
        features = scratch.store(
            source.mapInArrow(_features(k, bands, rows), "id long, n long, digest binary, bands array<bigint>"), "features"
        )
    told = features.where("id IS NOT NULL AND digest IS NOT NULL")
    # Sets with one digest are one node, named by their smallest id.
    sets = scratch.store(
        told.groupBy("digest").agg(F.min(F.struct(F.col("id").alias("node"), "n", "bands")).alias("first")).select("digest", "first.*"), "nodes"
    )
    named = sets.select("digest", "node")
    members = scratch.store(
        told.select("id", "digest").join(named, "digest").where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"), "digest").distinct(),
        "members",
    )
    nodes, shared = _buckets(scratch, sets)
    ids = (
        nodes.join(shared.select("band", "value"), ["band", "value"], "left_semi").select(F.col("node").alias("id"))
        .unionByName(members.select(F.col("a").alias("id"))).unionByName(members.select(F.col("b").alias("id")))
    )
    texts = scratch.store(source.join(ids.distinct().hint("merge"), "id", "left_semi").distinct(), "texts")

    # Each member against its node in full. What only its digest has in common with the node is a node of its own.
    same = confirm(scratch, members.select("a", "b").distinct(), texts, k, percent)
    odd = scratch.store(members.join(same, ["a", "b"], "left_anti"), "odd")
    place = features.select("id", "n", "digest").join(named, "digest", "left")
    if not odd.isEmpty():
        own = odd.select(F.col("a").alias("id"), "digest").distinct()
        sets = sets.select("node", "n", "bands").unionByName(told.join(own, ["id", "digest"]).select(F.col("id").alias("node"), "n", "bands").distinct())
        place = place.join(own.withColumn("odd", F.lit(True)), ["id", "digest"], "left").withColumn("node", F.when(F.col("odd"), F.col("id")).otherwise(F.col("node")))
        nodes, shared = _buckets(scratch, sets)
    # Nodes of one id, which has several texts, hang together.
    several = told.groupBy("id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most")
    ties = members.join(several.select(F.col("id").alias("a")), "a", "left_semi").join(odd, ["a", "b"], "left_anti").select("a", "b")

    near_in_size = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    company = nodes.join(shared.select("band", "value"), ["band", "value"], "left_semi")
    first = scratch.store(
        nodes.join(shared.select("band", "value", F.col("node").alias("b"), F.col("n").alias("m")), ["band", "value"])
        .where((F.col("node") != F.col("b")) & near_in_size)
        .select(F.col("node").alias("a"), "b")
        .distinct(),
        "pairs",
    )
    links = confirm(scratch, first, texts, k, percent)
    held = connected_components(links.unionByName(ties), "a", "b").select(F.col("id").alias("node"), "component_id")
    rest = scratch.store(
        company.join(held, "node", "left").select("band", "value", "node", "n", F.coalesce("component_id", "node").alias("component")),
        "members",
    )
    scratch.drop(links, same, nodes, shared)
    mixed = _open_buckets(scratch, rest)
    scratch.drop(rest)
    # A node's intersection with another is at most what it has in common with any.
    lone = held_in_common(texts.join(mixed.select(F.col("node").alias("id")).distinct().hint("merge"), "id", "left_semi").select("id", "text"), k)
    with settings(scratch.spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH}):
        lone = scratch.store(lone, "own-shingles")
    able = mixed.join(lone, "node", "left").withColumn("c", F.col("n") - F.coalesce("own", F.lit(0)))
    left = _open_buckets(scratch, able.drop("largest").where(100 * F.col("c") >= percent * F.col("n")), "c")
    scratch.drop(mixed)
    # With its bands at hand, a pair that shares several is made in the first of them alone.
    own_bands = scratch.store(sets.join(left.select("node").distinct(), "node", "left_semi").select("node", "bands").distinct(), "bands")
    with settings(scratch.spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH}):
        parts = scratch.store(filled_parts(texts.join(left.select(F.col("node").alias("id")).distinct().hint("merge"), "id", "left_semi"), k), "parts")
    signed = left.join(own_bands, "node").join(parts, "node", "left")
    outside = signed.where("component <> largest").select(
        "band", "value", F.col("node").alias("b"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("component").alias("other"), F.col("bands").alias("others"), F.col("parts").alias("other_parts"),
    )
    first_shared = F.array_position(F.zip_with("bands", "others", lambda x, y: x == y), True) == F.col("band") + 1
    shared_at_most = F.least("c", "d", F.col("n") - unshared("parts", "other_parts"), F.col("m") - unshared("other_parts", "parts"))
    enough, close = ((100 + percent) * most >= percent * (F.col("n") + F.col("m")) for most in (F.least("c", "d"), shared_at_most))
    second = scratch.store(
        signed.join(outside, ["band", "value"])
        .where((F.col("component") != F.col("other")) & near_in_size & enough & first_shared & close)
        .where((F.col("component") == F.col("largest")) | (F.col("node") < F.col("b")))
        .select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b"))
        .distinct()
        .join(first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti"),
        "pairs",
    )
    scratch.drop(left, own_bands, parts, first)
    more = confirm(scratch, second, texts, k, percent)
    scratch.drop(second, texts)
    final = held
    if not more.isEmpty():  # components meet through the new links
        stars = held.select(F.col("node").alias("a"), F.col("component_id").alias("b"))
        final = connected_components(stars.unionByName(more), "a", "b").select(F.col("id").alias("node"), "component_id")
    component = F.coalesce("component_id", "node")
    return (
        place.withColumn("node", F.coalesce("node", "id"))
        .join(final, "node", "left")
        .select(
            F.col("id").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), component).alias("component_id"),
            F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
        )
    )


def drop_near_copies(docs: DataFrame, percent: int = STAGE_PERCENT, bands: int = STAGE_BANDS) -> DataFrame:
    """``docs``, with its columns whatever their names, less all but one document of each group of near copies.

    That with the smallest doc_id stays. A row that isn't linked stays, so do
    rows with a null id, a null text or no words; rows that share the id that
    stays all do. An empty table stays empty. A lower ``percent`` wants more
    ``bands``.
    """
    (gone_id,) = spare(docs, "gone")
    gone = near_duplicates(docs, percent=percent, bands=bands).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(gone_id))
    return docs.join(gone.hint("merge"), F.col("doc_id").cast("long") == F.col(gone_id), "left_anti").select(*map(col, docs.columns))
