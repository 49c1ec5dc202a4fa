"""Best-fit packing of token sequences with exact complements.

Documents are tokenised once; those longer than a sequence are cut into whole
sequences and a rest. Packing is decided on the histogram of piece lengths,
which has no more rows than a sequence has tokens, however many documents there
are. Hash tables keyed by sum hold the single lengths, the pairs and the triples
that make up each sum. The longest piece left opens a sequence; its gap is looked
up there, singles first, then pairs, then triples. The first combination that the
counts of pieces left still allow is consumed, in as many sequences as they
allow. Where nothing fills the gap exactly, the longest piece that fits goes in
(best fit) and the smaller gap is looked up again.

The plan, rows of (length, range of ranks, sequence, offset), is joined to the
pieces, which Spark ranks within their length in salted parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, settings, stored
from .tokenise import words

CAPACITY = 2048
#: Bytes of text that are tokenised at once (a longer text on its own).
SLICE = 3 << 20
#: Pieces of a length that are ranked in one task, about.
RANKED = 500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    sizes = np.concatenate([[0], np.cumsum(pa.compute.binary_length(column).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + SLICE, side="right")) - 1)
        yield at, column.slice(at, end - at)
        at = end


def _cut(path: str | None, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words(path)
        for batch in batches:
            texts = pa.compute.fill_null(batch.column(1), "")
            keys = batch.column(0)
            for first, part in _slices(texts):
                ids, bounds = table.encode(part)
                out: tuple[list, ...] = ([], [], [], [], [])
                for i in range(len(part)):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    for n, begin in enumerate(range(0, len(own), capacity)):
                        piece = own[begin : begin + capacity]
                        for column, value in zip(out, (first + i, n, begin, len(piece), zlib.crc32(piece)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(out[0], pa.int64())), *(pa.array(c, t) for c, t in zip(out[1:], (pa.int32(), *[pa.int64()] * 3), strict=True))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return cut


def token_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row; a null text is empty: one piece, the end id."""
    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(
        _cut(tokenizer, capacity, end_id), PIECES
    )


class Sums:
    """Sum -> combinations of one, two and three of the given lengths, longest first length first.

    A triple is held as its longest length and the sum of the pair that the rest
    makes up. There are at most capacity^2 / 2 entries, whatever the counts.
    """

    def __init__(self, lengths: np.ndarray, capacity: int):
        lengths = np.sort(lengths[lengths > 0])[::-1]
        self.single = set(lengths.tolist())
        self.pair = self._by_sum(lengths, lengths, capacity, lambda a, b: a >= b)
        rests = np.array(sorted(self.pair), dtype=np.int64)
        self.triple = self._by_sum(lengths, rests, capacity, lambda a, rest: rest <= 2 * a)

    @staticmethod
    def _by_sum(first: np.ndarray, second: np.ndarray, capacity: int, allowed) -> dict[int, list[int]]:
        """sum -> the values of ``first``, descending, that a value of ``second`` completes."""
        out: dict[int, list[int]] = {}
        for a in first.tolist():
            for total in (a + second[allowed(a, second) & (second <= capacity - a)]).tolist():
                out.setdefault(total, []).append(a)
        return out


class Stock:
    """Counts of the pieces left, by length, and the exact complements among them.

    Counts only fall, so a combination that can't be had once never can be again:
    it is taken off its table when it is met.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.sums = Sums(np.array(list(counts), dtype=np.int64), capacity)

    def longest(self, limit: int) -> int:
        at = np.flatnonzero(self.left[1 : limit + 1])
        return int(at[-1]) + 1 if len(at) else 0

    def has(self, *lengths: int) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in lengths)

    def pair(self, gap: int, beside: tuple[int, ...] = ()) -> tuple[int, int] | None:
        """The pair of this sum with the longest first length that can be had, beside further pieces."""
        held = self.sums.pair.get(gap, [])
        held[:] = [a for a in held if self.has(a, gap - a)] if not beside else held
        return next(((a, gap - a) for a in held if self.has(a, gap - a, *beside) and (not beside or a <= beside[0])), None)

    def triple(self, gap: int) -> tuple[int, int, int] | None:
        """The triple of this sum with the longest first length that can be had."""
        held = self.sums.triple.get(gap, [])
        while held:
            rest = self.pair(gap - held[0], (held[0],)) if self.left[held[0]] else None
            if rest:
                return held[0], *rest
            held.pop(0)
        return None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        if gap in self.sums.single and self.left[gap] > 0:
            return (gap,)
        return self.pair(gap) or self.triple(gap)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): which ranks of a length go where.

    Rank r of the range goes to sequence ``first sequence + r - first rank``.
    """
    stock, taken = Stock(counts, capacity), np.zeros(capacity + 1, dtype=np.int64)
    rows, sequence = [], 0
    while longest := stock.longest(capacity):
        inside = [longest]
        stock.left[longest] -= 1
        gap = capacity - longest
        while gap:
            exact = stock.complement(gap)
            more = exact or ((x,) if (x := stock.longest(gap)) else None)
            if not more:
                break
            for x in more:
                stock.left[x] -= 1
            inside += more
            gap -= sum(more)
        times = 1 + min(int(stock.left[x]) // inside.count(x) for x in set(inside))
        for x in set(inside):
            stock.left[x] -= (times - 1) * inside.count(x)
        offset = 0
        for x in inside:
            rows.append((x, int(taken[x]), times, sequence, offset))
            taken[x] += times
            offset += x
        sequence += times
    return rows


def ranked(pieces: DataFrame, counts: dict[int, int], each: int = RANKED) -> DataFrame:
    """``pieces`` with a rank from 0 within their length, numbered in parts of about ``each`` pieces of a length."""
    parts = pieces.sparkSession.createDataFrame([(x, max(1, -(-n // each))) for x, n in counts.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(parts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")))
    sizes = stored(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "salts")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return (
        salted.withColumn("own", own)
        .join(sizes.select("length", "salt", before.alias("before")), ["length", "salt"])
        .select(*pieces.columns, (F.col("own") + F.col("before")).alias("rank"))
    )


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Every row is a document of its own, repeated rows and rows that share an id
    too. Null and empty texts are one piece, the end id. Equal lengths are told
    apart by a hash of id, piece and content, so reruns agree. An empty table
    gives an empty result. Columns that aren't named aren't read. The driver
    gets one row for each length that occurs, ``capacity`` at most.
    """
    with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}):  # whole texts: a few MB at once
        pieces = stored(token_pieces(docs, id_col, text_col, tokenizer, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan(counts, capacity)
    slots = docs.sparkSession.createDataFrame(rows, "s_length long, s_rank long, s_times long, s_sequence long, s_offset long")
    here = (
        (F.col("length") == F.col("s_length"))
        & (F.col("rank") >= F.col("s_rank"))
        & (F.col("rank") < F.col("s_rank") + F.col("s_times"))
    )
    return (
        ranked(pieces, counts)
        .join(F.broadcast(slots), here)  # a plan has a few rows for each length that occurs
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("s_sequence") + F.col("rank") - F.col("s_rank")).alias("sequence_id"), F.col("s_offset").alias("offset"),
        )
    )
