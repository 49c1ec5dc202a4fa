"""Prefix trie of conversations, built in range shards.

Distinct turns (role, text) get whole numbers in the order of their texts, so a
conversation is an array of numbers; equal arrays become one line with a count. Lines
are sorted into ranges and cut into shards of bounded size. A task builds a
ternary search tree over its shard's lines, medians first, and one walk over it
sums members, leaves and savings from the bottom. Nodes that reach into other
shards lie on a shard's first or last line; how many turns neighbouring shards
share tells which, and the parts of such a node add up by its depth and the first
shard that holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, col

#: Turns in a shard, about; a longer line is a shard of its own.
SHARD = 1 << 18
#: Bytes of joined ids in a chunk, about.
CHUNK = 4096

NOWHERE, INSIDE, FROM_LEFT, TO_RIGHT = -1, 0, 1, 2


def encode(conversations: DataFrame, scratch: Scratch, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order as array<struct<turn, id, words>>.

    Ids rise with (role, text), so turns of equal number are in that order.
    """
    empty = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    turns = conversations.where(col(conv).isNotNull()).select(col(conv).cast("long").alias("conv_id"), col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    sorted_turns = turns.select("role", "text").distinct().repartitionByRange("role", "text").sortWithinPartitions("role", "text")
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    dictionary = scratch.store(sorted_turns.select("role", "text", F.monotonically_increasing_id().alias("id"), words.alias("words")), "dictionary")
    numbered = turns.join(dictionary.hint("merge"), ["role", "text"]).select("conv_id", F.struct("turn", "id", "words").alias("t"))
    found = scratch.store(numbered.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")), "sequences")
    scratch.drop(dictionary)
    return found


def regraft(sequences: DataFrame, every: int = 20, keep: int = 4) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation c - c % every; h = crc32(c) % keep.

    All of them if the other has fewer, none if it is absent.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = sequences.where(F.col("conv_id") == base).select(F.col("conv_id").alias("base"), F.slice("turns", 1, max(1, keep - 1)).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % keep).cast("int")
    joined = sequences.withColumn("base", base).join(heads.hint("merge"), "base", "left").withColumn("h", h)
    none = F.slice("turns", 1, 0)
    rest = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.size("turns"))).otherwise(none)
    return joined.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), rest).alias("turns"))


def _digest(ids: Column) -> Column:
    return F.sha2(ids.cast("string").cast("binary"), 256)


def member_digests(members: DataFrame) -> DataFrame:
    """(line, ends): SHA-256 over each line's conv_ids, ascending and joined by commas.

    Ids are sorted in ranges, so that many tasks join those of one line into
    chunks of a few thousand bytes; the chunks of a line are then hashed one
    after another, as the digest of one text must be.
    """

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        line, start, held, size = None, 0, [], 0
        for pdf in batches:
            out = []
            for key, conv in zip(pdf["line"].tolist(), pdf["conv_id"].tolist(), strict=True):
                if key != line or size >= CHUNK:
                    if held:
                        out.append((line, start, ",".join(held)))
                    line, start, held, size = key, conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            if out:
                yield pd.DataFrame(out, columns=["line", "start", "chunk"])
        if held:
            yield pd.DataFrame([(line, start, ",".join(held))], columns=["line", "start", "chunk"])

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        line, state = None, None
        for pdf in batches:
            out = []
            for key, chunk in zip(pdf["line"].tolist(), pdf["chunk"].tolist(), strict=True):
                if key != line:
                    if state:
                        out.append((line, state.hexdigest()))
                    line, state = key, hashlib.sha256(chunk.encode())
                else:
                    state.update(f",{chunk}".encode())
            if out:
                yield pd.DataFrame(out, columns=["line", "ends"])
        if state:
            yield pd.DataFrame([(line, state.hexdigest())], columns=["line", "ends"])

    ranged = members.select("line", "conv_id").repartitionByRange("line", "conv_id").sortWithinPartitions("line", "conv_id")
    joined = ranged.mapInPandas(chunks, "line long, start long, chunk string")
    return joined.repartition("line").sortWithinPartitions("line", "start").mapInPandas(digests, "line long, ends string")


def distinct_lines(sequences: DataFrame, scratch: Scratch) -> DataFrame:
    """(ids, words, line, n, ends): each distinct sequence once, ``line`` being its smallest conv_id."""
    split = sequences.select("conv_id", F.transform("turns", lambda t: t["id"]).alias("ids"), F.transform("turns", lambda t: t["words"]).alias("words"))
    split = scratch.store(split, "encoded")
    lines = split.groupBy("ids", "words").agg(F.min("conv_id").alias("line"), F.count(F.lit(1)).alias("n"))
    lines = scratch.store(lines, "lines")
    shared = lines.where("n > 1").select("ids", "line")
    ends = member_digests(split.join(shared.hint("merge"), "ids"))
    alone = lines.where("n = 1").withColumn("ends", _digest(F.col("line")))
    both = alone.unionByName(lines.where("n > 1").join(ends.hint("merge"), "line").select(*alone.columns))
    found = scratch.store(both, "members")
    scratch.drop(split, lines)
    return found


def sharded(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """``lines`` with ``shard``: numbers rise with the order of ids, and a shard has about SHARD turns at most."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, filled = TaskContext.get().partitionId() << 32, 0
        for pdf in batches:
            numbers = []
            for size in pdf["ids"].map(len).tolist():
                if filled and filled + size > SHARD:
                    shard, filled = shard + 1, 0
                numbers.append(shard)
                filled += size + 1
            yield pdf.assign(shard=numbers)

    ranged = lines.repartitionByRange("ids").sortWithinPartitions("ids")
    return scratch.store(ranged.mapInPandas(number, "ids array<long>, words array<long>, line long, n long, ends string, shard long"), "shards")


class Neighbours:
    """For shards in order: how many first turns the last line before and a shard's first line share, and how many all lines of a shard share."""

    def __init__(self, shards: list[int], shared: list[int], inner: list[int]):
        self.shards, self.at = shards, {s: i for i, s in enumerate(shards)}
        self.shared = [*shared, NOWHERE]  # after the last shard comes nothing: not even the root goes on
        #: prefixes up to this length come from the shard before and go through all of this one
        self.through = [min(s, k) for s, k in zip(shared, inner, strict=True)]
        #: the nearest shard before that lets less through
        self.less = [0] * len(shards)
        higher: list[int] = []
        for i, t in enumerate(self.through):
            while higher and self.through[higher[-1]] >= t:
                higher.pop()
            self.less[i] = higher[-1] if higher else 0
            higher.append(i)

    def first_holder(self, i: int, depth: int) -> int:
        """The first shard that holds the prefix of ``depth`` turns that shard ``i`` has from the shard before."""
        i -= 1
        while self.through[i] >= depth:
            i = self.less[i]
        return self.shards[i]


def common_turns(a: str, b: str) -> Column:
    """How many first elements two array columns share."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("long")


def neighbours(shards: DataFrame, scratch: Scratch) -> Neighbours:
    """Two lines a shard are compared, and two numbers a shard reach the driver: a shard stands for SHARD turns."""
    bounds = scratch.store(shards.groupBy("shard").agg(F.min("ids").alias("first"), F.max("ids").alias("last")), "bounds")
    inner = {r["shard"]: r["k"] for r in bounds.select("shard", common_turns("first", "last").alias("k")).collect()}
    numbers, shared = sorted(inner), {}
    if len(numbers) > 1:
        follows = shards.sparkSession.createDataFrame(list(zip(numbers[1:], numbers[:-1], strict=True)), "shard long, before long")
        pairs = bounds.join(follows, "shard").select("shard", "first", "before").join(bounds.select(F.col("shard").alias("before"), "last"), "before")
        shared = {r["shard"]: r["k"] for r in pairs.select("shard", common_turns("last", "first").alias("k")).collect()}
    scratch.drop(bounds)
    return Neighbours(numbers, [shared.get(s, NOWHERE) for s in numbers], [inner[s] for s in numbers])


class TernaryTree:
    """Ternary search tree over arrays of numbers; node 0 is the empty prefix.

    ``low`` and ``high`` lead to siblings, ``equal`` to the search tree of the
    children; ``parent`` is the prefix one turn shorter.
    """

    def __init__(self) -> None:
        self.key, self.low, self.equal, self.high, self.parent, self.depth = [NOWHERE], [0], [0], [0], [NOWHERE], [0]

    def insert(self, ids: list[int]) -> int:
        """The node at the end of ``ids``."""
        key, low, equal, high = self.key, self.low, self.equal, self.high
        node = 0
        for number in ids:
            owner, branch, at = node, equal, node
            node = equal[node]
            while node and key[node] != number:
                branch, at = (low, node) if number < key[node] else (high, node)
                node = branch[node]
            if not node:
                node = branch[at] = len(key)
                key.append(number)
                low.append(0)
                equal.append(0)
                high.append(0)
                self.parent.append(owner)
                self.depth.append(self.depth[owner] + 1)
        return node

    def in_order(self) -> list[int]:
        """All nodes, a prefix before what it begins, siblings by number; without recursion."""
        out, waiting = [0], []
        node = self.equal[0]
        while node or waiting:
            while node:
                waiting.append((node, False))
                node = self.low[node]
            node, entered = waiting.pop()
            if entered:
                node = self.high[node]
            else:
                out.append(node)
                waiting.append((node, True))
                node = self.equal[node]
        return out


def build(lines: list[list[int]]) -> tuple[TernaryTree, list[int]]:
    """The tree of sorted, distinct ``lines`` and the node where each ends; medians go in first, so searches stay short."""
    tree, ends = TernaryTree(), [0] * len(lines)
    waiting = [(0, len(lines))]
    for a, b in waiting:  # grows meanwhile
        if a < b:
            middle = (a + b) // 2
            ends[middle] = tree.insert(lines[middle])
            waiting += ((a, middle), (middle + 1, b))
    return tree, ends


NODES = "shard long, depth long, mark int, parent_mark int, holder long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


def shard_nodes(pdf: pd.DataFrame, near: Neighbours) -> pd.DataFrame:
    """The nodes of one shard; what a node has in other shards is not in its sums, and is counted once over all shards."""
    lines = [ids.tolist() for ids in pdf["ids"]]
    place = sorted(range(len(lines)), key=lines.__getitem__)
    pdf, lines, shard = pdf.iloc[place], [lines[k] for k in place], int(pdf["shard"].iloc[0])
    i = near.at[shard]
    from_left, to_right = near.shared[i], near.shared[i + 1]
    tree, ended = build(lines)
    size = len(tree.key)
    parent, depth = tree.parent, tree.depth
    n, first, children, leaves, saved, words = [0] * size, [1 << 63] * size, [0] * size, [0] * size, [0] * size, [NOWHERE] * size
    ends: list[str | None] = [None] * size
    words[0] = 0
    for node, line, count, own, digest in zip(ended, pdf["line"].tolist(), pdf["n"].tolist(), pdf["words"].tolist(), pdf["ends"].tolist(), strict=True):
        n[node], first[node], ends[node] = count, line, digest
        for k in reversed(own.tolist()):
            if words[node] != NOWHERE:  # then its prefixes have theirs as well
                break
            words[node] = k
            node = parent[node]
    mark = [INSIDE] * size
    for node, shared, side in ((ended[-1], to_right, TO_RIGHT), (ended[0], from_left, FROM_LEFT)):
        while node != NOWHERE:
            if depth[node] <= shared:
                mark[node] = side
            node = parent[node]
    goes_on = ended[-1] if depth[ended[-1]] <= to_right else NOWHERE  # the next shard's first line continues this one
    order = tree.in_order()
    for node in reversed(order):
        if not tree.equal[node] and node != goes_on:
            leaves[node] += 1
        own = mark[node] != FROM_LEFT  # another shard holds it first, and counts it there
        saved[node] += (n[node] - own) * words[node]
        up = parent[node]
        if up != NOWHERE:
            n[up] += n[node]
            first[up] = min(first[up], first[node])
            children[up] += own
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    holder = [near.first_holder(i, depth[x]) if mark[x] == FROM_LEFT else shard for x in order]
    up = [parent[x] for x in order]
    pick = lambda values: [values[x] for x in order]
    return pd.DataFrame(
        {
            "shard": shard,
            "depth": pick(depth),
            "mark": pick(mark),
            "parent_mark": [mark[x] if x != NOWHERE else NOWHERE for x in up],
            "holder": holder,
            "conv_id": pick(first),
            "parent_conv_id": pd.array([first[x] if x != NOWHERE else None for x in up], "Int64"),
            "n_convs": pick(n),
            "n_children": pick(children),
            "n_leaves": pick(leaves),
            "saved_tokens": pick(saved),
            "ends": pick(ends),
        }
    )


def merge_boundaries(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds up the parts of nodes that several shards hold, and gives every node its parent's smallest member.

    The root alone has ``parent_conv_id`` null. A shard has at most as many such
    parts as its first and last line have turns.
    """
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = nodes.where(F.col("mark") != INSIDE)
    merged = scratch.store(parts.groupBy("holder", "depth").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("ends").alias("ends")), "merged")
    placed = parts.select("shard", "depth", "mark", "parent_mark", "holder", F.col("parent_conv_id").alias("local"))
    # the part of the first holder stands for the whole
    whole = merged.join(placed.where("shard = holder").drop("shard"), ["holder", "depth"]).withColumnRenamed("holder", "shard")
    inside = nodes.where(F.col("mark") == INSIDE).withColumnRenamed("parent_conv_id", "local")
    columns = ["shard", "depth", "parent_mark", "local", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    every = inside.select(*columns).unionByName(whole.select(*columns))
    known = placed.join(merged.select("holder", "depth", F.col("conv_id").alias("merged_conv_id")), ["holder", "depth"])
    known = known.select("shard", (F.col("depth") + 1).alias("depth"), F.col("mark").alias("parent_mark"), "merged_conv_id")
    found = every.join(known, ["shard", "depth", "parent_mark"], "left")
    return found.select("conv_id", "depth", F.coalesce("merged_conv_id", "local").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, rebuild=None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each distinct sequence of first turns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rebuild`` may change the encoded sequences (conv_id, turns) before the trie
    is built. Turns are ordered by turn, null first, then by role and text; null
    roles and texts are empty; repeated rows are turns each. Rows with a null conv_id
    belong to no conversation and are left out; an empty table gives no rows. A
    conversation's numbers, 24 bytes a turn, are one row. Columns other than the
    four named are not read.
    """
    scratch = Scratch(conversations.sparkSession)
    sequences = encode(conversations, scratch, conv, turn, role, text)
    lines = distinct_lines(rebuild(sequences) if rebuild else sequences, scratch)
    shards = sharded(lines, scratch)
    scratch.drop(sequences, lines)
    near = neighbours(shards, scratch)
    nodes = scratch.store(shards.groupBy("shard").applyInPandas(lambda pdf: shard_nodes(pdf, near), NODES), "trie-nodes")
    scratch.drop(shards)
    return merge_boundaries(nodes, scratch)
