"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context, and its reply alone is trainable. The template writes a turn as
``<s>role``, a line feed, the text, a line feed and ``</s>``. Where a text or role
holds one of the two control strings, a backslash is put before it (and the
backslashes right before it are doubled), which reading undoes.

Turns stream through sorted partitions: a task holds the prefix of one
conversation, never a group of rows. Turns that no assistant turn follows end in a
record without a trainable part, so that no turn is lost.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col

OPEN, CLOSE = "<s>", "</s>"
ASSISTANT = "assistant"
_CONTROL = re.compile(r"(\\*)(</?s>)")
_HIDDEN = re.compile(r"(\\+)(</?s>)")
_END = re.compile(r"\n</s>")

RECORDS = "conv_id long, example int, formatted string, loss_start long, loss_end long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _HIDDEN.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def escape_role(role: str) -> str:
    """A role stands on one line: backslashes are doubled, line feeds written ``\\n``, and no ``<`` is left bare."""
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("<", "\\<")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def head(role: str) -> str:
    return f"{OPEN}{escape_role(role)}\n"


TAIL = "\n" + CLOSE


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted record: cut at the end marks that no backslash hides."""
    out, at = [], 0
    for mark in _END.finditer(formatted):
        role, _, text = formatted[at + len(OPEN) : mark.start()].partition("\n")
        out.append((unescape_role(role), unescape(text)))
        at = mark.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return out


def _expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current: object = ()
    prefix, example, open_turns = "", 0, False
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for conv, role, text in zip(batch["conv_id"], batch["role"], batch["text"], strict=True):
            conv = None if pd.isna(conv) else int(conv)
            if conv != current:
                if open_turns:
                    rows.append((current, example, prefix, None, None))
                current, prefix, example, open_turns = conv, "", 0, False
            body = escape(text)
            start = len(prefix) + len(head(role))
            prefix += head(role) + body + TAIL
            open_turns = role != ASSISTANT
            if role == ASSISTANT:
                rows.append((conv, example, prefix, start, start + len(body)))
                example += 1
                size += len(prefix)
            if size > 1 << 22 or len(rows) >= 2000:
                yield _records(rows)
                rows, size = [], 0
    if open_turns:
        rows.append((current, example, prefix, None, None))
    if rows:
        yield _records(rows)


def _records(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["conv_id", "example", "formatted", "loss_start", "loss_end"])
    return frame.astype({"conv_id": "Int64", "loss_start": "Int64", "loss_end": "Int64"})


def format_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """conv_id, example, formatted, loss_start, loss_end (code points, end exclusive; null: nothing trainable).

    Turns go by ``turn`` (null first), ties by role and text. Null roles and
    texts are empty. A conversation without an assistant turn gives one record
    without a trainable part; an empty table gives none; rows with a null
    conv_id make up one conversation. Records of a conversation stand together
    and in order in their partition. Columns that aren't named aren't read. A
    conversation of n assistant turns is written n times over by the method.
    """
    empty = F.lit("")
    return (
        turns.select(
            col(conv_col).cast("long").alias("conv_id"),
            col(turn_col).alias("turn"),
            F.coalesce(col(role_col), empty).alias("role"),
            F.coalesce(col(text_col), empty).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInPandas(_expand, RECORDS)
    )


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current: object = ()
    last, chars, loss_chars, loss, expected = "", 0, 0, hashlib.sha256(), 0
    rows: list[tuple] = []

    def done() -> tuple:
        told = parse_turns(last)
        turns = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in told).encode("utf-8", "surrogatepass"))
        return current, len(told), turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    for batch in batches:
        for conv, example, formatted, start, end in zip(batch["conv_id"], batch["example"], batch["formatted"], batch["loss_start"], batch["loss_end"], strict=True):
            conv = None if pd.isna(conv) else int(conv)
            if conv != current:
                if current != ():
                    rows.append(done())
                current, chars, loss_chars, loss, expected = conv, 0, 0, hashlib.sha256(), 0
            if example != expected:
                raise ValueError(f"conversation {conv}: record {example} comes where {expected} should")
            expected += 1
            last = formatted
            chars += len(formatted)
            if not pd.isna(start):
                reply = unescape(formatted[int(start) : int(end)])
                loss_chars += len(reply)
                loss.update(reply.encode("utf-8", "surrogatepass"))
            if len(rows) >= 2000:
                yield _digests(rows)
                rows = []
    if current != ():
        rows.append(done())
    if rows:
        yield _digests(rows)


def _digests(rows: list[tuple]) -> pd.DataFrame:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})


def read_back(records: DataFrame) -> DataFrame:
    """Per conversation what its records hold, read from the formatted strings and loss marks alone.

    The records of a conversation must stand together and in order, as
    ``format_conversations`` leaves them; stored and read again they need
    ``repartition("conv_id").sortWithinPartitions("conv_id", "example")`` first.
    Records that come otherwise are an error.
    """
    return records.mapInPandas(_read_back, DIGESTS)
