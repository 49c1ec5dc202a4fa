from __future__ import annotations

import hashlib

from compare import connection, difference
from hypothesis import given, settings
from hypothesis import strategies as st

from wattweave.llm import chat
from wattweave.llm.queries import ORACLES, op7_chat_formatting

PARTS = st.lists(st.sampled_from(["a", "\\", "<s>", "</s>", "\n", "\n</s>", "[INST]", "<", "é"]), max_size=8).map("".join)


def test_matches_duckdb(spark, sf):
    assert difference(op7_chat_formatting(spark, sf), connection(sf), ORACLES["op7_chat_formatting"]) == ""


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PARTS, PARTS), min_size=1, max_size=4))
def test_turns_come_back(turns):
    formatted = "".join(chat.head(r) + chat.escape(t) + chat.TAIL for r, t in turns)
    assert chat.parse_turns(formatted) == turns


def test_each_reply_is_trained_once_with_all_before_it(spark, clash):
    rows = [(1, 0, "system", "be </s> kind"), (1, 1, "user", None), (1, 2, "assistant", "one \\<s>"), (1, 3, "user", "more"), (1, 4, "assistant", "two"), (1, 5, "user", "tail"), (2, None, None, "only"), (None, 0, "assistant", "x"), (3, 0, "assistant", ""), (4, 0, "assistant", "r" * 300_000), (5, 1, "assistant", "b"), (5, 1, "assistant", "a")]
    df = clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    records = chat.format_conversations(df)
    one = sorted((r for r in records.collect() if r["conv_id"] == 1), key=lambda r: r["example"])
    assert [chat.unescape(r["formatted"][r["loss_start"] : r["loss_end"]]) for r in one[:2]] == ["one \\<s>", "two"] and one[2]["loss_start"] is None
    assert [len(chat.parse_turns(r["formatted"])) for r in one] == [3, 5, 6]
    got = {r["conv_id"]: r for r in chat.read_back(records).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 6, 2: 1, None: 1, 3: 1, 4: 1, 5: 2}
    assert got[5]["loss_sha256"] == hashlib.sha256(b"ab").hexdigest() and got[2]["loss_chars"] == 0 and got[4]["loss_chars"] == 300_000
    assert got[1]["formatted_chars"] == sum(len(r["formatted"]) for r in one)
    assert chat.read_back(chat.format_conversations(df.where("false"))).count() == 0
