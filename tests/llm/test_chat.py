"""Chat formatting: round trips of hostile texts, plain digests, defined results."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skucast.llm import chat

HOSTILE = st.text(alphabet=st.sampled_from(list("<|>\\im_startend\n a🙂")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(HOSTILE, HOSTILE), max_size=4))
def test_round_trip(turns):
    formatted = "".join(chat.format_turn(r, t) for r, t in turns)
    got = chat.parse(formatted)
    assert [g[:2] for g in got] == turns
    assert [chat.unescape(formatted[s:e]) for _, _, s, e in got] == [t for _, t in turns]


def test_plain_content_is_left_alone():
    text = "a < b | c <b> \\ end <"
    assert chat.format_turn("user", text) == chat.render("user", text)


@pytest.mark.parametrize("bad", ["x", chat.START + "user", chat.render("a", "b")[:-1] + "x", chat.render("u", "<|im_end|>x")])
def test_parser_refuses(bad):
    with pytest.raises(ValueError):
        chat.parse(bad)


def test_digests_and_defined_results(spark):
    rows = [(1, 1, "assistant", "é\n<|im_end|>"), (1, 0, "user", "hi"), (2, 0, "assistant", None), (2, 0, "assistant", "b"),
            (2, 0, "assistant", "b"), (4, 0, "user", "ok then"), (4, 0, "user", "ok"), (4, 1, "user", "a<|b"), (4, 1, "user", "a<a"), (None, None, None, None), (3, 5, "a\nb", "x" * 50000), (3, 4, "assistant", "<\\|")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS n_turns").repartition(3)
    turns = chat.format_turns(df)
    got = {r.conv_id: tuple(r)[1:] for r in chat.conversation_digests(turns).collect()}
    by_conv = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] or 0, r[2] or "", r[3] or "")):
        by_conv.setdefault(c, []).append((r or "", x or ""))
    for conv, want in by_conv.items():
        loss = "".join(x for r, x in want if r == "assistant")
        formatted = "".join(chat.format_turn(r, x) for r, x in want)
        assert got[conv] == (len(want), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in want).encode()).hexdigest(),
                             len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted))
    for r in turns.collect():
        masked = None if r.loss_start is None else chat.unescape(r.formatted[r.loss_start:r.loss_end])
        assert masked == (r.text if r.role == "assistant" else None)
    assert chat.conversation_digests(chat.format_turns(df.limit(0))).count() == 0
