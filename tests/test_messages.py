"""Conversations cut into parts must read the same as whole ones."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from promptloom.functions import templates as P
from promptloom.functions.text import tokens
from promptloom.operators import vocabulary as V
from promptloom.operators.chat_rows import chat_rows, chat_token_counts
from promptloom.operators.messages import chat_pieces, gather_messages, with_opening

CONVERSATIONS = {
    1: [("system", "S s"), ("user", "q1 q2"), ("assistant", "<think>r</think>a1"), ("user", "q"),
        ("assistant", "<think>r2</think>a2"), ("tool", "t1"), ("tool", "t2"), ("assistant", "end")],
    2: [("user", "only")],
    3: [("assistant", "a b c"), ("user", "<tool_response>x</tool_response>"), ("assistant", "z")],
    4: [("user", f"word{i} " * (i % 4)) if i % 2 == 0 else ("assistant", f"ans{i} and more")
        for i in range(40)],
}


@pytest.fixture(scope="module")
def rows(spark):
    flat = [
        (key, at, role, text)
        for key, turns in CONVERSATIONS.items() for at, (role, text) in enumerate(turns)
    ]
    return spark.createDataFrame(flat, "conv_id bigint, turn bigint, role string, text string")


TEMPLATES = {
    "chatml": lambda c: P.chatml("messages", True, context=c),
    "role_lines": lambda c: P.role_lines("messages", "B", "E", True, context=c),
    "reasoning": lambda c: P.reasoning_chat("messages", True, False, context=c),
    "tools": lambda c: P.reasoning_chat("messages", tools=F.array(F.lit("{}")), context=c),
    "eos": lambda c: P.append_eos(P.chatml("messages", context=c), "END", c.closes),
}


@pytest.mark.parametrize("template", TEMPLATES)
@pytest.mark.parametrize("size", [1, 2, 3])
def test_parts_join_to_the_whole(spark, rows, template, size):
    def text(part_size):
        gathered = gather_messages(rows, "conv_id", "turn", part_size=part_size)
        assert gathered.filter(F.size("messages") > part_size).isEmpty()
        parts = gathered.select(
            "conv_id", "part", TEMPLATES[template](F.col("context")).alias("t")
        ).collect()
        out: dict = {}
        for row in sorted(parts):
            out[row.conv_id] = out.get(row.conv_id, "") + row.t
        return out

    assert text(size) == text(1000)


@pytest.mark.parametrize("stretch", [1, 2, 3])
def test_stretches_join_to_the_whole(spark, rows, monkeypatch, stretch):
    """The context of each message is that of a window over its whole conversation."""
    from promptloom.operators import messages

    def contexts():
        out = gather_messages(rows, "conv_id", "turn").select("conv_id", "part", "context").collect()
        return sorted((r.conv_id, r.part, tuple(r.context)) for r in out)

    whole = contexts()
    monkeypatch.setattr(messages, "STRETCH", stretch)
    assert contexts() == whole and len(whole) == sum(map(len, CONVERSATIONS.values()))


def test_a_conversation_with_a_third_of_the_rows(spark):
    """No task gets more of it than a stretch, and it reads as if it were one."""
    turns = [(0 if k < 2_000 else k, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(6_000)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    gathered = gather_messages(df, "conv_id", "turn")
    hot = sorted((r.part, r.t) for r in gathered.filter("conv_id = 0").select("part", P.chatml("messages", context=F.col("context")).alias("t")).collect())
    whole = gather_messages(df.filter("conv_id = 0"), "conv_id", "turn", part_size=10_000).select(P.chatml("messages", context=F.col("context")).alias("t"))
    assert "".join(t for _, t in hot) == whole.first().t
    plan = gathered._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line and "part#" in line]
    assert windows and all("_stretch" in line for line in windows)


def test_whole_rows_match_the_array_form(spark, rows):
    gathered = gather_messages(rows, "conv_id", "turn", part_size=1000)
    differing = gathered.filter(
        P.reasoning_chat("messages", context=F.col("context")) != P.reasoning_chat("messages")
    )
    assert differing.isEmpty()


@pytest.mark.parametrize("size", [1, 3, 256])
def test_opening_reaches_every_part(spark, rows, size):
    out = with_opening(
        rows.select("conv_id", "turn"), rows, "conv_id", "turn", "role", "text", part_size=size
    ).collect()
    assert len(out) == sum(map(len, CONVERSATIONS.values()))
    assert all(r.system == ("S s" if r.conv_id == 1 else P.DEFAULT_SYSTEM) for r in out)


def expected_tokens(turns):
    """All (token, learnt) of a conversation, the plain way."""
    turns = turns if turns[0][0] == "system" else [("system", P.DEFAULT_SYSTEM), *turns]
    out = []
    for role, text in turns:
        words = f"<|im_start|>{role}\n{text}<|im_end|>\n".split()
        out += [(w, role == "assistant" and i > 0) for i, w in enumerate(words)]
    return out


@pytest.mark.parametrize("size", [1, 3, 256])
@pytest.mark.parametrize("limit", [5, 17, 1028])
def test_token_counts_and_rows(spark, rows, size, limit):
    pieces = chat_pieces(rows, "conv_id", "turn", part_size=size)
    counts = {r.conv_id: r for r in chat_token_counts(pieces, "conv_id", limit).collect()}
    vocab = V.build_vocab(pieces, tokens("piece"))
    names = {r.id: r.token for r in vocab.collect()}
    coded = {r.conv_id: r for r in chat_rows(pieces, "conv_id", "turn", vocab, limit).collect()}
    for key, turns in CONVERSATIONS.items():
        whole = expected_tokens(turns)
        kept = whole[:limit]
        assert counts[key].n_tokens == len(kept)
        assert counts[key].n_supervised == sum(learnt for _, learnt in kept)
        assert counts[key].truncated == (len(whole) > limit)
        assert [names[i] for i in coded[key].ids] == [w for w, _ in kept]
        assert coded[key].tags == [int(learnt) for _, learnt in kept]


def test_a_long_conversation_is_rendered_message_by_message(spark):
    """300 turns, one without a text: the rows joined in order are the whole rendering."""
    from promptloom.functions import templates as T

    said = [(1, k, "user" if k % 2 == 0 else "assistant", None if k == 7 else f"t{k}") for k in range(300)]
    rows = spark.createDataFrame(said, "conv_id int, turn int, role string, text string")
    gathered = gather_messages(rows, "conv_id", "turn")
    text = T.chatml("messages", generation_prompt=True, context=F.col("context"))
    lines = T.role_lines("messages", context=F.col("context"))
    parts = gathered.select("part", text.alias("t"), lines.alias("l")).orderBy("part").collect()
    body = "".join(f"<|im_start|>{r}\n{t or ''}<|im_end|>\n" for _, _, r, t in said)
    default = f"<|im_start|>system\n{T.DEFAULT_SYSTEM}<|im_end|>\n"
    assert len(parts) == 300
    assert "".join(p.t for p in parts) == default + body + "<|im_start|>assistant\n"
    assert "".join(p.l for p in parts) == "".join(f"{r}\n{t or ''}\n" for _, _, r, t in said)
