from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from promptloom.functions import templates as P

MESSAGES = "array<struct<role:string,content:string>>"
UA = [("user", "U"), ("assistant", "A")]


def render(spark, messages, make):
    df = spark.createDataFrame([(messages,)], f"m {MESSAGES}")
    return df.select(make(F.col("m")).alias("out")).first().out


def im(role, content):
    return f"<|im_start|>{role}\n{content}<|im_end|>\n"


DEFAULT = im("system", "You are a helpful assistant.")


def test_chatml(spark):
    assert render(spark, UA, P.chatml) == DEFAULT + im("user", "U") + im("assistant", "A")
    asked = render(spark, UA, lambda m: P.chatml(m, generation_prompt=True))
    assert asked == DEFAULT + im("user", "U") + im("assistant", "A") + "<|im_start|>assistant\n"
    own = [("system", "S"), ("user", "U")]
    assert render(spark, own, P.chatml) == im("system", "S") + im("user", "U")


def test_role_lines(spark):
    assert render(spark, UA, lambda m: P.role_lines(m, eos="E")) == "user\nUE\nassistant\nAE\n"
    asked = render(spark, UA, lambda m: P.role_lines(m, "B", "E", generation_prompt=True))
    assert asked == "Buser\nUE\nBassistant\nAE\n\n"


@pytest.mark.parametrize(
    "messages, expected",
    [
        # the last answer gets a thought, also an empty one
        (UA, im("user", "U") + im("assistant", "<think>\n\n</think>\n\nA")),
        # reasoning before the last question is left out, after it kept
        (
            [("user", "q1"), ("assistant", "<think>\nr1\n</think>\n\na1"), ("user", "q2"),
             ("assistant", "<think>\nr2\n</think>\n\na2")],
            im("user", "q1") + im("assistant", "a1") + im("user", "q2")
            + im("assistant", "<think>\nr2\n</think>\n\na2"),
        ),
        # an answer after the question but not last keeps its thought only if there is one
        (
            [("user", "q"), ("assistant", "a1"), ("assistant", "x</think>a2"), ("assistant", "a3")],
            im("user", "q") + im("assistant", "a1")
            + im("assistant", "<think>\nx\n</think>\n\na2")
            + im("assistant", "<think>\n\n</think>\n\na3"),
        ),
        # a leading system turn once, a later one like any turn
        (
            [("system", "S"), ("user", "U"), ("system", "S2")],
            im("system", "S") + im("user", "U") + im("system", "S2"),
        ),
        # neighbouring tool answers share a user turn
        (
            [("user", "q"), ("assistant", "c"), ("tool", "r1"), ("tool", "r2"), ("assistant", "a")],
            im("user", "q") + im("assistant", "c")
            + "<|im_start|>user\n<tool_response>\nr1\n</tool_response>"
            + "\n<tool_response>\nr2\n</tool_response><|im_end|>\n"
            + im("assistant", "<think>\n\n</think>\n\na"),
        ),
        # a wrapped tool answer is no question, so the reasoning before it stays
        (
            [("user", "q"), ("assistant", "r</think>c"),
             ("user", "<tool_response>x</tool_response>"), ("assistant", "a")],
            im("user", "q") + im("assistant", "<think>\nr\n</think>\n\nc")
            + im("user", "<tool_response>x</tool_response>")
            + im("assistant", "<think>\n\n</think>\n\na"),
        ),
        # no question at all: nothing comes after the last index
        ([("assistant", "<think>r</think>a")], im("assistant", "a")),
        ([], ""),
    ],
)
def test_reasoning_chat(spark, messages, expected):
    assert render(spark, messages, P.reasoning_chat) == expected


def test_reasoning_generation(spark):
    asked = render(spark, UA[:1], lambda m: P.reasoning_chat(m, generation_prompt=True))
    assert asked == im("user", "U") + "<|im_start|>assistant\n"
    quiet = render(
        spark, UA[:1],
        lambda m: P.reasoning_chat(m, generation_prompt=True, enable_thinking=False),
    )
    assert quiet == asked + "<think>\n\n</think>\n\n"


def test_reasoning_tools(spark):
    tools = F.array(F.lit('{"n": 1}'), F.lit('{"n": 2}'))
    text = render(
        spark, [("system", "S"), ("user", "U")], lambda m: P.reasoning_chat(m, tools=tools)
    )
    assert text.startswith("<|im_start|>system\nS\n\n# Tools\n\n")
    assert '<tools>\n{"n": 1}\n{"n": 2}\n</tools>' in text
    assert text.endswith("</tool_call><|im_end|>\n" + im("user", "U"))
    bare = render(spark, [("user", "U")], lambda m: P.reasoning_chat(m, tools=tools))
    assert bare.startswith("<|im_start|>system\n# Tools\n\n")


def test_reasoning_tool_calls(spark):
    schema = (
        "m array<struct<role:string,content:string,"
        "tool_calls:array<struct<name:string,arguments:string>>>>"
    )
    calls = [("f", '{"x": 1}'), ("g", "{}")]
    rows = [([("user", "q", None), ("assistant", "c", calls), ("tool", "r", None)],)]
    df = spark.createDataFrame(rows, schema)
    text = df.select(P.reasoning_chat("m", tool_calls=True).alias("t")).first().t
    assert text == (
        im("user", "q")
        + "<|im_start|>assistant\nc\n<tool_call>\n"
        '{"name": "f", "arguments": {"x": 1}}\n</tool_call>\n<tool_call>\n'
        '{"name": "g", "arguments": {}}\n</tool_call><|im_end|>\n'
        "<|im_start|>user\n<tool_response>\nr\n</tool_response><|im_end|>\n"
    )


def test_reasoning_in_a_field_of_its_own_and_nested_calls(spark):
    schema = (
        "m array<struct<role:string,content:string,reasoning_content:string,"
        "tool_calls:array<struct<function:struct<name:string,arguments:string>>>>>"
    )
    calls = [(("f", '{"x": 1}'),)]
    rows = [([("user", "q", None, None), ("assistant", "a</think>b", "\nwhy\n", calls), ("tool", "r", None, None),
              ("assistant", "<think>z</think>c", None, None)],)]
    df = spark.createDataFrame(rows, schema)
    text = df.select(
        P.reasoning_chat("m", tool_calls=True, nested_calls=True, reasoning_content=True).alias("t")
    ).first().t
    assert text == (
        im("user", "q")
        + "<|im_start|>assistant\n<think>\nwhy\n</think>\n\na</think>b\n<tool_call>\n"
        '{"name": "f", "arguments": {"x": 1}}\n</tool_call><|im_end|>\n'
        "<|im_start|>user\n<tool_response>\nr\n</tool_response><|im_end|>\n"
        + im("assistant", "<think>\nz\n</think>\n\nc")
    )


def test_instruct(spark):
    df = spark.createDataFrame([("U", "A", "R")], "d string, f string, r string")
    row = df.select(
        P.instruct_open("d").alias("open"), P.instruct_full("d", "f", "r").alias("full"),
        P.instruct_sections("d", "f", "r").alias("sections"),
        P.prompt_label("f", "r").alias("label"), P.instruct_concat("d", "f").alias("concat"),
        P.append_eos("d", "E").alias("ended"),
    ).first()
    assert row.open == "<s>[INST] U"
    assert row.full == "<s>[INST] U\n\n[/INST] A\n\nR"
    assert row.sections == "<s>[INST] U\n\n[/INST] \nfoamfiles:\nA\n\nallrun:\nR"
    assert row.label == "A\n\nR"
    assert row.concat == "U [/INST] A"
    assert row.ended == "UE"


def test_prompt_completion(spark):
    df = spark.createDataFrame([("S", "U", "A")], "s string, u string, a string")
    split = df.select(P.prompt_completion("s", "u", "a").alias("x")).first().x
    assert [tuple(m) for m in split.prompt] == [("system", "S"), ("user", "U")]
    assert [tuple(m) for m in split.completion] == [("assistant", "A")]
