from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from promptloom.functions import text as X


def one(spark, value, make):
    df = spark.createDataFrame([(value,)], "s string")
    return df.select(make(F.col("s")).alias("out")).first().out


@pytest.mark.parametrize(
    "text, thinking, content",
    [
        ("<think>t1</think>x</think>\ny\n", "<think>t1</think>x</think>", "y"),
        ("\n\nz", "", "z"),
        ("\n<think>\na\n</think>\n\nb c\n", "<think>\na\n</think>", "b c"),
        ("a</think>", "a</think>", ""),
        ("", "", ""),
        (" \n kept blanks \n", "", " \n kept blanks "),
    ],
)
def test_split_thinking(spark, text, thinking, content):
    assert tuple(one(spark, text, X.split_thinking)) == (thinking, content)


@pytest.mark.parametrize(
    "text, head, tail",
    [
        ("code system prompt:\nSYS\ncode user prompt:\nUSR", "SYS\n", "USR"),
        ("code system prompt:\nSYS\n", "SYS\n", None),
        ("S code user prompt:\nU1code user prompt:\nU2", "S ", "U1"),
        ("code user prompt:\n", "", ""),
    ],
)
def test_marker_split(spark, text, head, tail):
    assert tuple(one(spark, text, X.marker_split)) == (head, tail)


def test_probe_file_repair(spark):
    raw = "code system prompt:\nSYS codeâ€”no\ncode user prompt:\nUSR"
    repaired = one(spark, raw, lambda s: X.marker_split(X.replace_map(s)))
    assert tuple(repaired) == ("SYS code-no\n", "USR")


def test_marker_with_regex_signs(spark):
    split = one(spark, "a.*(b)x.*(b)y", lambda s: X.marker_split(s, ".*(b)", "a"))
    assert tuple(split) == ("", "x")


def test_tokens(spark):
    assert one(spark, " a\tb\r\n\nc ", X.tokens) == ["a", "b", "c"]
    assert one(spark, " \n", X.tokens) == []


def test_missing(spark):
    assert one(spark, "0/U here", lambda s: X.missing_from(s, ["0/U", "0/p"])) == ["0/p"]
    paths = F.array(F.lit("0/U"), F.lit("x/y"))
    assert one(spark, "", lambda s: X.missing_paths(paths, ["0/U", "0/p"])) == ["0/p"]


def test_quoted_values(spark):
    prompt = "Available solvers are: ['icoFoam', 'pisoFoam']. Use one."
    assert one(spark, prompt, X.quoted_values) == ["icoFoam", "pisoFoam"]


def test_paths(spark):
    assert one(spark, "file:/x/system/controlDict", X.path_folder) == "system"
    assert one(spark, "file:/x/system/controlDict", X.path_leaf) == "controlDict"
    assert one(spark, "http://h.org/a/b?q=1/2#t", X.path_leaf) == "b"
    assert one(spark, "0", lambda s: X.path_join(s, F.lit("U"))) == "0/U"


def test_file_checks(spark):
    good = "FoamFile\n{\n    object      k;\n}\nboundaryField { inlet { value (1 2); } }"
    assert tuple(one(spark, good, lambda s: X.file_checks(s, F.lit("k")))) == (True, True, True, None)
    bad = "FoamFile { object p; } x { ("
    assert tuple(one(spark, bad, lambda s: X.file_checks(s, F.lit("k")))) == (True, False, False, 26)
    bare = "no head"
    assert tuple(one(spark, bare, lambda s: X.file_checks(s, F.lit("k")))) == (False, False, True, None)


def plain_nesting(text):
    import re

    at, stack, pairs = 1, [], {")": "(", "}": "{", "]": "["}
    for piece in re.findall(r'(?s)"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/|.', text):
        if piece in "({[":
            stack.append((piece, at))
        elif piece in pairs:
            if not stack or stack[-1][0] != pairs[piece]:
                return False, at
            stack.pop()
        at += len(piece)
    return (False, stack[0][1]) if stack else (True, None)


def test_nesting(spark):
    import random

    rng = random.Random(2)
    parts = ["(", ")", "{", "}", "[", "]", "a", "b c", '"', '"(x\\""', "// } \n", "/* ) */", "/*", "/", "\n", "é"]
    texts = ["}{ )(", "({)}", "", "([]{})", "((", ")", None, '"never closed (', "x" * 5_000 + "(" * 300 + ")" * 300]
    texts += ["".join(rng.choices(parts, k=rng.randrange(0, 14))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(4)
    got = {r.k: (r.balanced, r.breaks_at) for r in df.select("k", X.nesting("t").alias("n")).select("k", "n.*").collect()}
    for k, text in enumerate(texts):
        assert got[k] == ((None, None) if text is None else plain_nesting(text)), text
    assert got[0] == (False, 1) and got[1] == (False, 3)


def test_json_map(spark):
    assert one(spark, '{"0/U":"line1\\nline2"}', X.json_map) == {"0/U": "line1\nline2"}
    assert one(spark, "{}", X.json_map) == {}
