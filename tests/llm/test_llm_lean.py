"""Batches in parts of bounded text."""

from __future__ import annotations

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from promptloom.llm import lean


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=30), st.integers(1, 50))
def test_parts(texts, size):
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])
    made = list(lean.parts(batch, 1, size))
    assert [r for part in made for r in part.to_pylist()] == batch.to_pylist()
    for part in made:
        total = sum(len((t or "").encode()) for t in part.column(1).to_pylist())
        assert part.num_rows and (total <= size or part.num_rows == 1)


def test_lean_keeps_what_a_function_makes():
    batches = [pa.record_batch([pa.array(["a", "bb"]), pa.array([1, 2])], names=["t", "n"]), pa.record_batch([pa.array([], pa.string()), pa.array([], pa.int64())], names=["t", "n"])]

    def run(given_batches):
        for b in given_batches:
            yield b

    for text in (None, 0, 1):
        assert [r for b in lean.lean(run, text)(iter(batches)) for r in b.to_pylist()] == [{"t": "a", "n": 1}, {"t": "bb", "n": 2}]
    assert list(lean.lean(run)(iter([]))) == []
