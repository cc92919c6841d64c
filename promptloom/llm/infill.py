"""Fill-in-the-middle examples, cut by a Fenwick tree over blocks of the text.

A unit is a run of letters or any other single character.  A text is laid out in blocks of a fixed
number of characters; a Fenwick tree holds, for each block, the units that begin in it and its
characters.  The n-th unit is found by binary lifting down the tree, which ends in its block, and by
a scan of that block alone.  So a text of any length is never taken apart as a whole.

Which units end the prefix and the middle, and the form of the output, come from a hash of the
row's id and a seed: a row gets the same cut wherever and whenever it is worked on.  An output is
taken apart again from itself and its form, as a text that holds one of the marks stays plain.

Defined results: a null or empty text is plain, with 0 units and an empty output; a null id hashes
like no digits at all; rows of one id are cut alike, one result a row; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Characters of a block; a text takes one tree node for each.
BLOCK = 4_096

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"

_UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
_LETTERS = re.compile("[A-Za-z]+")


class Fenwick:
    """Units and characters of the blocks of one text."""

    def __init__(self, text: str, block: int = BLOCK):
        self.text, self.block = text, block
        sizes = [self._counted(at) for at in range(0, len(text), block)]
        self.n_blocks = len(sizes)
        self.units, self.chars = [0] * (self.n_blocks + 1), [0] * (self.n_blocks + 1)
        for place, (units, chars) in enumerate(sizes, start=1):
            self.units[place] += units
            self.chars[place] += chars
            above = place + (place & -place)
            if above <= self.n_blocks:
                self.units[above] += self.units[place]
                self.chars[above] += self.chars[place]
        self.n_units = self._sum(self.units)

    def _begin(self, at: int) -> int:
        """Where the first unit that begins in the block at ``at`` does; past a run from the block before."""
        run = _LETTERS.match(self.text, at - 1, min(at + self.block, len(self.text))) if at else None
        return run.end() if run else at

    def _counted(self, at: int) -> tuple[int, int]:
        end = min(at + self.block, len(self.text))
        return len(_UNIT.findall(self.text, self._begin(at), end)), end - at

    def _sum(self, tree: list[int]) -> int:
        place, total = self.n_blocks, 0
        while place:
            total += tree[place]
            place -= place & -place
        return total

    def begin(self, unit: int) -> int:
        """The character at which unit number ``unit`` (from 0) begins; the text's length for the number of units."""
        if unit >= self.n_units:
            return len(self.text)
        place, before, at = 0, 0, 0
        step = 1 << self.n_blocks.bit_length()
        while step:
            below = place + step
            if below <= self.n_blocks and before + self.units[below] <= unit:
                place, before, at = below, before + self.units[below], at + self.chars[below]
            step >>= 1
        found = _UNIT.finditer(self.text, self._begin(at), min(at + self.block, len(self.text)))
        for _ in range(unit - before):
            next(found)
        return next(found).start()


@dataclass(frozen=True)
class Infill:
    n: int
    form: str
    output: str
    prefix_chars: int | None = None
    middle_chars: int | None = None


def transform(id_: int | None, text: str | None, seed: int = 1, block: int = BLOCK) -> Infill:
    """One text as an example: 10 in 100 stay plain, of the others 20 in 100 put the suffix first."""
    text = text or ""
    tree = Fenwick(text, block)
    digits = hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or h3 % 100 >= 90 or any(mark in text for mark in MARKS):
        return Infill(tree.n_units, PLAIN, text)
    first, second = map(tree.begin, sorted(h % (tree.n_units + 1) for h in (h1, h2)))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < 20:
        output = f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        return Infill(tree.n_units, SPM, output, first, second - first)
    output = f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return Infill(tree.n_units, PSM, output, first, second - first)


def restore(output: str, form: str) -> str:
    """The text behind an output."""
    if form == PLAIN:
        return output
    first, second = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    if form not in (PSM, SPM) or not output.startswith(first):
        raise ValueError(f"not an output of the form {form}")
    left, _, rest = output[len(first) :].partition(second)
    right, _, middle = rest.partition(MIDDLE)
    return left + middle + right if form == PSM else right + middle + left


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


_CUTS = [
    StructField("n", LongType()), StructField("form", StringType()),
    StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()),
]


def _run(docs: DataFrame, id_column: str, text_column: str, seed: int, block: int, added: dict[str, Callable[[Infill], str]]) -> DataFrame:
    """The cuts of each row and what ``added`` makes of them."""
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = StructType([StructField("id", narrow.schema["id"].dataType), *_CUTS, *(StructField(k, StringType()) for k in added)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            done: list[tuple] = []
            for i, t in zip(ids, texts, strict=True):
                made = transform(i.as_py(), t.as_py(), seed, block)
                cuts = (made.n, made.form, made.prefix_chars, made.middle_chars)
                done.append(cuts + tuple(make(made) for make in added.values()))
            columns = zip(*done, strict=True) if done else [[] for _ in schema.fields[1:]]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string() for _ in added]]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *arrays], names=schema.names)

    return narrow.mapInArrow(cut, schema).withColumnRenamed("id", id_column)


def examples(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", seed: int = 1, block: int = BLOCK) -> DataFrame:
    """Id, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` and the ``output`` text."""
    return _run(docs, id_column, text_column, seed, block, {"output": lambda made: made.output})


def digests(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", seed: int = 1, block: int = BLOCK) -> DataFrame:
    """As ``examples``, with digests of the output and of the text restored from it."""
    added = {
        "output_sha256": lambda made: _digest(made.output),
        "restored_sha256": lambda made: _digest(restore(made.output, made.form)),
    }
    return _run(docs, id_column, text_column, seed, block, added)
