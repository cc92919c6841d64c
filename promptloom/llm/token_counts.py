"""Token counts by overlap resynchronisation.

A short text is encoded whole.  A huge one is cut into chunks that overlap, each encoded on its
own with the offsets of its pieces.  Two neighbours are spliced at a position where both begin a
piece: the pattern that cuts pieces never looks back, so from such a position on the right chunk's
pieces are those of the whole text.  Positions too near the end of the left chunk prove nothing
(a piece, a look-ahead or a special string may run past it) and are left out.  Where no common
position is left, the left chunk is encoded again with twice the overlap, until one is found or it
has swallowed its neighbour.

Defined results: null or empty text has 0 tokens; ids pass through as they are, null and repeated
ones too, one row per input row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from promptloom.llm import byte_bpe

CHUNK = 32_768
OVERLAP = 1_024


class Counter:
    """Counts tokens of whole texts; holds no more than one chunk's tokens at a time."""

    def __init__(self, vocabulary: byte_bpe.Vocabulary, chunk: int = CHUNK, overlap: int = OVERLAP):
        if not 0 < overlap < chunk:
            raise ValueError("overlap must be positive and below the chunk length")
        self.vocabulary, self.chunk, self.overlap = vocabulary, chunk, overlap
        self.encoding = tiktoken.Encoding(
            "counts", pat_str=byte_bpe.PIECES, mergeable_ranks=vocabulary.ids, special_tokens={}
        )

    def plain(self, text: str) -> int:
        special, count = self.vocabulary.specials, self.encoding.encode_ordinary
        return sum(1 if s in special else len(count(s)) for s in self.vocabulary.segments(text))

    def offsets(self, text: str, at: int) -> np.ndarray:
        """Where each piece of the chunk begins in the whole text."""
        starts, begin = [], at
        for s in self.vocabulary.segments(text):
            if s in self.vocabulary.specials:
                starts.append(begin)
            else:
                starts.extend(begin + m.start() for m in self.vocabulary.piece.finditer(s))
            begin += len(s)
        return np.asarray(starts, dtype=np.int64)

    def spliced(self, text: str) -> int:
        """The tokens of a huge text: each chunk counts from its splice to the next one's."""
        step, size, margin = self.chunk - self.overlap, len(text), self.vocabulary.margin
        total, true = 0, 0  # true: where the running chunk's pieces are those of the whole text
        begin, end = 0, min(self.chunk, size)
        starts = self.offsets(text[begin:end], begin)
        while end < size:
            right = begin + step
            right_end = min(right + self.chunk, size)
            right_starts = self.offsets(text[right:right_end], right)
            overlap = self.overlap
            while True:
                common = np.intersect1d(starts, right_starts, assume_unique=True)
                common = common[(common >= max(true, right)) & (common <= end - margin)]
                if common.size or end == size or end >= right_end:
                    break
                overlap *= 2  # widen: the left chunk reaches further into its neighbour
                end = min(right + overlap, right_end)
                starts = self.offsets(text[true:end], true)
            if common.size:
                splice = int(common[-1])
                total += self.plain_between(text, true, splice, end)
                true, begin, end, starts = splice, right, right_end, right_starts
            else:  # the neighbour is swallowed whole
                begin = right
        return total + self.plain_between(text, true, size, size)

    def plain_between(self, text: str, begin: int, stop: int, end: int) -> int:
        """Tokens of text[begin:stop], which begins and ends with pieces of the whole text.

        Pieces are encoded apart from each other, so the part can be encoded alone; what may differ
        at its end is where a blank before more text belongs, so the encoding runs on to ``end``
        and stops counting at ``stop``.
        """
        part = text[begin:end]
        if stop == end:
            return self.plain(part)
        wanted, seen, count = len(text[begin:stop].encode()), 0, 0
        for s in self.vocabulary.segments(part):
            if seen >= wanted:
                break
            if s in self.vocabulary.specials:
                seen, count = seen + len(s.encode()), count + 1
                continue
            tokens = self.encoding.encode_ordinary(s)
            ends = seen + np.cumsum([len(self.vocabulary.tokens[t]) for t in tokens])
            inside = int(np.searchsorted(ends, wanted, side="right"))
            count, seen = count + inside, int(ends[-1])
        return count

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        return self.plain(text) if len(text) <= self.chunk else self.spliced(text)


@lru_cache(maxsize=4)
def _counter(content: bytes, chunk: int, overlap: int) -> Counter:
    return Counter(byte_bpe.parse(content), chunk, overlap)


def _counting(spec, chunk: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        counter = _counter(spec.value, chunk, overlap)
        for batch in batches:
            ids, texts = batch.columns
            counts = pa.array((counter(t.as_py()) for t in texts), pa.int64())
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.record_batch([ids, sizes, counts], names=["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = 512,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """One row per input row: id, UTF-8 bytes, tokens, and whether they exceed ``limit``."""
    spec = docs.sparkSession.sparkContext.broadcast(byte_bpe.content(vocabulary))
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = StructType(
        [StructField("id", narrow.schema["id"].dataType), StructField("n_bytes", LongType()), StructField("n_tokens", LongType())]
    )
    counted = narrow.mapInArrow(_counting(spec, chunk, overlap), schema)
    return counted.select(
        F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).cast(BooleanType()).alias("over_limit")
    )
