"""BPE encoding and decoding by a prefix-sharing trie.

Every prefix of a word has one BPE encoding, and cutting off its last token leaves the encoding of
a shorter prefix.  So one number per prefix, its last token, holds the encodings of all prefixes.
The distinct words of a batch go into a trie, and a depth-first walk hands the last tokens of the
path down to each node: what many words share is encoded once.  The last token of a prefix is the
one token ending there that BPE would not merge into what stands before it.  Which tokens end there
is known from the longest end of the prefix that begins a token, also handed down the path.

Defined results: null and empty texts have no ids and decode to the empty text; ids of rows pass
through as they are, null and repeated ones too, one row per input row; other columns are ignored;
an empty table gives an empty result.  Texts are worked on in windows, so a long one needs memory
for its ids and one window only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from promptloom.llm import byte_bpe
from promptloom.llm.lean import lean

#: Characters of text whose words go into one trie.
WINDOW = 1_000_000
#: Words a Python worker remembers between tries, in two generations: when the younger is full, the
#: older one goes, with the words not met since.  A forgotten word is encoded again when it comes back.
REMEMBERED = 150_000
#: Pairs of tokens a worker remembers whether BPE leaves them side by side, and steps of a letter to the tokens that end there.
FITS = 400_000
#: Longer words are not worth sharing; each is a path of its own.
LONGEST = 256

#: The beginning of a token: its number (the low byte is free), its letters, and the tokens that end there, longest first.
Place = tuple[int, bytes, tuple[int, ...]]
_TOP: Place = (0, b"", ())
_NEVER = 1 << 62
#: The same pieces for text without letters above Latin-1, by the faster engine.  White space is named, as that
#: engine's \s takes in 0x1C to 0x1F.
_BLANK = r"\t-\r \x85\xa0"
_LATIN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9²³¹¼½¾]+"
    rf"| ?[^{_BLANK}0-9A-Za-zªµºÀ-ÖØ-öø-ÿ²³¹¼½¾]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)


class Trie:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, vocabulary: byte_bpe.Vocabulary, most_words: int = REMEMBERED, most_fits: int = FITS):
        self.vocabulary, self.most_words, self.most_fits = vocabulary, most_words, most_fits
        self.ids = vocabulary.ids
        self.merges = vocabulary.merges
        self.fits: dict[int, bool] = {}
        self.remembered: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.latin = re.compile(_LATIN)
        self.above_latin = re.compile("[^\x00-\xff]")
        self.heads: dict[bytes, Place | None] = {token[:n]: None for token in self.ids for n in range(1, len(token) + 1)}
        self.places = 1
        self.steps: dict[int, Place] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        top = max(vocabulary.tokens) + 1
        sizes = np.zeros(top, np.int64)
        for n, token in vocabulary.tokens.items():
            sizes[n] = len(token)
        self.sizes = sizes
        self.lengths = sizes.tolist()
        self.packed = [_packed(n) for n in range(top)]
        self.starts = np.cumsum(sizes) - sizes
        self.letters = np.frombuffer(b"".join(vocabulary.tokens.get(n, b"") for n in range(top)), np.uint8)

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stood at this edge while ``token`` was merged, each with the merge that ended it."""
        known = (self.left, self.right)[side]
        if token not in known:
            chain, ended, t = [], _NEVER, token
            while True:
                chain.append((t, ended))
                if t not in self.vocabulary.parts:
                    break
                ended, t = t, self.vocabulary.parts[t][side]
            known[token] = chain
        return known[token]

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens as they are: no merge across the border comes first.

        Merges happen in the order of the tokens they make, and of two equal ones the left comes
        first.  A merge across the border needs both its parts still standing.
        """
        key = byte_bpe.pair(left, right)
        fits = self.fits.get(key)
        if fits is None:
            merges, fits = self.merges, True
            rights = self.edge(right, 0)
            for x, x_ended in self.edge(left, 1):
                for y, y_ended in rights:
                    made = merges.get(x << 32 | y)
                    if made is not None and made < x_ended and made <= y_ended:
                        fits = False
            if len(self.fits) > self.most_fits:
                self.fits.clear()
            self.fits[key] = fits
        return fits

    def step(self, head: bytes) -> Place:
        """The longest end of ``head`` that begins a token, and the tokens that end there."""
        while head not in self.heads:
            head = head[1:]
            if not head:
                raise ValueError("the vocabulary lacks a byte")
        place = self.heads[head]
        if place is None:
            ends = (head[n:] for n in range(len(head)))
            place = self.heads[head] = (self.places << 8, head, tuple(self.ids[e] for e in ends if e in self.ids))
            self.places += 1
        return place

    def walk(self, word: bytes, end: int, path: list[int], places: list[Place]) -> None:
        """The last tokens of the prefixes of ``word`` up to ``end`` that ``path`` lacks.

        Only the tokens that end at a letter are tried there, longest first.
        """
        steps, fits, lengths, side_by_side = self.steps, self.fits, self.lengths, self.side_by_side
        place = places[-1]
        for size in range(len(path), end + 1):
            key = place[0] | word[size - 1]
            below = steps.get(key)
            if below is None:
                if len(steps) > self.most_fits:
                    steps.clear()
                below = steps[key] = self.step(place[1] + word[size - 1 : size])
            place = below
            for token in place[2]:
                length = lengths[token]
                if length == size:
                    break
                left = path[size - length]
                fit = fits.get(left << 32 | token)
                if fit or fit is None and side_by_side(left, token):
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            path.append(token)
            places.append(place)

    def chain(self, path: list[int]) -> list[int]:
        """The ids of the whole path, found from the last token back."""
        out, size, lengths = [], len(path) - 1, self.lengths
        while size:
            token = path[size]
            out.append(token)
            size -= lengths[token]
        out.reverse()
        return out

    def alone(self, word: bytes) -> bytes:
        """A long word: the walk down a single path."""
        path, places = [0], [_TOP]
        for begin in range(0, len(word), LONGEST):
            self.walk(word, min(begin + LONGEST, len(word)), path, places)
            del places[:-1]
        return np.asarray(self.chain(path), dtype="<u4").tobytes()

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """The ids of distinct words, packed as 32-bit numbers.

        In sorted order the words are met as a depth-first walk through their trie meets them: the prefix that a word
        shares with the one before it is still on the path.
        """
        found: dict[str, bytes] = {}
        path, places, before, packed = [0], [_TOP], b"", self.packed
        for word in sorted(words):
            raw = word.encode()
            if len(raw) > LONGEST:
                found[word] = self.alone(raw)
                continue
            shared = 0
            for one, other in zip(raw, before):  # noqa: B905
                if one != other:
                    break
                shared += 1
            del path[shared + 1 :], places[shared + 1 :]
            self.walk(raw, len(raw), path, places)
            found[word] = b"".join([packed[token] for token in self.chain(path)])
            before = raw
        return found

    def pieces(self, segment: str) -> Iterator[list[str]]:
        """The pieces of a segment, a window at a time."""
        cut = self.vocabulary.piece if self.above_latin.search(segment) else self.latin
        begin, window = 0, WINDOW
        while begin + window < len(segment):
            found = cut.findall(segment[begin : begin + window])[:-2]  # the last may go on behind the window
            if found:
                yield found
                begin, window = begin + sum(map(len, found)), WINDOW
            else:
                window *= 2
        yield cut.findall(segment[begin:] if begin else segment)

    def remember(self, words: set[str]) -> None:
        if len(self.remembered) > self.most_words:
            self.older, self.remembered = self.remembered, {}
        missing = words.difference(self.remembered)
        older = self.older
        self.remembered.update((w, older[w]) for w in missing if w in older)
        self.remembered.update(self.encode_words(missing.difference(older)))

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """The packed ids of each text; short texts share a trie."""
        waiting: list[tuple[list, bool]] = []  # the parts of a text
        size = 0
        for text in texts:
            if text and len(text) > WINDOW:
                yield from self._flush(waiting)
                waiting, size = [], 0
                yield self._long(text)
                continue
            parts: list = []
            for s in self.vocabulary.segments(text or ""):
                special = self.vocabulary.specials.get(s)
                parts.append(special if special is not None else next(self.pieces(s)))
            waiting.append(parts)
            size += len(text or "")
            if size > WINDOW:
                yield from self._flush(waiting)
                waiting, size = [], 0
        yield from self._flush(waiting)

    def _flush(self, waiting: list) -> Iterator[bytes]:
        words: set[str] = set()
        for parts in waiting:
            for p in parts:
                if not isinstance(p, int):
                    words.update(p)
        self.remember(words)
        known = self.remembered.__getitem__
        for parts in waiting:
            yield b"".join(_packed(p) if isinstance(p, int) else b"".join(map(known, p)) for p in parts)

    def _long(self, text: str) -> bytes:
        out = []
        for s in self.vocabulary.segments(text):
            special = self.vocabulary.specials.get(s)
            if special is not None:
                out.append(_packed(special))
                continue
            for found in self.pieces(s):
                self.remember(set(found))
                out.append(b"".join(map(self.remembered.__getitem__, found)))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become the replacement character."""
        ids = np.frombuffer(packed, dtype="<u4")
        if not ids.size:
            return ""
        if int(ids.max()) >= self.sizes.size:
            raise ValueError("an id is outside the vocabulary")
        sizes = self.sizes[ids]
        begins = np.cumsum(sizes) - sizes
        at = np.repeat(self.starts[ids] - begins, sizes)
        at += np.arange(at.size)
        return self.letters[at].tobytes().decode("utf-8", "replace")


def _packed(number: int) -> bytes:
    return number.to_bytes(4, "little")


@lru_cache(maxsize=2)
def trie(content: bytes, most_words: int = REMEMBERED, most_fits: int = FITS) -> Trie:
    return Trie(byte_bpe.parse(content), most_words, most_fits)


def _encoding(spec):
    def run(batches):
        coder = trie(spec.value)
        for batch in batches:
            ids, texts = batch.columns
            packed = pa.array(coder.encode_all(texts.to_pylist()), pa.binary())
            yield pa.record_batch([ids, packed], names=["id", "packed"])

    return run


def _both(spec):
    def run(batches):
        coder = trie(spec.value)
        for batch in batches:
            ids, texts = batch.columns
            counts, encoded, decoded = [], [], []
            for packed in coder.encode_all(texts.to_pylist()):
                counts.append(len(packed) // 4)
                encoded.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(packed).encode()).hexdigest())
            yield pa.record_batch(
                [ids, pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _checked(spec, most_words: int = REMEMBERED, most_fits: int = FITS):
    def run(batches):
        coder = trie(spec.value, most_words, most_fits)
        for batch in batches:
            ids, texts = batch.columns
            texts = texts.to_pylist()
            packed, counts, same = [], [], []
            for one, text in zip(coder.encode_all(texts), texts, strict=True):
                packed.append(one)
                counts.append(len(one) // 4)
                same.append(coder.decode(one) == (text or ""))
            yield pa.record_batch(
                [ids, pa.array(counts, pa.int64()), pa.array(packed, pa.binary()), pa.array(same, pa.bool_())],
                names=["id", "n_tokens", "packed", "round_trip"],
            )

    return run


def _decoding(spec):
    def run(batches):
        coder = trie(spec.value)
        for batch in batches:
            ids, packed = batch.columns
            texts = pa.array((None if p is None else coder.decode(p) for p in packed.to_pylist()), pa.string())
            yield pa.record_batch([ids, texts], names=["id", "text"])

    return run


def _run(df: DataFrame, make, vocabulary: str, id_column: str, column: str, kind: str, fields: list) -> DataFrame:
    spec = df.sparkSession.sparkContext.broadcast(byte_bpe.content(vocabulary))
    narrow = df.select(F.col(id_column).alias("id"), F.col(column).cast(kind).alias("value"))
    schema = StructType([StructField("id", narrow.schema["id"].dataType), *fields])
    return narrow.mapInArrow(lean(make(spec), text=1), schema).withColumnRenamed("id", id_column)


def encode(docs: DataFrame, vocabulary: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id and ``packed``: the token ids as little-endian unsigned 32-bit numbers."""
    return _run(docs, _encoding, vocabulary, id_column, text_column, "string", [StructField("packed", BinaryType())])


def decode(encoded: DataFrame, vocabulary: str, *, id_column: str = "doc_id", packed_column: str = "packed") -> DataFrame:
    """Id and ``text`` of packed ids; null stays null."""
    return _run(encoded, _decoding, vocabulary, id_column, packed_column, "binary", [StructField("text", StringType())])


def round_trip(docs: DataFrame, vocabulary: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, number of tokens, and the digests of the ids and of the text they decode to."""
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return _run(docs, _both, vocabulary, id_column, text_column, "string", fields)


def encode_checked(
    docs: DataFrame, vocabulary: str, *, id_column: str = "doc_id", text_column: str = "text", most_words: int = REMEMBERED, most_fits: int = FITS
) -> DataFrame:
    """Id, number of tokens, ``packed`` ids, and whether they decode to the text.

    ``most_words`` and ``most_fits`` bound what a worker remembers, where it is shared with other stages; the ids stay the same.
    """
    fields = [StructField("n_tokens", LongType()), StructField("packed", BinaryType()), StructField("round_trip", BooleanType())]
    make = lambda spec: _checked(spec, most_words, most_fits)
    return _run(docs, make, vocabulary, id_column, text_column, "string", fields)
