"""Hashes of words and word shingles over whole Arrow batches, with numpy.

Words are maximal runs of bytes other than blank and 0x09-0x0D, A-Z lower-cased.  A word's hash is
a polynomial over 64 bits of random numbers that stand for its bytes; a shingle's hash mixes those
of its words.  Texts are cut at blanks, so memory does not depend on how long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at once.
SLICE = 500_000

_RNG = np.random.default_rng(20_240_229)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(4096)


def _words(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word; ``begins`` are places where no word goes on."""
    inside = ~_BLANK[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = begins[begins < raw.size]
    first[at] = inside[at]
    letters = np.flatnonzero(inside)
    starts = np.flatnonzero(first)
    if not starts.size:
        return np.empty(0, np.uint64), starts
    heads = np.searchsorted(letters, starts)
    sizes = np.diff(np.append(heads, letters.size))
    place = np.arange(letters.size) - np.repeat(heads, sizes)
    powers = _POWERS if sizes.max() <= _POWERS.size else _powers(int(sizes.max()))
    return mix(np.add.reduceat(_LETTER[raw[letters]] * powers[place], heads) + sizes.astype(np.uint64)), starts


def slices(texts: pa.StringArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``first`` to ``last`` with their words: hashes, and the row of each, counted from ``first``."""
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        begin, end = offsets[first], offsets[last]
        if end - begin <= SLICE:
            hashes, starts = _words(raw[begin:end], offsets[first:last] - begin)
            rows = np.searchsorted(offsets[first : last + 1] - begin, starts, side="right") - 1
        else:  # one long text, a slice at a time
            parts = []
            while begin < end:
                stop = min(begin + SLICE, end)
                while stop < end and not _BLANK[raw[stop]]:  # to the end of the word
                    blanks = np.flatnonzero(_BLANK[raw[stop : stop + SLICE]])
                    stop = stop + int(blanks[0]) if blanks.size else min(stop + SLICE, end)
                stop = min(stop, end)
                parts.append(_words(raw[begin:stop], np.zeros(1, np.int64))[0])
                begin = stop
            hashes = np.concatenate(parts)
            rows = np.zeros(hashes.size, np.int64)
        yield first, last, hashes, rows
        first = last


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as (hash, row), by row and hash; fewer words than ``width`` make one shingle."""
    counts = np.bincount(rows, minlength=n_rows)
    begins = np.cumsum(counts) - counts
    full = max(hashes.size - width + 1, 0)
    mixed = np.zeros(full, np.uint64)
    for j in range(width):
        mixed += hashes[j : j + full] * _PLACE[j]
    whole = rows[:full] == rows[width - 1 :] if full else np.empty(0, bool)
    found, owner = mix(mixed[whole]), rows[:full][whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if short.size:
        total = np.zeros(short.size, np.uint64)
        for j in range(width - 1):
            has = counts[short] > j
            total[has] += hashes[begins[short[has]] + j] * _PLACE[j]
        found = np.concatenate([found, mix(total + counts[short].astype(np.uint64) * _PLACE[width])])
        owner = np.concatenate([owner, short])
    order = np.argsort(found, kind="stable")
    order = order[np.argsort(owner[order].astype(np.uint16 if n_rows < 65_536 else np.int64), kind="stable")]
    found, owner = found[order], owner[order]
    if found.size:
        new = np.ones(found.size, bool)
        new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        found, owner = found[new], owner[new]
    return found, owner
