"""Removal of repeated 100-byte strings, by a hash-compared suffix sort.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document of a
smaller id, or earlier in the same one.  All places of equal strings have to meet, without sending
every suffix anywhere.  So the suffixes are dealt out by anchors.  The anchor of a string is the
place inside it whose ``GRAM`` bytes hash lowest (the leftmost of equal ones); equal strings have
equal anchors at equal offsets.  Neighbouring strings share anchors, which leaves one record for
about 25 bytes.  A record's key is the hash of its anchor and of the bytes beside it that all of
its strings cover.

1. Keys that occur twice anywhere are found from the keys alone (each sent once or twice a slice of
   text, however often it occurs there) and kept as bits of a map of bounded size.
2. Records of such keys are sent with a hash of all bytes their strings cover.  Where several agree
   in it, all but the earliest go; within a slice of text that is settled before anything is sent.
3. Where one key has records that differ, the earliest of each kind sends its bytes.  Their suffixes
   are sorted: a merge sort compares two by the hashes of their prefixes, doubling steps and binary
   search giving the length of what they share.  The order is then verified byte by byte (a run the
   hashes got wrong is sorted by its bytes), neighbours that share ``LENGTH`` bytes are equal, and
   all but the earliest go.  The strings of a key of very many kinds are compared as such: the
   earliest of each is an aggregate by its bytes, which tasks begin on their own, and is joined back.
4. The spans go to their documents, which are cut and hashed.

Exact copies of a text are known by id alone: a task sends a text again only under a smaller id.

The two bit maps are all that is broadcast; their size follows the input up to ``MOST_BITS``.  A
map too small for its keys lets superfluous records through, never fewer.  Nothing else reaches
the driver.  Long texts are scanned in slices.  Step 2 takes records as equal on two independent
64-bit hashes of their bytes.

Defined results: null and empty texts have no bytes; rows of equal id and text are one document and
returned once; a repeated id with different texts is ordered by their hashes; a null id comes after
all others; ids are whole numbers; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.minmax import whole_groups
from promptloom.llm.wordhash import mix
from promptloom.session import scratch_path

LENGTH, GRAM = 100, 16
#: Offsets from here on take their key from the bytes left of the anchor, the others from those right of it.
SIDE = (LENGTH - GRAM) // 2
SLICE = 200_000
#: Parts of a bit map (the high byte of a key), and its bits.
BUCKETS = 256
LEAST_BITS, MOST_BITS = 20, 30
#: Kinds of one key from which on it is split by string.
MANY = 2_000
#: Strings, and bytes, sorted together.
TOGETHER, TOGETHER_BYTES = 60_000, 1 << 20
#: Strings sent at once.
AT_ONCE = 20_000

_SPAN = LENGTH - GRAM + 1
_RNG = np.random.default_rng(5)
_PLACE_BITS = np.uint64((1 << 21) - 1)
_LAST = (1 << 63) - 1


class Hashes:
    """Prefix sums of a polynomial over 64 bits; any substring's hash is one subtraction and one product."""

    def __init__(self, base: int, size: int):
        self.letter = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = base
        self.reach(size)

    def reach(self, size: int) -> None:
        self.powers, self.inverse = self._run(self.base, size), self._run(pow(self.base, -1, 1 << 64), size)

    @staticmethod
    def _run(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        if raw.size > self.powers.size:
            self.reach(raw.size)
        out = np.zeros(raw.size + 1, np.uint64)
        np.cumsum(self.letter[raw] * self.powers[: raw.size], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[begin]) * self.inverse[begin]


_ROOM = SLICE + LENGTH + 1
_FIRST = Hashes(0x9E3779B97F4A7C15, max(_ROOM, 1 << 20))
_SECOND = Hashes(0xD6E8FEB86659FD93, _ROOM)


@dataclass
class Records:
    """The records of one slice; places count from the slice's first byte."""

    raw: np.ndarray
    prefix: np.ndarray
    row: np.ndarray  # of the batch
    begin: np.ndarray  # the first string's place
    width: np.ndarray  # strings less one
    offset: np.ndarray  # of the anchor in the first string
    key: np.ndarray
    shift: np.ndarray  # place in the document, less place in the slice

    def strong(self) -> np.ndarray:
        prefix = _SECOND.prefix(self.raw)
        whole = _SECOND.of(prefix, self.begin, self.begin + self.width + LENGTH)
        return mix(whole + self.width.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + self.offset.astype(np.uint64))


def _slice_records(raw: np.ndarray, rows: np.ndarray, begins: np.ndarray, ends: np.ndarray, shifts: np.ndarray) -> Records | None:
    """Records of the strings that lie within one of the parts begins-ends."""
    strings = raw.size - LENGTH + 1
    if strings < 1:
        return None
    prefix = _FIRST.prefix(raw)
    gram = prefix[GRAM:] - prefix[:-GRAM]
    gram *= _FIRST.inverse[: gram.size]
    gram ^= gram >> np.uint64(29)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    low = (gram & ~_PLACE_BITS) | np.arange(gram.size, dtype=np.uint64)
    size = 1
    while 2 * size <= _SPAN:  # the minimum over every _SPAN places, by doubling
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < _SPAN:
        low = np.minimum(low[: low.size - (_SPAN - size)], low[_SPAN - size :])
    anchor = (low & _PLACE_BITS).astype(np.int64)

    part = np.zeros(raw.size, np.int32)
    part[begins[begins > 0]] = 1
    part = np.cumsum(part)[:strings]
    fits = np.flatnonzero(np.arange(strings) + LENGTH <= ends[part])
    if not fits.size:
        return None
    anchor, part = anchor[fits], part[fits]
    new = np.ones(fits.size, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])
    head = np.flatnonzero(new)
    first, last = fits[head], fits[np.append(head[1:] - 1, fits.size - 1)]
    at, part = anchor[head], part[head]
    # strings whose anchor lies far in take the bytes left of it into the key, the others those right of it
    border = at - SIDE
    left, right = first <= border, last > border
    begin = np.concatenate([first[left], np.maximum(first, border + 1)[right]])
    final = np.concatenate([np.minimum(last, border)[left], last[right]])
    at, part = np.concatenate([at[left], at[right]]), np.concatenate([part[left], part[right]])
    n_left = int(left.sum())
    low_end = np.where(np.arange(at.size) < n_left, at - SIDE, at)
    high_end = np.where(np.arange(at.size) < n_left, at + GRAM, at + LENGTH - SIDE + 1)
    key = mix(_FIRST.of(prefix, low_end, high_end) + (np.arange(at.size) < n_left))
    return Records(raw, prefix, rows[part], begin, final - begin, at - begin, key, shifts[part])


def scan(texts: pa.StringArray, rows: np.ndarray) -> Iterator[Records]:
    """Records of the given rows of a batch, a slice at a time."""
    texts = texts.cast(pa.string())  # where Spark was told to use large Arrow types
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    parts: list[tuple[int, int, int, int]] = []
    held = 0

    def flush() -> Records | None:
        raw = np.concatenate([data[a:b] for _, a, b, _ in parts])
        sizes = np.array([b - a for _, a, b, _ in parts])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        shifts = np.array([s for *_, s in parts]) - begins
        return _slice_records(raw, np.array([r for r, *_ in parts]), begins, ends, shifts)

    for row in rows:
        begin, end = int(offsets[row]), int(offsets[row + 1])
        for at in range(begin, max(end - LENGTH + 1, begin), SLICE):
            stop = min(at + SLICE + LENGTH - 1, end)
            if parts and held + stop - at > SLICE:
                if (found := flush()) is not None:
                    yield found
                parts, held = [], 0
            parts.append((int(row), at, stop, at - begin))
            held += stop - at
    if parts and (found := flush()) is not None:
        yield found


def _fresh(seen: dict, ids: np.ndarray, numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows whose text this task has not yet met under an id as small."""
    out = []
    for row, (id_, text) in enumerate(zip(ids.tolist(), zip(numbers.tolist(), sizes.tolist(), strict=True), strict=True)):
        if text[1] >= LENGTH and id_ < seen.get(text, _LAST + 1):
            seen[text] = id_
            out.append(row)
    return np.array(out, np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Iterator[Records]]]:
    seen: dict = {}
    for batch in batches:
        ids, numbers = (batch.column(c).to_numpy() for c in ("id", "text_no"))
        texts = batch.column("text")
        fresh = _fresh(seen, ids, numbers, batch.column("n_bytes").to_numpy())
        if fresh.size:
            yield ids, numbers, scan(texts, fresh)


# ---------------------------------------------------------------- maps of bits


def _dealt(keys: np.ndarray) -> pa.RecordBatch:
    """Keys in one row a bucket."""
    keys = np.sort(keys)
    bucket = (keys >> np.uint64(56)).astype(np.int64)
    spans = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    return pa.record_batch(
        [pa.array(bucket[spans[:-1]], pa.int64()), pa.array([keys[a:b].tobytes() for a, b in zip(spans[:-1], spans[1:], strict=True)], pa.binary())],
        names=["bucket", "keys"],
    )


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a key, in its bucket's part of the map."""
    inside = np.uint64((1 << (bits - 8)) - 1)
    top = (keys >> np.uint64(56)) << np.uint64(bits - 8)
    return top | (keys & inside), top | ((keys >> np.uint64(26)) & inside)


def _segments(bits: int, twice: bool):
    """The part of the map of each bucket: keys met (at least twice, if asked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bucket"):
            buckets = table.column("bucket").to_numpy()
            blobs = table.column("keys").to_pylist()
            spans = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]]))
            for a, b in zip(spans[:-1], spans[1:], strict=True):
                keys = np.sort(np.frombuffer(b"".join(blobs[a:b]), np.uint64))
                if twice:
                    keys = keys[1:][keys[1:] == keys[:-1]]
                size = 1 << (bits - 8)
                part = np.zeros(size, bool)
                for places in _places(keys, bits):
                    part[(places & np.uint64(size - 1)).astype(np.int64)] = True
                packed = np.packbits(part).tobytes() if keys.size else b""
                yield pa.record_batch([pa.array([buckets[a]], pa.int64()), pa.array([packed], pa.binary())], names=["bucket", "part"])

    return run


def _bit_map(keys: DataFrame, bits: int, twice: bool) -> bytes:
    """The map of all buckets; its size is bounded by MOST_BITS."""
    parts = keys.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_segments(bits, twice), "bucket long, part binary")
    size = (1 << (bits - 8)) // 8
    whole = bytearray(size * BUCKETS)
    for row in parts.filter(F.length("part") > 0).collect():  # 2**bits bits in all
        whole[row.bucket * size : (row.bucket + 1) * size] = row.part
    return bytes(whole)


def _in_map(packed: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    out = np.ones(keys.size, bool)
    for places in _places(keys, bits):
        places = places.astype(np.int64)
        out &= (packed[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 == 1
    return out


# ---------------------------------------------------------------- the scans


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, slices in _batches(batches):
        found = []
        for records in slices:
            keys, counts = np.unique(records.key, return_counts=True)
            found += [keys, keys[counts > 1]]
        if found:
            yield _dealt(np.concatenate(found))


def _hashed(shipped, bits: int):
    def run(batches):
        repeated = np.frombuffer(shipped.value, np.uint8)
        for ids, numbers, slices in _batches(batches):
            for records in slices:
                use = np.flatnonzero(_in_map(repeated, bits, records.key))
                if not use.size:
                    continue
                row, strong, key = records.row[use], records.strong()[use], records.key[use].copy()
                begin = (records.begin + records.shift)[use]
                # of equal records in a slice only the earliest has to meet the others
                order = np.lexsort((begin, numbers[row], ids[row], strong, key))
                again = np.zeros(use.size, bool)
                again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (strong[order[1:]] == strong[order[:-1]])
                key[again] = mix(key[again] + begin[again].astype(np.uint64) * np.uint64(3) + numbers[row][again].view(np.uint64))
                yield pa.record_batch(
                    [
                        pa.array(key.view(np.int64)), pa.array(strong.view(np.int64)), pa.array(ids[row]), pa.array(numbers[row]),
                        pa.array(begin), pa.array((records.width[use] << 8 | records.offset[use]).astype(np.int32)), pa.array(again),
                    ],
                    names=["key", "strong", "id", "text_no", "begin", "shape", "again"],
                )

    return run


def _asked(key: np.ndarray, number: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return mix(key + mix(number.view(np.uint64) + mix(begin.astype(np.uint64))))


def _asked_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            key, number, begin = (batch.column(c).to_numpy() for c in ("key", "text_no", "begin"))
            yield _dealt(_asked(key.view(np.uint64), number, begin))


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield _dealt(batch.column("key").to_numpy().view(np.uint64))


def _asked_records(shipped, bits: int, batches: Iterator[pa.RecordBatch], frequent: bool):
    """(ids, numbers, records, which of them are asked for) of each slice; those of very frequent keys, or the others.

    All records of a key are on the same side, so that no match is lost to a false positive of a map.
    """
    repeated, asked, many = (np.frombuffer(b, np.uint8) for b in shipped.value)
    for ids, numbers, slices in _batches(batches):
        for r in slices:
            use = np.flatnonzero(_in_map(repeated, bits, r.key))
            use = use[_in_map(asked, bits, _asked(r.key[use], numbers[r.row[use]], (r.begin + r.shift)[use]))]
            use = use[_in_map(many, bits, r.key[use]) == frequent]
            if use.size:
                yield ids, numbers, r, use


def _bytes(shipped, bits: int):
    """Sends the bytes of the records asked for."""

    def run(batches):
        for ids, numbers, r, use in _asked_records(shipped, bits, batches, False):
            row, begin, width, key, offset, shift = (a[use] for a in (r.row, r.begin, r.width, r.key, r.offset, r.shift))
            text = r.raw.tobytes()
            yield pa.record_batch(
                [
                    pa.array(key.view(np.int64)), pa.array(ids[row]), pa.array(numbers[row]), pa.array(begin + shift),
                    pa.array(offset.astype(np.int32)), pa.array([text[a : a + w + LENGTH] for a, w in zip(begin.tolist(), width.tolist(), strict=True)], pa.binary()),
                ],
                names=["key", "id", "text_no", "begin", "offset", "bytes"],
            )

    return run


def _strings(shipped, bits: int):
    """Sends each string of the records asked for whose keys are very frequent."""

    def run(batches):
        for ids, numbers, r, use in _asked_records(shipped, bits, batches, True):
            sizes = r.width[use] + 1
            every = np.repeat(r.begin[use], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            records = np.repeat(use, sizes)
            view = np.lib.stride_tricks.sliding_window_view(r.raw, LENGTH)
            for k in range(0, every.size, AT_ONCE):
                at, record = every[k : k + AT_ONCE], records[k : k + AT_ONCE]
                row = r.row[record]
                borders = np.arange(at.size + 1, dtype=np.int32) * np.int32(LENGTH)
                buffers = [None, pa.py_buffer(borders), pa.py_buffer(np.ascontiguousarray(view[at]))]
                yield pa.record_batch(
                    [pa.array(ids[row]), pa.array(numbers[row]), pa.array(at + r.shift[record]), pa.Array.from_buffers(pa.binary(), at.size, buffers)],
                    names=["id", "text_no", "begin", "bytes"],
                )

    return run


# ---------------------------------------------------------------- the sort


class Suffixes:
    """Suffixes of a buffer, cut after LENGTH bytes, compared by hashes of what follows them."""

    STEPS = (64, 32, 16, 8, 4, 2)

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        prefix = _FIRST.prefix(raw)
        self.hashes = {}
        for step in self.STEPS:
            whole = prefix[step:] - prefix[:-step]
            self.hashes[step] = whole * _FIRST.inverse[: whole.size]

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b share, up to LENGTH: a binary search over prefix hashes."""
        out = np.zeros(a.size, np.int64)
        for step in (*self.STEPS, 1):
            try_ = np.flatnonzero(out + step <= LENGTH)
            of = self.raw if step == 1 else self.hashes[step]
            same = of[a[try_] + out[try_]] == of[b[try_] + out[try_]]
            out[try_[same]] += step
        return out

    def order(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the suffix at a comes before, equals, or comes after that at b."""
        shared = self.shared(a, b)
        out = np.zeros(a.size, np.int8)
        differ = np.flatnonzero(shared < LENGTH)
        x, y = self.raw[a[differ] + shared[differ]], self.raw[b[differ] + shared[differ]]
        out[differ] = np.where(x < y, -1, 1)
        return out

    def sort(self, places: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Merge sort of the places within each group (given sorted by group), all runs of a level at a time."""
        places = places.copy()
        n = places.size
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.empty(0, np.int64)
        sizes = np.diff(np.append(starts, n))
        head, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        local = np.arange(n) - head
        run = 1
        while run < (sizes.max() if n else 0):
            live = np.flatnonzero(size > run)
            begin = local[live] // (2 * run) * (2 * run)
            is_left = local[live] - begin < run
            other_begin = np.where(is_left, begin + run, begin)
            other_end = np.minimum(other_begin + run, size[live])
            low, high = other_begin + head[live], np.maximum(other_end, other_begin) + head[live]
            first = low.copy()
            todo = np.flatnonzero(low < high)
            while todo.size:  # where in the other run: before equals for the left one, behind them for the right one
                middle = (low[todo] + high[todo]) >> 1
                sign = self.order(places[middle], places[live[todo]])
                ahead = (sign < 0) | ((sign == 0) & ~is_left[todo])
                low[todo] = np.where(ahead, middle + 1, low[todo])
                high[todo] = np.where(ahead, high[todo], middle)
                todo = todo[low[todo] < high[todo]]
            own = local[live] - np.where(is_left, begin, begin + run)
            target = head[live] + begin + own + (low - first)
            moved = places.copy()
            moved[target] = places[live]
            places = moved
            run *= 2
        return places

    def verified(self, places: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Which place holds the same string as the one before it; sorts groups by bytes where the hashes erred."""
        view = np.lib.stride_tricks.sliding_window_view(self.raw, LENGTH)
        for _ in range(2):
            same = np.zeros(places.size, bool)
            wrong: list[np.ndarray] = []
            for begin in range(1, places.size, 50_000):
                k = np.arange(begin, min(begin + 50_000, places.size))
                k = k[group[k] == group[k - 1]]
                a, b = view[places[k - 1]], view[places[k]]
                differ = a != b
                equal = ~differ.any(axis=1)
                at = differ.argmax(axis=1)
                rows = np.arange(k.size)
                same[k] = equal
                wrong.append(group[k[~equal & (a[rows, at] > b[rows, at])]])
            bad = np.unique(np.concatenate(wrong)) if wrong else np.empty(0, np.int64)
            if not bad.size:
                break
            for g in bad:
                low, high = np.searchsorted(group, [g, g + 1])
                places[low:high] = sorted(places[low:high].tolist(), key=lambda p: view[p].tobytes())
        return same


def repeated_strings(key: np.ndarray, offset: np.ndarray, rank: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, first string, last string) of runs of strings that an earlier record of the key holds too.

    ``rank`` orders the records; ``offset`` is that of the anchor in the first string.
    """
    sizes = np.array([len(t) for t in texts])
    widths = sizes - LENGTH + 1
    record = np.repeat(np.arange(sizes.size), widths)
    number = np.arange(record.size) - np.repeat(np.cumsum(widths) - widths, widths)
    place = np.repeat(np.cumsum(sizes) - sizes, widths) + number
    at = offset[record] - number
    order = np.lexsort((rank[record], at, key[record]))
    k, a = key[record[order]], at[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (a[1:] != a[:-1])])
    group = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1
    order, group = order[several], group[several]
    gone = np.zeros(record.size, bool)
    if order.size:
        suffixes = Suffixes(np.frombuffer(b"".join(texts), np.uint8))
        owner = np.empty(suffixes.raw.size, np.int64)
        owner[place] = np.arange(record.size)
        ordered = suffixes.sort(place[order], group)
        same = suffixes.verified(ordered, group)
        run = np.cumsum(~same) - 1
        whose = owner[ordered]
        heads = np.flatnonzero(~same)
        first = np.minimum.reduceat(rank[record[whose]], heads)
        gone[whose] = rank[record[whose]] > first[run]
    ends = np.flatnonzero(gone & ~np.concatenate([gone[1:] & (record[1:] == record[:-1]), [False]]))
    starts = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1] & (record[1:] == record[:-1])]))
    return record[starts], number[starts], number[ends]


def _sorted_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, "key"):
        keys = table.column("key").to_numpy()
        sizes = pa.compute.binary_length(table.column("bytes")).to_numpy() - LENGTH + 1
        borders = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        before = np.concatenate([[0], np.cumsum(sizes)])[borders]
        bytes_before = np.concatenate([[0], np.cumsum(sizes + LENGTH - 1)])[borders]
        k = 0
        while k < borders.size - 1:  # some keys at a time
            j = int(np.searchsorted(before, before[k] + TOGETHER, side="right")) - 1
            j = max(min(j, int(np.searchsorted(bytes_before, bytes_before[k] + TOGETHER_BYTES, side="right")) - 1), k + 1)
            part = table.slice(borders[k], borders[j] - borders[k])
            k = j
            ids, numbers, begins = (part.column(c).to_numpy() for c in ("id", "text_no", "begin"))
            offsets = part.column("offset").to_numpy().astype(np.int64)
            order = np.lexsort((begins + offsets, numbers, ids))
            rank = np.empty(order.size, np.int64)
            rank[order] = np.arange(order.size)
            record, first, last = repeated_strings(part.column("key").to_numpy(), offsets, rank, part.column("bytes").to_pylist())
            if record.size:
                yield pa.record_batch(
                    [pa.array(ids[record]), pa.array(numbers[record]), pa.array(begins[record] + first), pa.array(begins[record] + last + LENGTH)],
                    names=["id", "text_no", "begin", "end"],
                )


# ---------------------------------------------------------------- the result


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans, digests = [], [], []
        columns = (batch.column(c).to_pylist() for c in ("text", "copy", "begins", "ends"))
        for text, copy, begins, ends in zip(*columns, strict=True):
            raw = text.encode()
            if copy and len(raw) >= LENGTH:
                begins, ends = [0], [len(raw)]
            kept, done, n = [], 0, 0
            for a, b in sorted(zip(begins or [], ends or [], strict=True)):
                if a > done or not n:
                    n += 1
                    kept.append(raw[done:a])
                done = max(done, b)
            kept.append(raw[done:])
            digest = hashlib.sha256()
            size = 0
            for part in kept:
                digest.update(part)
                size += len(part)
            removed.append(len(raw) - size)
            spans.append(n)
            digests.append(digest.hexdigest())
        yield pa.record_batch(
            [batch.column("id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def remove_repeats(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans and kept_sha256 of the bytes that stay."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    number = F.coalesce(F.col(id_column).cast("long"), F.lit(_LAST))
    narrow = docs.select(number.alias("id"), F.xxhash64(text).alias("text_no"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    total = narrow.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (total >> 3).bit_length()))

    repeated = _bit_map(narrow.mapInArrow(_keys, "bucket long, keys binary"), bits, twice=True)
    repeated_shipped = spark.sparkContext.broadcast(repeated)
    records = narrow.mapInArrow(_hashed(repeated_shipped, bits), "key long, strong long, id long, text_no long, begin long, shape int, again boolean")
    of_key, of_kind = Window.partitionBy("key"), Window.partitionBy("key", "strong")
    place = F.row_number().over(of_kind.orderBy("id", "text_no", "begin"))
    kinds = records.withColumn("least", F.min("strong").over(of_key)).withColumn("most", F.max("strong").over(of_key))
    later = F.col("again") | (F.col("place") > 1)
    kinds = kinds.withColumn("place", place).filter(later | (F.col("least") != F.col("most")))
    path = scratch_path(spark, "suffixes")
    end = F.col("begin") + F.shiftright("shape", 8) + F.lit(LENGTH)
    kinds.select("id", "text_no", "begin", end.alias("end"), later.alias("later"), F.when(~later, F.col("key")).alias("key")).write.parquet(path)
    kinds = spark.read.schema("id long, text_no long, begin long, end long, later boolean, key long").parquet(path)

    heads = kinds.filter(~F.col("later")).select("key", "text_no", "begin")
    frequent = heads.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MANY).select("key")
    asked = _bit_map(heads.mapInArrow(_asked_keys, "bucket long, keys binary"), bits, twice=False)
    many = _bit_map(frequent.mapInArrow(_key_rows, "bucket long, keys binary"), bits, twice=False)
    shipped = spark.sparkContext.broadcast((repeated, asked, many))
    sent = narrow.mapInArrow(_bytes(shipped, bits), "key long, id long, text_no long, begin long, offset int, bytes binary")
    sorted_ = sent.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_spans, "id long, text_no long, begin long, end long")

    spans = kinds.filter("later").select("id", "text_no", "begin", "end").union(sorted_)
    if any(many):
        path = scratch_path(spark, "strings")
        fields = "id long, text_no long, begin long, bytes binary"
        narrow.mapInArrow(_strings(shipped, bits), fields).write.parquet(path)
        strings, own = spark.read.schema(fields).parquet(path), F.struct("id", "text_no", "begin")
        earliest = strings.groupBy("bytes").agg(F.min(own).alias("earliest"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        again = strings.join(earliest, "bytes").filter(own > F.col("earliest"))
        spans = spans.union(again.select("id", "text_no", "begin", (F.col("begin") + LENGTH).alias("end")))
    spans = spans.groupBy("id", "text_no").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    first = narrow.groupBy("text_no", "n_bytes").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    own = narrow.select("id", "text_no", "n_bytes").join(first, ["text_no", "n_bytes"]).filter(F.col("id") > F.col("first"))
    marks = own.select("id", "text_no").distinct().withColumn("copy", F.lit(True))
    whole = narrow.join(spans, ["id", "text_no"], "left").join(marks, ["id", "text_no"], "left").dropDuplicates(["id", "text_no"])
    cut_ = whole.select(
        "id", "n_bytes", "text", F.coalesce("copy", F.lit(False)).alias("copy"), F.col("spans.begin").alias("begins"), F.col("spans.end").alias("ends")
    ).mapInArrow(_cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return cut_.select(F.nullif(F.col("id"), F.lit(_LAST)).alias(id_column), "n_bytes", "n_removed", "n_spans", "kept_sha256")
