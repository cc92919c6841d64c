"""Document quality from random-indexing word vectors and a two-layer network.

Words are runs of letters, of digits or of other marks.  Every word has a sparse random index
vector, a function of its hash.  A word's vector is the sum of the index vectors of the words it was
seen next to, in all documents; words share ``ROWS`` rows by hash.  Beside them a row for each shape
sums the index vectors of the words and of the shapes next to words of that shape.  A document is
pooled: the means of its words' and shapes' vectors, and how often two of its places hold the same
word or word pair, by hash.  A network with one hidden layer gives a logit; a temperature fitted on labelled rows that the network
did not see turns it into a probability.

The vectors are summed by tasks, in whole numbers, so that the order does not matter; the driver
receives the one table of fixed size.  The network is fitted on at most ``SAMPLE`` labelled documents
of at most ``SAMPLE_BYTES`` bytes, picked by a hash of their ids, which reach the driver too.  Scoring reads whole texts, a
slice at a time; the model (about 4 MB) is broadcast.

Defined results: null and empty texts are scored as documents without words; ids pass through, null
and repeated ones too, one row per input row; labels that are null, or whose document is missing,
teach nothing; with fewer than two classes to learn from every score is the share of good labels
(0.5 without any); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.llm import wordhash
from promptloom.llm.lean import lean

SAMPLE, SAMPLE_BYTES = 4_000, 65_536
ROWS, SIZE, NONZERO, WINDOW = 1 << 15, 32, 6, 2
HIDDEN, EPOCHS, RATE, DECAY = 24, 400, 0.01, 1e-3
#: Bytes and documents worked on at once, and the bins in which repeated words are counted.
_SLICE, _ROWS_AT_ONCE, _BINS = 500_000, 256, 4_096

_KIND = np.zeros(256, np.uint8)  # 0 blank, 1 letter, 2 digit, 3 other, 4 line break
_KIND[33:127] = 3
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_KIND[10] = 4
_RNG = np.random.default_rng(8)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_SHAPES = 128


def _index_vectors() -> np.ndarray:
    """A few +1 and -1 in each row."""
    rng = np.random.default_rng(21)
    out = np.zeros((ROWS + _SHAPES, SIZE), np.int8)
    places = rng.integers(0, SIZE, (out.shape[0], NONZERO))
    signs = rng.choice(np.array([-1, 1], np.int8), places.shape)
    np.add.at(out, (np.arange(out.shape[0])[:, None], places), signs)
    return out


def _words(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, shape and first byte of each word."""
    kind = _KIND[raw]
    first = kind > 0
    first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 4)
    at = begins[begins < raw.size]
    first[at] = kind[at] > 0
    letters = np.flatnonzero(kind)
    starts = np.flatnonzero(first)
    if not starts.size:
        return np.empty(0, np.uint64), np.empty(0, np.int64), starts
    heads = np.searchsorted(letters, starts)
    sizes = np.diff(np.append(heads, letters.size))
    place = np.arange(letters.size) - np.repeat(heads, sizes)
    powers = np.full(int(sizes.max()), _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    used = raw[letters]
    hashes = wordhash.mix(np.add.reduceat(_BYTE[used] * powers[place], heads))
    capitals = np.add.reduceat(((used >= 65) & (used <= 90)).astype(np.int64), heads)
    case = np.where(capitals == 0, 0, np.where(capitals == sizes, 2, 1))
    length = np.minimum(np.log2(sizes + 0.5).astype(np.int64) + 1, 7)
    return hashes, (kind[starts].astype(np.int64) - 1) * 24 + case * 8 + length, starts


def _texts(texts: pa.StringArray):
    """(first row, words' rows, word rows of the table, shape rows) for runs of documents; a long one comes in parts."""
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + _SLICE, side="right")) - 1
        last = min(max(last, first + 1), first + _ROWS_AT_ONCE, len(texts))
        begin, end = offsets[first], offsets[last]
        if end - begin <= _SLICE:
            hashes, shapes, starts = _words(raw[begin:end], offsets[first:last] - begin)
            yield first, last, np.searchsorted(offsets[first : last + 1] - begin, starts, side="right") - 1, hashes, shapes
        else:
            while begin < end:
                stop = min(begin + _SLICE, end)
                if stop < end:  # back to the last blank, if there is one
                    blanks = np.flatnonzero(_KIND[raw[begin:stop]] == 0)
                    stop = begin + int(blanks[-1]) + 1 if blanks.size else stop
                hashes, shapes, _ = _words(raw[begin:stop], np.zeros(1, np.int64))
                yield first, last, np.zeros(hashes.size, np.int64), hashes, shapes
                begin = stop
        first = last


def _rows(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) % ROWS


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-6)


class Contexts:
    """Sums, for each row, of the index vectors around it."""

    def __init__(self):
        self.index = _index_vectors()
        self.sums = np.zeros(self.index.shape, np.int64)

    def add(self, texts: pa.StringArray) -> None:
        before, tail = -1, 0
        for first, _, owner, hashes, shapes in _texts(texts):
            word = _rows(hashes)
            # a part of a long text has the last words of the part before in front of it
            tail = min(tail, WINDOW) if first == before else 0
            if tail:
                word, shapes = np.concatenate([last_words[-tail:], word]), np.concatenate([last_shapes[-tail:], shapes])
                owner = np.zeros(word.size, np.int64)
            near_words = np.zeros((word.size, SIZE), np.int8)
            near_shapes = np.zeros(_SHAPES * _SHAPES, np.int64)
            for step in range(1, WINDOW + 1):
                left = np.flatnonzero(owner[step:] == owner[:-step])
                left = left[left + step >= tail]
                for target, source in ((left, left + step), (left + step, left)):
                    near_words[target] += self.index[word[source]]
                    near_shapes += np.bincount(shapes[target] * _SHAPES + shapes[source], minlength=near_shapes.size)
            for row in (word, shapes + ROWS):
                order = np.argsort(row, kind="stable")
                heads = np.flatnonzero(np.diff(row[order], prepend=-1))
                if heads.size:
                    self.sums[row[order[heads]]] += np.add.reduceat(near_words[order], heads, axis=0, dtype=np.int64)
            self.sums[ROWS:] += near_shapes.reshape(_SHAPES, _SHAPES) @ self.index[ROWS:].astype(np.int64)
            before, tail, last_words, last_shapes = first, word.size, word, shapes

    def vectors(self) -> np.ndarray:
        """The context vector of each row, scaled to length 1."""
        # a word keeps a share of its own index vector, so that rows never met still differ
        return _unit(self.sums / np.sqrt(NONZERO) + _unit(self.index)).astype(np.float32)


def word_vectors(texts: pa.StringArray) -> np.ndarray:
    """The context vectors of some texts."""
    contexts = Contexts()
    contexts.add(texts)
    return contexts.vectors()


_FIELDS = [f"v{k}" for k in range(SIZE)]


def _partial_sums(batches):
    contexts = Contexts()
    for batch in batches:
        contexts.add(batch.column(0))
    met = np.flatnonzero(contexts.sums.any(axis=1))
    yield pa.record_batch([pa.array(met), *[pa.array(contexts.sums[met, k]) for k in range(SIZE)]], names=["row", *_FIELDS])


def all_vectors(docs: DataFrame, text_column: str) -> np.ndarray:
    """The context vectors of all documents; each task sends the rows it met of one table."""
    texts = docs.select(F.col(text_column).cast("string").alias("text"))
    partial = texts.mapInArrow(lean(_partial_sums, text=0), ", ".join(["row long", *[f"{v} long" for v in _FIELDS]]))
    summed = partial.groupBy("row").agg(*[F.sum(v).alias(v) for v in _FIELDS]).toArrow()  # ROWS + _SHAPES rows at most
    contexts = Contexts()
    contexts.sums[summed.column("row").to_numpy()] = np.stack([summed.column(v).to_numpy() for v in _FIELDS], axis=1)
    return contexts.vectors()


def pooled(texts: pa.StringArray, vectors: np.ndarray) -> np.ndarray:
    """One row of features per document."""
    n = len(texts)
    words, shapes = np.zeros((n, SIZE)), np.zeros((n, _SHAPES))
    ones, twos = np.zeros((n, _BINS), np.float32), np.zeros((n, _BINS), np.float32)
    counts = np.zeros(n)
    for first, last, owner, hashes, shaped in _texts(texts):
        if not hashes.size:
            continue
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        rows, some = owner[starts] + first, last - first
        words[rows] += np.add.reduceat(vectors[_rows(hashes)], starts, axis=0)
        shapes[first:last] += np.bincount(owner * _SHAPES + shaped, minlength=some * _SHAPES).reshape(some, _SHAPES)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs = wordhash.mix(hashes[inside] * np.uint64(3) + hashes[inside + 1])
        for into, whose, values in ((ones, owner, hashes), (twos, owner[inside], pairs)):
            bins = whose * _BINS + (values >> np.uint64(40)).astype(np.int64) % _BINS
            into[first:last] += np.bincount(bins, minlength=some * _BINS).reshape(some, _BINS)
        counts[rows] += np.diff(np.append(starts, owner.size))
    each = np.maximum(counts, 1)[:, None]
    words, shapes = words / each, shapes @ vectors[ROWS:] / each
    same = [((v / each) ** 2).sum(axis=1, keepdims=True) for v in (ones, twos)]
    close = [(v * v).sum(axis=1, keepdims=True) for v in (words, shapes)] + same
    extra = [np.log(c + 0.002) for c in close] + [np.log1p(counts)[:, None], 1 / each]
    return np.hstack([words, shapes, *close, *extra])


def features(texts: pa.StringArray, vectors: np.ndarray) -> np.ndarray:
    """``pooled`` a few documents at a time."""
    parts = [pooled(texts.slice(k, _ROWS_AT_ONCE), vectors) for k in range(0, len(texts), _ROWS_AT_ONCE)]
    return np.vstack(parts) if parts else np.empty((0, 2 * SIZE + 10))


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray | None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    layers: tuple | None = None
    temperature: float = 1.0
    prior: float = 0.5

    def logits(self, rows: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        x = np.clip((rows - self.mean) / self.spread, -8, 8)
        return np.tanh(x @ w1 + b1) @ w2 + b2

    def scores(self, texts: pa.StringArray) -> np.ndarray:
        if self.vectors is None:
            return np.full(len(texts), self.prior)
        return _sigmoid(self.logits(features(texts, self.vectors)) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _network(x: np.ndarray, y: np.ndarray) -> tuple:
    """Adam on the cross-entropy, all rows at a time."""
    rng = np.random.default_rng(3)
    p = [
        rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN),
        rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1),
    ]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for t in range(1, EPOCHS + 1):
        h = np.tanh(x @ p[0] + p[1])
        error = (_sigmoid(h @ p[2] + p[3]) - y) / y.size
        back = np.outer(error, p[2]) * (1 - h * h)
        grads = [x.T @ back + DECAY * p[0], back.sum(axis=0), h.T @ error + DECAY * p[2], np.array([error.sum()])]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return tuple(p)


def train(texts: list[str], labels: np.ndarray, vectors: np.ndarray) -> Model:
    """Every fifth row fits the temperature, the others the network."""
    x = features(pa.array(texts, pa.string()), vectors)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    scaled = np.clip((x - mean) / spread, -8, 8)
    aside = np.arange(labels.size) % 5 == 4
    w1, b1, w2, b2 = layers = _network(scaled[~aside], labels[~aside])
    logits = np.tanh(scaled[aside] @ w1 + b1) @ w2 + b2
    grid = np.geomspace(0.25, 16, 61)
    truth = labels[aside]
    # each class keeps the doubt that its number of rows leaves, so that rows told apart without a
    # mistake do not end in certainty
    good = truth.sum()
    wanted = np.where(truth == 1, (good + 1) / (good + 2), 1 / (truth.size - good + 2))
    loss = [-(wanted * np.log(_sigmoid(logits / t)) + (1 - wanted) * np.log(_sigmoid(-logits / t))).mean() for t in grid]
    return Model(vectors, mean, spread, layers, float(grid[int(np.argmin(loss))]))


def held_out(id_: Column) -> Column:
    """Rows that teach nothing; null ids are among them."""
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, *, id_column: str, text_column: str, label_column: str, sample: int = SAMPLE) -> Model:
    chosen = (
        labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("double").alias("label"))
        .filter(F.col("label").isin(0.0, 1.0) & ~held_out(F.col("id")))
        .distinct()
        .orderBy(F.xxhash64("id"), "id", "label")
        .limit(sample)
    )
    text = F.col(text_column).cast("string")
    known = docs.select(F.col(id_column).alias("id"), text.alias("text")).filter(F.octet_length(text) <= SAMPLE_BYTES)
    rows = known.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "id", "label", F.xxhash64("text")).limit(sample).collect()
    truth = np.array([r.label for r in rows])
    if truth.size < 10 or np.unique(truth).size < 2:
        return Model(None, prior=float(truth.mean()) if truth.size else 0.5)
    return train([r.text for r in rows], truth, all_vectors(docs, text_column))


def _scoring(shipped):
    def run(batches):
        model = shipped.value
        for batch in batches:
            ids, texts = batch.columns
            yield pa.record_batch([ids, pa.array(model.scores(texts), pa.float64())], names=["id", "score"])

    return run


def score(
    docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
    good_from: float = 0.7, sample: int = SAMPLE,
) -> DataFrame:
    """One row per input row: id, held_out, score, predicted."""
    model = fit(docs, labels, id_column=id_column, text_column=text_column, label_column=label_column, sample=sample)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    scored = narrow.mapInArrow(lean(_scoring(shipped), text=1), f"id {narrow.schema['id'].dataType.simpleString()}, score double")
    return scored.select(
        F.col("id").alias(id_column), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= good_from).cast("int").alias("predicted")
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
    good_from: float = 0.7, sample: int = SAMPLE,
) -> DataFrame:
    """The rows and columns of ``docs`` that score ``good_from`` or more."""
    model = fit(docs, labels, id_column=id_column, text_column=text_column, label_column=label_column, sample=sample)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_column)

    def run(batches):
        model = shipped.value
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(place).cast(pa.string())) >= good_from))

    return docs.mapInArrow(lean(run, text=place), docs.schema)
