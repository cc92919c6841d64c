"""Near-duplicate documents by min-max hashing.

A document is the set of its distinct word shingles.  Under each of ``PERMUTATIONS`` hash functions
both the minimum and the maximum are kept, two values of the signature for one evaluation.  Bands
of four values deal documents into buckets.  A pair at the threshold of 0.8 misses all 32 bands
once in 20 million.

Linked documents are found in three steps, none of which makes pairs inside a group:

1. Documents with the same set count as one node (its digest), so exact copies cost one row each.
2. In each bucket, nodes whose signatures agree to ``CUT`` at least are chained, and each chain's nodes
   are tied to its smallest one, with no more ties than nodes.  For a linked pair the agreement falls
   below ``CUT`` with a chance of about one in ten million.  The components of the ties are small clusters.
3. Each cluster gets its members' whole texts once, counts all intersections of their full sets as
   a matrix product, and links those of ``100 * intersection >= 80 * union``.

Buckets and clusters above a fixed size are dealt out as pairs of blocks, so a task's memory is
bounded while every two members still meet.

Defined results: a text without words, empty or null has an empty set and is its own component; a
null id is never the smallest id where there is another, and a component without any id has the
id null; rows are returned one by one, repeated ones too; ``kept`` marks the rows of the smallest
id, and of those with the smallest text key if the id is repeated with different texts; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm import wordhash
from promptloom.llm.components import components
from promptloom.llm.lean import lean
from promptloom.session import cut

PERMUTATIONS, BAND = 64, 4
BANDS = 2 * PERMUTATIONS // BAND
#: Agreeing values of the 128 from which on nodes are chained.
CUT = 80
#: Nodes of a block of a bucket; nodes and shingles of a block of a cluster.
BUCKET_BLOCK, CLUSTER_BLOCK, CLUSTER_SHINGLES = 2_048, 512, 4_000_000

_RNG = np.random.default_rng(11)
_FLIP = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_TURN = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = _RNG.integers(0, 2**63, (BANDS, BAND), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(found: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per set, the minimum and maximum under each permutation, side by side."""
    out = np.empty((starts.size, 2 * PERMUTATIONS), np.uint64)
    for j in range(PERMUTATIONS):
        turned = (found ^ _FLIP[j]) * _TURN[j]
        out[:, 2 * j] = np.minimum.reduceat(turned, starts)
        out[:, 2 * j + 1] = np.maximum.reduceat(turned, starts)
    return out


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = batch.columns
            for first, last, hashes, rows in wordhash.slices(texts):
                n = last - first
                found, owner = wordhash.shingles(hashes, rows, n, width)
                counts = np.bincount(owner, minlength=n)
                has = np.flatnonzero(counts)
                nodes: list = [None] * n
                small: list = [None] * n
                bands: list = [None] * n
                if has.size:
                    starts = (np.cumsum(counts) - counts)[has]
                    signed = signatures(found, starts)
                    banded = signed.reshape(has.size, BANDS, BAND)
                    banded = wordhash.mix((banded * _SEEDS).sum(axis=2, dtype=np.uint64)).view(np.int64)
                    short = (signed >> np.uint64(24)).astype(np.uint8)
                    for k, (row, start) in enumerate(zip(has, starts, strict=True)):
                        nodes[row] = hashlib.blake2b(found[start : start + counts[row]].tobytes(), digest_size=16).digest()
                        small[row] = short[k].tobytes()
                        bands[row] = banded[k]
                yield pa.record_batch(
                    [
                        ids.slice(first, n), keys.slice(first, n), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()),
                        pa.array(small, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["id", "text_key", "n_shingles", "node", "signature", "bands"],
                )

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups, from rows sorted by ``key``."""
    kept: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        kept = table if kept is None else pa.concat_tables([kept, table]).combine_chunks()
        keys = kept.column(key).to_numpy()
        if not keys.size:
            continue
        border = int(np.searchsorted(keys, keys[-1], side="left"))
        if border:
            yield kept.slice(0, border)
            kept = kept.slice(border)
    if kept is not None and kept.num_rows:
        yield kept


def _spans(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _star(group: list, a: list, b: list) -> None:
    """Adds an edge from each other node of a group to its smallest one, as `components` leaves them, which saves it rounds."""
    least = min(group)
    others = [node for node in group if node != least]
    a.extend(others)
    b.extend([least] * len(others))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains the nodes of each bucket whose signatures agree well enough."""
    for table in whole_groups(batches, "cell"):
        spans = _spans(table.column("cell").to_numpy())
        nodes = table.column("node").to_pylist()
        signed = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(nodes), -1)
        sizes = np.diff(spans)
        heads = np.repeat(spans[:-1], sizes)
        near = (signed == signed[heads]).sum(axis=1) >= CUT
        a, b = [], []
        for begin, size in zip(spans[:-1], sizes, strict=True):
            rest = np.flatnonzero(~near[begin : begin + size]) + begin
            todo = [int(i) for i in np.flatnonzero(near[begin : begin + size])[1:] + begin]
            group = [int(begin), *todo]
            while rest.size:
                if not todo:
                    _star([nodes[i] for i in group], a, b)
                    todo, rest = [int(rest[0])], rest[1:]
                    group = [todo[0]]
                    continue
                one = todo.pop()
                joined = (signed[rest] == signed[one]).sum(axis=1) >= CUT
                if joined.any():
                    fresh = [int(i) for i in rest[joined]]
                    group.extend(fresh)
                    todo.extend(fresh)
                    rest = rest[~joined]
            _star([nodes[i] for i in group], a, b)
        if a:
            yield _edges(a, b)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles every two of the sets share: a product of incidence matrices, some columns at a time."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [s.size for s in sets])
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    place = np.cumsum(shared) - 1
    use = shared[column]
    owner, column = owner[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float32)
    width = max(64, 4_000_000 // n)
    for begin in range(0, int(shared.sum()), width):
        low, high = np.searchsorted(column, [begin, begin + width])
        part = np.zeros((n, width), np.float32)
        part[owner[low:high], column[low:high] - begin] = 1
        out += part @ part.T
    return out


def _link(width: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell"):
            table = table.combine_chunks()
            spans = _spans(table.column("cell").to_numpy())
            nodes = table.column("node").to_pylist()
            texts = table.column("text").chunk(0) if table.column("text").num_chunks else pa.array([], pa.string())
            a, b = [], []
            for begin, end in zip(spans[:-1], spans[1:], strict=True):
                sets = []
                for first, last, hashes, rows in wordhash.slices(texts.slice(begin, end - begin)):
                    found, owner = wordhash.shingles(hashes, rows, last - first, width)
                    sets += np.split(found, np.cumsum(np.bincount(owner, minlength=last - first))[:-1])
                sizes = np.array([s.size for s in sets], np.float64)
                common = intersections(sets)
                linked = 100 * common >= threshold * (sizes[:, None] + sizes - common)
                rest = np.arange(1, len(sets))
                todo, group = [0], [0]
                while rest.size:
                    if not todo:
                        _star([nodes[begin + i] for i in group], a, b)
                        todo, rest = [int(rest[0])], rest[1:]
                        group = [todo[0]]
                        continue
                    one = todo.pop()
                    joined = linked[one, rest]
                    if joined.any():
                        fresh = [int(i) for i in rest[joined]]
                        group.extend(fresh)
                        todo.extend(fresh)
                        rest = rest[~joined]
                _star([nodes[begin + i] for i in group], a, b)
            if a:
                yield _edges(a, b)

    return run


def _cells(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Adds ``cell``: a row meets every other row of its group in some cell, in groups of more than one block too."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", own).withColumn("other", other)
    cell = F.xxhash64(F.col(key), F.least("own", "other"), F.greatest("own", "other"))
    return dealt.withColumn("cell", cell).drop("blocks", "own", "other")


def text_key(text: Column) -> Column:
    """Tells texts apart; equal for equal texts."""
    return F.concat_ws(":", F.xxhash64(text), F.hash(text), F.octet_length(text))


def near_duplicates(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = 4, threshold: int = 80
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept, text_key."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_column).alias("id"), text_key(text).alias("text_key"), text.alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    signed = cut(
        narrow.mapInArrow(
            lean(_sign(width), text=2), f"id {kind}, text_key string, n_shingles long, node binary, signature binary, bands array<bigint>"
        )
    )
    own = F.struct(F.col("id").isNull().alias("lacks_id"), F.col("id").alias("id"), F.col("text_key").alias("text_key"))
    nodes = signed.filter(F.col("node").isNotNull()).groupBy("node")
    nodes = cut(
        nodes.agg(
            F.min(own).alias("smallest"), F.first("text_key").alias("text_key"), F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"), F.first("bands").alias("bands"),
        )
    )
    bucket = nodes.select("node", F.explode("bands").alias("band")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("band")))
    shared = bucket.filter(F.col("n") > 1).join(nodes.select("node", "signature"), "node")
    met = _cells(shared, "band", F.ceil(F.col("n") / BUCKET_BLOCK)).select("cell", "node", "signature")
    chained = met.repartition("cell").sortWithinPartitions("cell").mapInArrow(lean(_chain), "a binary, b binary")
    clusters = cut(components(chained))

    linked = clusters.join(nodes.select("node", "text_key", "n_shingles"), "node")
    size = linked.groupBy("root").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / CLUSTER_BLOCK), F.ceil(F.sum("n_shingles") / CLUSTER_SHINGLES)).alias("n_blocks")
    )
    linked = linked.join(size, "root")
    once = narrow.groupBy("text_key").agg(F.first("text").alias("text"))  # exact copies meet before the shuffle
    met = _cells(linked.join(once, "text_key"), "root", F.col("n_blocks")).select("cell", "node", "text")
    links = met.repartition("cell").sortWithinPartitions("cell").mapInArrow(lean(_link(width, threshold)), "a binary, b binary")
    grouped = components(links)

    whole = nodes.join(grouped, "node", "left").withColumn("root", F.coalesce("root", "node")).select("node", "root", "smallest")
    first = whole.groupBy("root").agg(F.min("smallest").alias("first"))
    found = whole.join(first, "root").select("node", "first")
    rows = signed.select("id", "n_shingles", "text_key", "node").join(found, "node", "left")
    alone = F.col("node").isNull()
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_key") == F.col("first.text_key"))
    return rows.select(
        F.col("id").alias(id_column),
        "n_shingles",
        F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("component_id"),
        (alone | F.coalesce(same, F.lit(False))).alias("kept"),
        "text_key",
    )


def deduplicate(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = 4, threshold: int = 80
) -> DataFrame:
    """The rows and columns of ``docs`` without near-duplicates: one row of each component stays."""
    marked = near_duplicates(docs, id_column=id_column, text_column=text_column, width=width, threshold=threshold)
    kept = marked.filter("kept").select(F.col(id_column).alias("__id"), F.col("text_key").alias("__key")).distinct()
    key = text_key(F.coalesce(F.col(text_column).cast("string"), F.lit("")))
    keyed = docs.withColumn("__own_key", key)
    joined = keyed.join(kept, keyed[id_column].eqNullSafe(kept["__id"]) & (keyed["__own_key"] == kept["__key"]))
    return joined.dropDuplicates([id_column, "__own_key"]).select(*[F.col(f"`{c}`") for c in docs.columns])
