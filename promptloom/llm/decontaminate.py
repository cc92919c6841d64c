"""Benchmark passages in documents, by SimHash over item-sized windows.

A document is compared with an item of ``L`` words through all its windows of ``L`` words; a shorter
document is one window of its own.  A window at the threshold has a certain number of places whose
shingles are the item's, so every window that holds so many is looked at, and no other; this loses
nothing that can reach the threshold.  Windows of equal words count once, however many documents
hold them.

Every window and every item has a 64-bit SimHash of its weighted shingles (weight: how often the
shingle occurs).  Fingerprints are cut into ``RADIUS + 1`` blocks; two that differ in at most
``RADIUS`` bits agree in one block at least, so a join on blocks finds all of them.  A pair at the
threshold of 0.8 differs in 10 bits on average, and in more than ``RADIUS`` about once in 10^5.
Candidates are verified by the exact weighted similarity: the sum of the smaller weights over the
sum of the larger ones.

Everything is DataFrame functions.  The items' shingles are broadcast as long as their counted rows
are few, and joined by a shuffle beyond.

Defined results: null and empty texts, and items without words, match nothing; shingles have five
words, or all of an item's words if it has fewer; rows with equal id and text count once; null ids
are kept as null; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.words import each_place, gram, small, words
from promptloom.session import cut

WIDTH, THRESHOLD = 5, 80
BITS, RADIUS = 64, 23

_BLOCKS = RADIUS + 1
#: First bit and bits of each block.
_SPANS = [(BITS * k // _BLOCKS, BITS * (k + 1) // _BLOCKS - BITS * k // _BLOCKS) for k in range(_BLOCKS)]


def _grams(rows: DataFrame, keep: list[str], widths: list[int]) -> DataFrame:
    """(keep..., at, h) for every place of ``words``; a row's ``width`` says how long its shingles are."""
    parts = []
    for width in widths:
        placed = rows.filter(F.col("width") == width).withColumn("at", each_place(F.size("words") - (width - 1)))
        parts.append(placed.select(*keep, "at", gram("words", "at", width).alias("h")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def simhash(shingles: DataFrame, key: list[str]) -> DataFrame:
    """key and ``print``: bit b is set where shingles with it outweigh those without."""
    votes = [
        F.sum(F.when(F.getbit("h", F.lit(b)) == 1, F.col("weight")).otherwise(-F.col("weight"))).alias(f"v{b}") for b in range(BITS)
    ]
    bit = lambda b: F.when(F.col(f"v{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long")
    print_: Column = bit(0)
    for b in range(1, BITS):
        print_ = print_.bitwiseOR(bit(b))
    return shingles.groupBy(*key).agg(*votes).select(*key, print_.alias("print"))


def _block_rows(prints: DataFrame) -> DataFrame:
    blocks = [
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("print", low).bitwiseAND(F.lit((1 << bits) - 1)).alias("value"))
        for k, (low, bits) in enumerate(_SPANS)
    ]
    return prints.withColumn("b", F.explode(F.array(*blocks))).select(*prints.columns, "b.block", "b.value")


def _text_no(text_column: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_column).cast("string"), F.lit("")))


def _matches(
    docs: DataFrame, items: DataFrame, id_column: str, text_column: str, item_column: str, item_text_column: str, width: int, threshold: int
) -> DataFrame:
    """(id, text_no, item, best) of each text and item with a window at the threshold."""
    items = items.select(F.col(item_column).alias("item"), words(F.col(item_text_column)).alias("words"))
    items = items.filter(F.size("words") > 0).distinct().withColumn("n_words", F.size("words"))
    items = cut(items.withColumn("width", F.least(F.col("n_words"), F.lit(width))).withColumn("item_no", F.xxhash64("item", "words")))
    widths = sorted(r[0] for r in items.select("width").distinct().collect()) or [width]  # at most `width` numbers
    item_places = cut(_grams(items, ["item_no", "n_words", "width"], widths))
    item_grams = item_places.groupBy("item_no", "n_words", "width", "h").agg(F.count(F.lit(1)).alias("weight"))
    n_places, n_items = item_places.count(), items.count()

    rows = docs.select(F.col(id_column).alias("id"), _text_no(text_column).alias("text_no"), words(F.col(text_column)).alias("words"))
    item_of = small(item_grams.drop("weight"), n_places)
    size = F.least(F.col("n_text"), F.col("n_words"))
    start = F.greatest(F.col("at") - size + F.col("width"), F.lit(0))  # of the first window with this place
    found = []
    for w in widths:
        placed = rows.withColumn("at", each_place(F.size("words") - (w - 1))).withColumn("h", gram("words", "at", w))
        hit = placed.join(item_of.filter(F.col("width") == w), "h").withColumn("n_text", F.size("words"))
        around = F.concat_ws(" ", F.slice("words", start + 1, F.col("at") + size - start))
        found.append(hit.select("id", "text_no", "item_no", "n_words", "width", "n_text", "at", around.alias("around")))
    hits = found[0]
    for part in found[1:]:
        hits = hits.union(part)
    hits = hits.groupBy("id", "text_no", "item_no", "n_words", "width", "n_text", "at").agg(F.first("around").alias("around"))
    pair = Window.partitionBy("id", "text_no", "item_no")
    needed = F.ceil((F.col("n_words") - F.col("width") + 1) * threshold / 100)
    hits = hits.withColumn("held", F.count(F.lit(1)).over(pair)).withColumn("before", F.lag("at", 1, -1).over(pair.orderBy("at")))
    hits = cut(hits.withColumn("nth", F.row_number().over(pair.orderBy("at"))).filter(F.col("held") >= needed).drop("held"))
    ends = hits.select(
        F.col("id").alias("id_"), F.col("text_no").alias("text_no_"), F.col("item_no").alias("item_no_"), (F.col("nth") - needed + 1).alias("nth_"), F.col("at").alias("last")
    )
    together = F.col("id").eqNullSafe(F.col("id_")) & (F.col("text_no") == F.col("text_no_")) & (F.col("item_no") == F.col("item_no_"))
    runs = hits.join(ends, together & (F.col("nth") == F.col("nth_")))
    # windows whose first such place is this one, and which reach to the last one needed
    low = F.greatest(F.col("last") - size + F.col("width"), F.col("before") + 1, F.lit(0))
    high = F.least(F.col("at"), F.col("n_text") - size)
    runs = runs.withColumn("begin", F.explode(F.when(low <= high, F.sequence(low, high))))
    window = F.concat_ws(" ", F.slice(F.split("around", " "), F.col("begin") - start + 1, size))
    windows = cut(runs.select("id", "text_no", "n_words", "width", "begin", window.alias("window")).distinct())

    texts = windows.select("n_words", "width", "window").distinct().withColumn("words", F.split("window", " "))
    grams = _grams(texts, ["n_words", "width", "window"], widths).groupBy("n_words", "width", "window", "h")
    grams = cut(grams.agg(F.count(F.lit(1)).alias("weight")))
    prints = _block_rows(simhash(grams, ["n_words", "window"]))
    item_prints = _block_rows(simhash(item_grams, ["n_words", "item_no"])).withColumnRenamed("print", "item_print")
    candidates = (
        prints.join(small(item_prints, n_items * _BLOCKS), ["n_words", "block", "value"])
        .filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
        .select("n_words", "window", "item_no")
        .distinct()
    )
    shared = (
        candidates.join(grams, ["n_words", "window"])
        .join(small(item_grams.select("item_no", "h", F.col("weight").alias("item_weight")), n_places), ["item_no", "h"])
        .groupBy("n_words", "width", "window", "item_no")
        .agg(F.sum(F.least("weight", "item_weight")).alias("common"))
    )
    whole = F.size(F.split("window", " ")) + F.col("n_words") - 2 * F.col("width") + 2 - F.col("common")
    similar = shared.filter(F.col("common") * 100 >= whole * threshold).select(
        "n_words", "window", "item_no", (F.col("common") / whole).alias("similarity")
    )
    named = items.select("item_no", "item")
    best = F.max_by(F.struct("begin", F.size(F.split("window", " ")).alias("n_words"), "similarity"), F.struct("similarity", -F.col("begin")))
    return (
        windows.join(similar, ["n_words", "window"])
        .join(small(named, n_places), "item_no")
        .groupBy("id", "text_no", "item")
        .agg(best.alias("best"))
    )


def contaminated(
    docs: DataFrame, items: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", width: int = WIDTH, threshold: int = THRESHOLD,
) -> DataFrame:
    """Id, item, first_word, n_words and similarity of each document and item with a window at the threshold.

    The window is the most similar one, the first of equals; ``n_words`` are its own.
    """
    found = _matches(docs, items, id_column, text_column, item_column, item_text_column, width, threshold)
    return found.select(
        F.col("id").alias(id_column), F.col("item").alias(item_column), F.col("best.begin").alias("first_word"), "best.n_words", "best.similarity"
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", width: int = WIDTH, threshold: int = THRESHOLD,
) -> DataFrame:
    """The rows and columns of ``docs`` in which no benchmark item is found."""
    found = _matches(docs, items, id_column, text_column, item_column, item_text_column, width, threshold)
    found = cut(found.select(F.col("id").alias("__id"), F.col("text_no").alias("__no")).distinct())
    keyed = docs.withColumn("__own_no", _text_no(text_column))
    same = keyed[id_column].eqNullSafe(F.col("__id")) & (F.col("__own_no") == F.col("__no"))
    return keyed.join(small(found, found.count()), same, "left_anti").drop("__own_no")
