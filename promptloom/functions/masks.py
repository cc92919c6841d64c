"""Token-array expressions: fitting to a length, attention masks and label masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the label a loss function skips.
IGNORE = -100


def _array(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def kept_length(ids, n, truncate: bool = True) -> Column:
    """How many genuine tokens ``fit`` keeps."""
    size = F.size(_array(ids))
    return F.least(size, F.lit(n) if isinstance(n, int) else n) if truncate else size


def fit(ids, n, pad: int, truncate: bool = True) -> Column:
    """Right-padded to ``n`` tokens and, unless told otherwise, cut to it."""
    ids = _array(ids)
    n = F.lit(n) if isinstance(n, int) else n
    kept = F.slice(ids, F.lit(1), n) if truncate else ids
    return F.concat(kept, F.array_repeat(F.lit(pad), F.greatest(n - F.size(ids), F.lit(0))))


def attention(ids, n, truncate: bool = True) -> Column:
    """1 for each genuine token of ``fit``, 0 for each padding."""
    length = kept_length(ids, n, truncate)
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(
        F.array_repeat(F.lit(1), length),
        F.array_repeat(F.lit(0), F.greatest(n - length, F.lit(0))),
    )


def mask_pad(ids, pad: int, mode: str = "token", mask=None) -> Column:
    """Labels that skip padding.

    ``token`` skips every id equal to ``pad``, a genuine end token of the same id included;
    ``attention`` skips what the attention ``mask`` names and keeps such a token.
    """
    if mode == "token":
        return F.transform(ids, lambda x: F.when(x == pad, F.lit(IGNORE)).otherwise(x))
    if mode != "attention" or mask is None:
        raise ValueError("mode is 'token', or 'attention' with a mask")
    return F.zip_with(ids, mask, lambda x, m: F.when(m == 0, F.lit(IGNORE)).otherwise(x))


def mask_completion(ids, marker: list[int], occurrence: str = "last") -> Column:
    """Labels that skip everything up to and including a response marker.

    Without a marker the whole row is skipped.
    """
    if occurrence not in ("first", "last"):
        raise ValueError("occurrence is 'first' or 'last'")
    ids = _array(ids)

    def found(i: Column) -> Column:
        hits = [F.get(ids, i + j) == token for j, token in enumerate(marker)]
        return reduce(lambda a, b: a & b, hits)

    starts = F.transform(ids, lambda x, i: F.when(found(i), i))
    start = F.array_max(starts) if occurrence == "last" else F.array_min(starts)
    skipped = F.coalesce((start + len(marker)).cast("int"), F.size(ids))
    # put together from two arrays: a lambda would search for the marker again at every position
    return F.concat(
        F.array_repeat(F.lit(IGNORE), skipped), F.slice(ids, skipped + 1, F.size(ids))
    )


def mask_flagged(ids, flags) -> Column:
    """Labels that keep the tokens whose flag is 1."""
    return F.zip_with(ids, flags, lambda x, f: F.when(f == 1, x).otherwise(F.lit(IGNORE)))


def supervised(labels) -> Column:
    """How many labels count in the loss."""
    return F.size(F.filter(labels, lambda x: x != IGNORE))


def strip_prefix(ids, prompt) -> Column:
    """Generated ids without the prompt's ids before them."""
    ids, skip = _array(ids), F.size(_array(prompt))
    return F.slice(ids, skip + 1, F.greatest(F.size(ids) - skip, F.lit(0)))


def token_counts(predicted, labels, shift: int = 0) -> Column:
    """``struct(correct, valid)`` of one row's arrays.

    With ``shift=1`` position i predicts label i+1, with 0 the label at the same place.
    """
    predicted, labels = _array(predicted), _array(labels)
    hits = F.transform(
        predicted,
        lambda p, i: F.struct(p.alias("p"), F.get(labels, i + shift).alias("l")),
    )
    valid = F.filter(hits, lambda h: h.l.isNotNull() & (h.l != IGNORE))
    return F.struct(
        F.size(F.filter(valid, lambda h: h.p == h.l)).cast("bigint").alias("correct"),
        F.size(valid).cast("bigint").alias("valid"),
    )


def joined(ids) -> Column:
    """An id array as text."""
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")
