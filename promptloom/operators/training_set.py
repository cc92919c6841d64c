"""The whole way from chat texts to training rows, as one composition of the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.functions import masks as M
from promptloom.functions import templates as P
from promptloom.operators import vocabulary as V
from promptloom.operators.batches import length_groups
from promptloom.operators.frames import drop_null
from promptloom.operators.order import split_exact
from promptloom.session import cut


@dataclass(frozen=True)
class Settings:
    """What a run declares about its data."""

    key: tuple[str, ...]
    test_share: float = 0.2
    seed: int = 42
    cutoff: int = 1028
    batch: int = 2
    vocabulary: int | None = None


def training_set(corpus: DataFrame, settings: Settings) -> DataFrame:
    """``key, split, ids, labels, megabatch, pos`` from ``system, user, assistant`` texts.

    Rows with a missing text go first, so the split is exact over what remains.  The vocabulary is
    fitted on the train part only, and each part is grouped into batches by itself.
    The split corpus is stored once, since the vocabulary, the lengths and the ids all need it.
    Batches are formed from keys and lengths alone; ids are looked up for the tokens that stay, and
    joined to them in the end.
    """
    key = list(settings.key)
    clean = drop_null(corpus, ["system", "user", "assistant"]).select(*key, "system", "user", "assistant")
    parts = cut(split_exact(clean, key, settings.test_share, settings.seed))
    toks = P.chatml_tokens(P.messages3("system", "user", "assistant"))
    train = parts.filter(F.col("split") == "train").select(toks.alias("_t"))
    vocab = V.build_vocab(train, F.col("_t.token"), settings.vocabulary)
    sized = parts.select(
        *key, "split", F.least(F.size(toks), F.lit(settings.cutoff)).cast("bigint").alias("n_tokens")
    )
    grouped = length_groups(sized, key, "n_tokens", settings.batch, settings.seed, within="split")
    rows = parts.select(*key, F.slice(toks, 1, settings.cutoff).alias("_t"))
    coded = V.encode(rows, key, F.col("_t.token"), vocab, tags=F.col("_t.learnt"))
    labelled = coded.select(*key, "ids", M.mask_flagged("ids", "tags").alias("labels"))
    return labelled.join(grouped, key)
