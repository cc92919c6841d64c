"""Batch scoring: prompts through a user's function, the result as a column."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from promptloom.operators.order import as_list, skew_join
from promptloom.session import cut

#: The log of a resumable run: what was generated for the prompt with this digest.
LOG = "digest string, generated string"
#: Prompts whose results are committed together; what a broken run loses at most.
SLICE = 50_000


def score(
    df: DataFrame, make: Callable[[], Callable[[pd.Series], pd.Series]], prompt: str, out: str
) -> DataFrame:
    """Adds ``out``, the text generated for each prompt.

    ``make`` runs once per partition, where a model or a client is costly to set up; what it returns
    gets the prompts of one Arrow batch at a time.  No other column leaves the JVM.
    """

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        generate = make()
        for prompts in batches:
            yield generate(prompts)

    return df.withColumn(out, run(F.col(prompt)))


def _digest(prompt: str):
    return F.sha2(F.coalesce(F.col(prompt), F.lit("")), 256)


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """``digest, generated`` of a run's log, empty before its first result."""
    place = spark._jvm.org.apache.hadoop.fs.Path(log)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(log)


def score_resumable(
    df: DataFrame, make: Callable[[], Callable[[pd.Series], pd.Series]], prompt: str, out: str, log: str, row_id,
    per_slice: int = SLICE,
) -> DataFrame:
    """``score``, with every result kept in ``log`` as soon as its slice of the prompts is done.

    Equal prompts are generated once, a null one like an empty one.  Prompts are dealt to slices of about ``per_slice`` by
    their digests; each slice is a job that appends to the log.  A lost executor costs the tasks it ran; a run that breaks
    costs the slice it was in, and the next one with the same log goes on with the prompts the log lacks, whichever rows
    they come from.  One log belongs to one model, and one run at a time.  ``row_id`` names columns that tell rows with a
    frequent prompt apart.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_digest", _digest(prompt))
    prompts = keyed.groupBy(F.col("_digest").alias("digest")).agg(F.first(F.coalesce(F.col(prompt), F.lit(""))).alias("_prompt"))
    waiting = cut(prompts.join(read_log(spark, log).select("digest"), "digest", "left_anti"))
    slices = math.ceil(waiting.count() / per_slice)
    place = F.pmod(F.xxhash64("digest"), F.lit(slices))
    for number in range(slices):
        answered = score(waiting.filter(place == number), make, "_prompt", "generated")
        answered.select("digest", "generated").write.mode("append").parquet(log)
    results = read_log(spark, log).groupBy(F.col("digest").alias("_digest")).agg(F.first("generated").alias(out))
    return skew_join(keyed, results, ["_digest"], as_list(row_id)).drop("_digest")


def echo_model() -> Callable[[pd.Series], pd.Series]:
    """A deterministic stand-in for a model: it thinks of the prompt's first line and answers with the
    prompt's lines in reverse."""

    def answer(prompt: str) -> str:
        lines = prompt.split("\n")
        return f"<think>\n{lines[0]}\n</think>\n\n" + "\n".join(reversed(lines)) + "\n"

    return lambda prompts: prompts.map(answer)
