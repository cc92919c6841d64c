"""Paths of a growing corpus: each batch of files may bring new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.session import scratch_path


def new_paths_stream(stream: DataFrame, paths: Column, target: str | None = None) -> DataFrame:
    """``path, arrival``: every path once, with the number of the batch that brought it first.

    The paths seen so far are the stream's keyed state; a restart with the same ``target`` goes on with them.  A batch
    that is run again overwrites what it wrote.  Null paths are left out.
    """
    spark = stream.sparkSession
    target = target or scratch_path(spark, "paths")
    first = stream.select(F.explode(paths).alias("path")).filter(F.col("path").isNotNull()).dropDuplicates(["path"])

    def save(fresh: DataFrame, batch: int) -> None:
        fresh.write.mode("overwrite").parquet(f"{target}/data/arrival={batch}")

    query = (
        first.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", f"{target}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("arrival", T.LongType())])
    return spark.read.schema(schema).parquet(f"{target}/data")
