"""The step log as a stream: tumbling windows with a watermark, and the same in batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.session import scratch_path

LATENESS = "1 hour"
WIDTH = "1 hour"
_STAMP = "yyyy-MM-dd HH:mm:ss"


def _aggregates(value: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")]


def _windows(ts: str, by: str, width: str) -> list[Column]:
    return [F.window(ts, width), F.col(by)]


def _named(df: DataFrame, by: str) -> DataFrame:
    return df.select(
        F.date_format("window.start", _STAMP).alias("window_start"), by, "n",
        F.round(F.col("total") / F.col("n"), 6).alias("mean_value"),
    )


def step_log_windows(
    df: DataFrame, ts: str, by: str, value: str, width: str = WIDTH
) -> DataFrame:
    """Count and mean per window and ``by``."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return _named(timed.groupBy(*_windows(ts, by, width)).agg(*_aggregates(value)), by)


def read_log_stream(
    spark: SparkSession, folder: str, pattern: str, schema: T.StructType,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Parquet files of a folder, in the order they arrived."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def step_log_stream(
    stream: DataFrame, ts: str, by: str, value: str, width: str = WIDTH, lateness: str = LATENESS,
    target: str | None = None, step: list[str] | None = None,
) -> DataFrame:
    """Runs over all that has arrived and returns the windows as of now.

    Rows later than the watermark are dropped and closed windows leave the state.  Each
    micro-batch writes the windows it changed to a directory of its own number and overwrites it when
    the batch is run again, so a restart neither loses nor doubles a window.  What the batches wrote is
    merged into one table when they are done, so a run reads that table and its own batches only.  What is
    returned reads that table too, and holds until the next run.

    ``step`` names the columns that tell a step, such as run, rank and step number.  A run that was resumed logs the steps
    since its last saved state again; of the rows of one step the first that arrives counts, as long as the next
    comes within ``lateness`` of it.
    """
    spark = stream.sparkSession
    target = target or scratch_path(spark, "steplog")
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    if step:
        timed = timed.dropDuplicatesWithinWatermark(step)
    windows = timed.groupBy(*_windows(ts, by, width)).agg(*_aggregates(value))

    def save(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target}/data/batch={batch}")

    query = (
        windows.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", f"{target}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return _named(_merged(spark, target, windows.schema, by), by)


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the complete directories ``batch=...`` in a folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in files.listStatus(place)] if files.exists(place) else []
    return sorted(int(p.getName().split("=")[1]) for p in names if p.getName().startswith("batch=") and files.exists(hadoop.Path(p, "_SUCCESS")))


def _merged(spark: SparkSession, target: str, windows: T.StructType, by: str) -> DataFrame:
    """The newest state of each window: a table of all batches up to one, merged with the batches behind it.

    The table is written anew, complete with its mark, before what it replaces is deleted; whoever finds both takes the
    greater number.
    """
    schema = T.StructType(windows.fields + [T.StructField("batch", T.LongType())])
    data, whole = f"{target}/data", f"{target}/merged"
    tables, batches = _numbers(spark, whole), _numbers(spark, data)
    upto = tables[-1] if tables else -1
    fresh = [b for b in batches if b > upto]
    if not fresh and not tables:
        return spark.createDataFrame([], windows)
    if fresh:
        parts = [spark.read.schema(schema).parquet(f"{whole}/batch={upto}")] if tables else []
        # the batches' numbers are columns here, so that the merged table keeps them
        parts += [spark.read.schema(windows).parquet(f"{data}/batch={b}").withColumn("batch", F.lit(b).cast("bigint")) for b in fresh]
        every = reduce(DataFrame.unionByName, parts)
        newest = every.groupBy("window", by).agg(F.max_by(F.struct("n", "total"), "batch").alias("_last"), F.max("batch").alias("batch"))
        upto = fresh[-1]
        newest.select("window", by, "_last.*", "batch").write.mode("overwrite").parquet(f"{whole}/batch={upto}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in [f"{whole}/batch={b}" for b in tables if b < upto] + [f"{data}/batch={b}" for b in batches if b <= upto]:
        files.delete(hadoop.Path(old), True)
    return spark.read.schema(schema).parquet(f"{whole}/batch={upto}").drop("batch")
