"""Where intermediate tables live.

Everything that has to be cut out of a lineage goes to the shared folder named by
``spark.checkpoint.dir``.  Only a local master, which has no other machines, may fall back to a
folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach; set on the context if it is not yet."""
    context = spark.sparkContext
    folder = spark.conf.get(_SETTING, None) or context.getConf().get(_SETTING)
    current = context.getCheckpointDir()
    if not folder and current is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"{_SETTING} must name a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="promptloom-")
    if current is None:
        context.setCheckpointDir(folder)
    return folder or current


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that what follows does not recompute or reshuffle it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
