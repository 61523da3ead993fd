"""Tables written once and read by several consumers, in the folder that driver and executors share."""

from __future__ import annotations

from uuid import uuid4

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written below ``spark.checkpoint.dir`` and read back; where that is unset, kept on Spark's own disks.

    Like Spark's checkpoints, the files stay until the folder is cleared. What Spark keeps itself is computed again for
    an executor that is lost.
    """
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist(StorageLevel.DISK_ONLY)
    path = f"{folder.rstrip('/')}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
