"""Tables that a plan writes for itself: in the folder of spark.checkpoint.dir, which driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path below the shared folder. A session without other machines gets a folder of its own where none is named; a
    cluster is refused then."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lodestrata-")
        spark.sparkContext.setCheckpointDir(found)
    path = f"{found}/lodestrata/{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as a shuffle has: a file of short rows is read by few tasks, which would do all the
    work its rows need. Filters after it move before it, unless it is stored."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def stored(df: DataFrame) -> DataFrame:
    """df written and read back: cuts the lineage and survives lost executors."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
