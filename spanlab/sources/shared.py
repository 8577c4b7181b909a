"""A folder that driver and executors share, for files that queries write and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; it goes when the driver ends.

    A local master may leave the setting out and gets a folder in the warehouse; on a cluster that is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/spanlab-scratch"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()
