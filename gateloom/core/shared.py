"""The folder that the driver and all executors see, and tables that are kept there between jobs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, or, where that is unset and all run in one process, in a temporary folder."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir isn't set: the executors need a folder that all of them and the driver see")
        top = tempfile.mkdtemp(prefix="gateloom-")
        sc.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local_form(path: str) -> str:
    """A path for open(): without file:."""
    return re.sub("^file:(//)?", "", path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Stages:
    """Tables written between the rounds of an iteration, each under a name; writing a name anew removes what it held two writes ago.

    The table before the last stays, as the last may still be compared with it. close() removes all but those named.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        df.write.parquet(path)
        held = self.held.setdefault(name, [])
        held.append(path)
        while len(held) > 2:
            removed(self.spark, held.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self, *keep: str) -> None:
        for name, paths in self.held.items():
            for path in paths[:-1] if name in keep else paths:
                removed(self.spark, path)
