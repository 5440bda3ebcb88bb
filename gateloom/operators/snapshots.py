"""Results that are kept: a table under a digest of what it was made from, read again instead of made again.

The digest covers the method, its parameters and all rows of the input, whatever their order; so another input, parameter or method makes another snapshot, and the same ones never run twice.
Restored coordinates join with events by their keys.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateloom.core.shared import exists, removed


def digest(rows: DataFrame, method: str, parameters: Mapping) -> str:
    """Of the rows as a multiset, their columns, a method and its parameters: two sums of 64-bit hashes and the count, one aggregation."""
    columns = sorted(rows.columns)
    hashes = [F.sum(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in columns]).cast("decimal(20,0)")) for seed in (1, 2)]
    sums = rows.agg(F.count("*"), *hashes).first()
    kinds = [(c, rows.schema[c].dataType.simpleString()) for c in columns]
    return hashlib.sha256(json.dumps([method, parameters, kinds, [str(v) for v in sums]], sort_keys=True, default=str).encode()).hexdigest()


def path_of(folder: str, key: str) -> str:
    return f"{folder.rstrip('/')}/snapshot-{key}"


def kept(folder: str, rows: DataFrame, method: str, parameters: Mapping, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make(rows), stored in folder the first time; later the stored table, without calling make. A half-written snapshot is not one: it gets its name when it is whole."""
    spark, key = rows.sparkSession, digest(rows, method, parameters)
    path = path_of(folder, key)
    if not exists(spark, path):
        part = f"{path}.{uuid.uuid4().hex}.part"
        make(rows).write.parquet(part)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        if not at(part).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(at(part), at(path)) and not exists(spark, path):
            raise OSError(f"the snapshot {path} can't be put in place")
        removed(spark, part)
    return spark.read.parquet(path)


def restored(spark: SparkSession, folder: str, key: str) -> DataFrame | None:
    """The table of a digest; None if there is none."""
    path = path_of(folder, key)
    return spark.read.parquet(path) if exists(spark, path) else None


def with_coordinates(events: DataFrame, coordinates: DataFrame, keys: Sequence[str] = ("row_index",)) -> DataFrame:
    """events that have a place, with it."""
    return events.join(coordinates, list(keys))
