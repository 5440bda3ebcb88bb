"""Time-binned statistics of an unbounded stream of events. An extension: the batch kinetics are the parity operator.

An exact median can't be kept incrementally, so bins carry an approximate one; late events up to the watermark count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned(stream: DataFrame, channel: str, width: str = "10 minutes", late: str = "30 minutes", by: str = "sample", time: str = "ts") -> DataFrame:
    """by, start, n, mean, median (approximate) by tumbling bin."""
    w = stream.withWatermark(time, late).groupBy(by, F.window(time, width).alias("w"))
    out = w.agg(F.count("*").alias("n"), F.avg(channel).alias("mean"), F.percentile_approx(channel, 0.5).alias("median"))
    return out.select(by, F.col("w.start").alias("start"), "n", "mean", "median")


def gated_counts(stream: DataFrame, gates: dict, width: str = "10 minutes", late: str = "30 minutes", by: str = "sample", time: str = "ts") -> DataFrame:
    """by, start, n and a count for each named predicate, by tumbling bin."""
    w = stream.withWatermark(time, late).groupBy(by, F.window(time, width).alias("w"))
    return w.agg(F.count("*").alias("n"), *[F.count_if(v).alias(k) for k, v in gates.items()]).select(by, F.col("w.start").alias("start"), "n", *gates)
