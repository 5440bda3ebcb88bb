"""Order without a sort of a whole group in one task: running sums and row numbers by ranges, exact order statistics by narrowing brackets."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gateloom.core.shared import Stages

#: Ranges that a whole table is cut into, bins of a bracket, and values of a bracket that are counted one by one.
RANGES, BINS, FEW = 64, 4096, 50_000
#: Rows of a task, about, where Spark's own number of partitions would leave it more.
TASK_ROWS = 300_000


def task_count(spark: SparkSession, rows: int) -> int:
    """Partitions of a shuffle of so many rows: Spark's own number, or as many as leave TASK_ROWS to a task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / TASK_ROWS))


def joined(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """a with the other columns of b where all keys agree; null equals null."""
    own = {k: f"_same_{i}" for i, k in enumerate(keys)}
    condition = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(v)) for k, v in own.items()], F.lit(True))
    return a.join(b.withColumnsRenamed(own), condition, how).drop(*own.values())


def ranges(df: DataFrame, x: str, n: int) -> Column:
    """The number of a row's range of x."""
    return counted_ranges(df, x, n)[0]


def counted_ranges(df: DataFrame, x: str, n: int) -> tuple[Column, int]:
    """The number of a row's range of x, ascending, nulls first: about equal ones over all rows, and how many rows there are. The bounds, n numbers, come to the driver."""
    bounds, rows = df.agg(F.percentile_approx(x, [i / n for i in range(1, n)], 10_000), F.count("*")).first()
    kind = df.schema[x].dataType
    above = [F.col(x) > F.lit(b).cast(kind) for b in dict.fromkeys(bounds or [])]
    return F.coalesce(sum((a.cast("int") for a in above), F.lit(1)), F.lit(0)), rows


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], weight: Column, name: str, n: int = RANGES) -> DataFrame:
    """df with the sum of weight over the rows of its group that come before it in order.

    Each group is cut into ranges of the first column of order (a number, date or time); a range is summed in its task, and the sums of the ranges before it, a few numbers a group, are added.
    Rows with one and the same first value stay together. Many rows are shuffled to more tasks than usual, so that what a task sorts doesn't grow with them.
    """
    # in a struct null equals null, and the window and the join below share one shuffle
    range_, rows = counted_ranges(df, order[0], n)
    cut = df.withColumn("_range", range_).withColumn("_weight", weight).withColumn("_key", F.struct(*by, "_range"))
    parts = task_count(df.sparkSession, rows)
    if parts > task_count(df.sparkSession, 0):
        cut = cut.repartition(parts, "_key")
    sums = cut.groupBy("_key").agg(F.sum("_weight").alias("_sum"))
    earlier = Window.partitionBy(*[F.col("_key")[c] for c in by]).orderBy(F.col("_key")["_range"]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_key", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    return own.join(offsets, "_key").select(*df.columns, (F.col("_inside") + F.col("_offset")).alias(name))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "row_index", n: int = RANGES) -> DataFrame:
    """df with the number of each row in its group, from 0."""
    return running(df, by, order, F.lit(1).cast("bigint"), name, n)


def long_form(df: DataFrame, by: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """by, channel, v: the numbers of channels; null and NaN are left out."""
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("v")) for c in channels])
    return df.select(*by, F.explode(rows).alias("r")).select(*by, "r.*").filter(F.col("v").isNotNull() & ~F.isnan("v"))


def values_at(rows: DataFrame, keys: Sequence[str], ranks: DataFrame, bins: int = BINS, few: int = FEW) -> DataFrame:
    """keys, rank, value: of rows (keys, v) the values at the ranks (from 0) that ranks (keys, rank, n, low, high) asks for.

    A rank lies in a bracket, at first all of its group. Each round counts the rows of the brackets by bin, which is one aggregation, and the bracket becomes the range of the
    values in the bin where the rank lies; when all have few rows, distinct values are counted instead. No group is sorted or gathered; a bracket with one value, however often, is done.
    """
    def counted(open_: DataFrame, bin_: Column) -> DataFrame:
        brackets = open_.select(*keys, "below", "low", "high").distinct()
        met = joined(rows, F.broadcast(brackets) if small else brackets, keys).filter((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        bins_ = met.groupBy(*keys, "below", bin_.alias("bin")).agg(F.count("*").alias("in_bin"), F.min("v").alias("least"), F.max("v").alias("most"))
        order = Window.partitionBy(*keys, "below").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins_ = bins_.withColumn("start", F.col("below") + F.coalesce(F.sum("in_bin").over(order), F.lit(0)))
        hit = joined(open_.select(*keys, "rank", "below"), bins_, [*keys, "below"]).filter((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("in_bin")))
        return hit.select(*keys, "rank", F.col("start").alias("below"), F.col("in_bin").alias("n"), F.col("least").alias("low"), F.col("most").alias("high"))

    half = lambda c: F.col(c) / 2  # noqa: E731  no range overflows
    finer = F.least(F.floor((half("v") - half("low")) / (half("high") - half("low")) * bins), F.lit(bins - 1).cast("bigint"))
    keys, stages, done = list(keys), Stages(rows.sparkSession), []
    at = ranks.select(*keys, "rank", F.lit(0).cast("bigint").alias("below"), F.col("n").cast("bigint"), "low", "high")
    most, asked = at.agg(F.max(F.when(F.col("low") < F.col("high"), F.col("n"))), F.count("*")).first()
    small = asked <= FEW  # brackets are broadcast only if they are counted to be few
    while (most or 0) > few:
        done.append(at.filter("low = high"))
        at = stages.store(counted(at.filter("low < high"), finer), f"brackets{len(done)}")
        most = at.filter("low < high").agg(F.max("n")).first()[0]
    return reduce(DataFrame.unionByName, [*done, counted(at, F.col("v")) if most else at]).select(*keys, "rank", F.col("low").alias("value"))


def order_statistics(df: DataFrame, by: Sequence[str], channels: Sequence[str], fractions: Sequence[float], how: str = "linear", bins: int = BINS, few: int = FEW) -> DataFrame:
    """by, channel, fraction, n, value: exact quantiles of each group's channels. how: linear between the two nearest order statistics, nearest, or floor of fraction (n - 1).

    Groups without a number in a channel have no row for it. An infinite value ranks as what it is, and is interpolated as such.
    """
    keys = [*by, "channel"]
    rows = long_form(df, by, channels)
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    place = F.col("fraction") * (F.col("n") - 1)
    ends = {"linear": (F.floor(place), F.ceil(place)), "nearest": (F.floor(place + 0.5),) * 2, "floor": (F.floor(place),) * 2}[how]
    asked = groups.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions]))).withColumn("a", ends[0]).withColumn("b", ends[1])
    ranks = asked.select(*keys, F.explode(F.array("a", "b")).alias("rank"), "n", "low", "high").distinct()
    found = values_at(rows, keys, ranks, bins, few)
    for end in ("a", "b"):
        asked = joined(asked, found.select(*keys, F.col("rank").alias(end), F.col("value").alias(f"value_{end}")), [*keys, end])
    between = (F.col("b") - place) * F.col("value_a") + (place - F.col("a")) * F.col("value_b")
    return asked.select(*keys, "fraction", "n", F.when(F.col("a") == F.col("b"), F.col("value_a")).otherwise(between).alias("value"))


def wide_form(found: DataFrame, by: Sequence[str], names: dict[float, str]) -> DataFrame:
    """by, a column for each fraction: order statistics of one channel."""
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("fraction") == F.lit(float(f)), F.col("value"))).alias(n) for f, n in names.items()])
