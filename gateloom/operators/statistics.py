"""Statistics of populations as aggregate expressions; those of an empty population are 0, as documented for each table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateloom.core import order


def where(x: Column, keep: Column | None) -> Column:
    return x if keep is None else F.when(keep, x)


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b; `otherwise` where b is 0 or null."""
    return F.when(F.coalesce(b, F.lit(0.0)) != 0, a / b).otherwise(F.lit(otherwise))


def mean(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def median(x: Column) -> Column:
    return F.coalesce(F.median(x), F.lit(0.0))


def sd(x: Column) -> Column:
    """Population standard deviation."""
    return F.coalesce(F.stddev_pop(x), F.lit(0.0))


def cv(x: Column) -> Column:
    return F.lit(100.0) * ratio(sd(x), mean(x))


def percentile(x: Column, p: float) -> Column:
    """Linear interpolation between order statistics; p in 0..100, clamped."""
    return F.coalesce(F.percentile(x, max(0.0, min(100.0, p)) / 100.0), F.lit(0.0))


def rsd(x: Column) -> Column:
    return (percentile(x, 84.13) - percentile(x, 15.87)) / 2


def rcv(x: Column) -> Column:
    return F.lit(100.0) * ratio(rsd(x), median(x))


def geomean(x: Column) -> Column:
    """Over positive values only."""
    return F.coalesce(F.exp(F.avg(F.when(x > 0, F.ln(F.when(x > 0, x))))), F.lit(0.0))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r from moments; 0 if either is constant."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 0) & (sy > 0), F.covar_pop(x, y) / (sx * sy)).otherwise(F.lit(0.0))


#: Statistics by key.
BY_KEY = {"mean": mean, "median": median, "mfi": median, "sd": sd, "cv": cv, "rsd": rsd, "rcv": rcv, "geomean": geomean, "min": lambda x: F.coalesce(F.min(x), F.lit(0.0)), "max": lambda x: F.coalesce(F.max(x), F.lit(0.0))}


def by_key(key: str) -> Column:
    """The aggregate of a statistic key: count, <stat>:<channel>, pct:<p>:<channel>, correlation:<a>:<b>. Frequencies need the tree: see tables."""
    kind, *rest = key.split(":")
    if kind == "count":
        return F.count("*")
    if kind == "pct":
        return percentile(F.col(rest[1]), float(rest[0]))
    if kind == "correlation":
        return correlation(F.col(rest[0]), F.col(rest[1]))
    return BY_KEY[kind](F.col(rest[0]))


def mad(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """by, mad: the median of absolute deviations from the median, unscaled; 0 for a group without numbers."""
    middle = order.order_statistics(df, by, [x], [0.5]).select(*by, F.col("value").alias("_m"))
    groups = df.select(*by).distinct()
    far = order.joined(df, middle, by).select(*by, F.abs(F.col(x) - F.col("_m")).alias("_d"))
    found = order.order_statistics(far, by, ["_d"], [0.5]).select(*by, F.col("value").alias("mad"))
    return order.joined(groups, found, by, "left").select(*by, F.coalesce("mad", F.lit(0.0)).alias("mad"))


def quantiles(df: DataFrame, by: Sequence[str], x: str, names: dict[float, str], how: str = "linear") -> DataFrame:
    """by and a column for each fraction, exact; 0 for a group without numbers."""
    groups, found = df.select(*by).distinct(), order.wide_form(order.order_statistics(df, by, [x], list(names), how), by, names)
    return order.joined(groups, found, by, "left").select(*by, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names.values()])


def nearest_rank(df: DataFrame, by: Sequence[str], x: str, p: float, name: str = "value") -> DataFrame:
    """by, name: the order statistic at round(p / 100 (n - 1))."""
    return order.order_statistics(df, by, [x], [p / 100.0], "nearest").select(*by, F.col("value").alias(name))


def floor_rank(df: DataFrame, by: Sequence[str], x: str, p: float, name: str = "value") -> DataFrame:
    """by, name: the order statistic at floor(p / 100 (n - 1))."""
    return order.order_statistics(df, by, [x], [p / 100.0], "floor").select(*by, F.col("value").alias(name))


def upper_median(x: Column) -> Column:
    """Of an even number of values the upper middle one."""
    return F.element_at(F.sort_array(F.collect_list(x)), (F.floor(F.count(x) / 2) + 1).cast("int"))


def average_ranks(df: DataFrame, x: str, name: str = "rank") -> DataFrame:
    """df with ranks over all rows, ties sharing the mean of theirs, and the number of ties; distinct values are summed up by ranges, rows are only joined with them."""
    ties = order.running(df.groupBy(x).agg(F.count("*").alias("_t")), [], [x], F.col("_t"), "_b")
    return df.join(ties, x).withColumn(name, F.col("_b") + (F.col("_t") + 1) / 2).withColumnRenamed("_t", "ties").drop("_b")
