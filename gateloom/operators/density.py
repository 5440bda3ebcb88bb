"""Kernel densities of any number of rows: linear binning in one aggregation, then a convolution of the bins.

Binning shares each value between the two grid points around it (in two dimensions, the four), so what is left of the data is a grid a group, whatever the number of rows. The grid is convolved with
a Gaussian, axis by axis; the error against summing a kernel for each row is of the order of (step / bandwidth)^2 / 8 of the density's curvature term (test_density_equals_direct_evaluation states it).
Bandwidths come from the data: the smaller of the standard deviation and the quartile range over 1.34, times n^(-1/5) and 0.9 (one dimension) or n^(-1/6) (two).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateloom.core.order import joined, order_statistics, wide_form

#: A grid reaches so many bandwidths beyond the data.
BEYOND = 3


def spreads(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """by, n, low, high, spread: of the numbers of x; the smaller of deviation and quartile range over 1.34, the other one if that is 0, else 1 (all values equal)."""
    own = df.select(*by, F.col(x).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < F.lit(math.inf)))
    basic = own.groupBy(*by).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.stddev_samp("x").alias("sd"))
    q = wide_form(order_statistics(own, by, ["x"], [0.25, 0.75]), by, {0.25: "q1", 0.75: "q3"})
    iqr, sd = (F.col("q3") - F.col("q1")) / 1.34, F.coalesce("sd", F.lit(0.0))
    spread = F.when((iqr > 0) & (sd > 0), F.least(iqr, sd)).when(sd > 0, sd).otherwise(F.lit(1.0))
    return joined(basic, q, by).select(*by, "n", "low", "high", spread.alias("spread"))


def grids(df: DataFrame, by: Sequence[str], x: str, points: int, bandwidth: float | None, power: float, factor: float) -> DataFrame:
    """by, n, h, start, step: a grid of so many points for each group."""
    s = spreads(df, by, x)
    h = F.lit(float(bandwidth)) if bandwidth else F.lit(factor) * F.col("spread") * F.pow(F.col("n"), F.lit(-power))
    s = s.withColumn("h", h).withColumn("start", F.col("low") - BEYOND * F.col("h"))
    return s.select(*by, "n", "h", "start", ((F.col("high") + BEYOND * F.col("h") - F.col("start")) / (points - 1)).alias("step"))


def halves(place: Column, points: int) -> Column:
    """The grid points around a place (in steps), and the share of each."""
    at = F.least(F.floor(place), F.lit(points - 2).cast("bigint"))
    return F.array(F.struct(at.alias("i"), (at + 1 - place).alias("w")), F.struct((at + 1).alias("i"), (place - at).alias("w")))


def binned(df: DataFrame, by: Sequence[str], x: str, points: int = 512, bandwidth: float | None = None) -> DataFrame:
    """by, n, h, start, step, i, w: the weight of each grid point that has any."""
    g = grids(df, by, x, points, bandwidth, 0.2, 0.9)
    own = df.select(*by, F.col(x).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < F.lit(math.inf)))
    shares = joined(own, g, by).select(*by, F.explode(halves((F.col("x") - F.col("start")) / F.col("step"), points)).alias("s")).groupBy(*by, "s.i").agg(F.sum("s.w").alias("w"))
    return joined(shares, g, by).filter("w > 0")


def kernel(step: float, h: float) -> np.ndarray:
    """Gaussian weights at the grid's distances, as far as they count."""
    r = max(1, math.ceil(8 * h / step))
    z = np.arange(-r, r + 1) * step / h
    return np.exp(-0.5 * z * z) / (h * math.sqrt(2 * math.pi))


def density(df: DataFrame, by: Sequence[str], x: str, points: int = 512, bandwidth: float | None = None) -> DataFrame:
    """by, x, density, n, h: a row for each grid point. A group without numbers has none."""
    bins = binned(df, by, x, points, bandwidth)
    cells = bins.groupBy(*by, "n", "h", "start", "step").agg(F.collect_list(F.struct("i", "w")).alias("bins"))  # points entries at most
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def convolved(batches):
        import pandas as pd

        for b in batches:
            for r in b.to_dict("records"):
                w = np.zeros(points)
                for cell in r["bins"]:
                    w[cell["i"]] += cell["w"]
                d = np.convolve(w, kernel(r["step"], r["h"]))
                d = d[(len(d) - points) // 2 :][:points] / r["n"]
                yield pd.DataFrame({c: [r[c]] * points for c in by} | {"x": r["start"] + r["step"] * np.arange(points), "density": d, "n": r["n"], "h": r["h"]})

    return cells.mapInPandas(convolved, f"{kinds}{', ' * bool(by)}x double, density double, n bigint, h double")


def density_2d(df: DataFrame, by: Sequence[str], x: str, y: str, points: int = 64, bandwidths: tuple[float, float] | None = None) -> DataFrame:
    """by, x, y, density: a row for each point of a grid of points by points; rows with a number in both channels count."""
    hx, hy = bandwidths or (None, None)
    fits = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))
    own = df.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter(fits("x") & fits("y"))
    gx = grids(own, by, "x", points, hx, 1 / 6, 1.0)
    gy = grids(own, by, "y", points, hy, 1 / 6, 1.0).drop("n").withColumnsRenamed({c: f"y_{c}" for c in ("h", "start", "step")})
    g = joined(gx, gy, by)
    place = lambda c, p: halves((F.col(c) - F.col(f"{p}start")) / F.col(f"{p}step"), points)
    pairs = joined(own, g, by).select(*by, F.explode(place("x", "")).alias("a"), place("y", "y_").alias("bs")).select(*by, "a", F.explode("bs").alias("b"))
    cells = pairs.groupBy(*by, F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.sum(F.col("a.w") * F.col("b.w")).alias("w"))
    whole = joined(cells, g, by).groupBy(*by, "n", "h", "start", "step", "y_h", "y_start", "y_step").agg(F.collect_list(F.struct("i", "j", "w")).alias("cells"))  # points squared entries at most
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def convolved(batches):
        import pandas as pd

        for b in batches:
            for r in b.to_dict("records"):
                w = np.zeros((points, points))
                for cell in r["cells"]:
                    w[cell["i"], cell["j"]] += cell["w"]
                for axis, (step, h) in enumerate(((r["step"], r["h"]), (r["y_step"], r["y_h"]))):
                    full = np.apply_along_axis(np.convolve, axis, w, kernel(step, h))
                    w = np.take(full, range((full.shape[axis] - points) // 2, (full.shape[axis] - points) // 2 + points), axis=axis)
                i, j = np.divmod(np.arange(points * points), points)
                yield pd.DataFrame({c: [r[c]] * len(i) for c in by} | {"x": r["start"] + r["step"] * i, "y": r["y_start"] + r["y_step"] * j, "density": w.ravel() / r["n"]})

    return whole.mapInPandas(convolved, f"{kinds}{', ' * bool(by)}x double, y double, density double")


def nested_density(events: DataFrame, populations: dict[str, Column], x: str, by: Sequence[str] = ("sample",), points: int = 512) -> DataFrame:
    """by, population, x, density, n, h, share: densities of populations, each also as a share of the whole table of its group, so that a child lies below its parent."""
    inside = F.array_compact(F.array(F.lit("all"), *[F.when(c, F.lit(name)) for name, c in populations.items()]))
    rows = events.select(*by, F.explode(inside).alias("population"), x)
    d = density(rows, [*by, "population"], x, points)
    whole = rows.filter("population = 'all'").filter(F.col(x).isNotNull() & ~F.isnan(x)).groupBy(*by).agg(F.count("*").alias("_all"))
    return joined(d, whole, by).withColumn("share", F.col("density") * F.col("n") / F.col("_all")).drop("_all")
