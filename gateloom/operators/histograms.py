"""Histograms, density grids, smoothing, and thresholds found on histograms.

Three binning rules exist and differ: equal widths with a closed last edge; `bins` steps clamped at both ends; and display cells.
Rows are only counted; all that follows works on a row for each bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equal_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The bin of x among equal ones on [lo, hi], the last edge included; null outside."""
    b = F.floor((x - lo) / ((hi - lo) / F.lit(float(bins)))).cast("int")
    return F.when((x >= lo) & (x <= hi) & (hi > lo), F.least(b, F.lit(bins - 1)))


def clamped_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The bin of x among `bins` steps from lo on, clamped at both ends."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), ((x - lo) * (F.lit(float(bins)) / (hi - lo))).cast("int")))


def display_bin(x: Column, lo: Column, hi: Column, cells: int) -> Column:
    """The display cell of x: int((x - lo) / (hi - lo) (cells - 1)); null outside the cells."""
    b = ((x - lo) / (hi - lo) * F.lit(float(cells - 1))).cast("int")
    return F.when((b >= 0) & (b < cells), b)


def ranges(df: DataFrame, by: Sequence[str], x: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """by, lo, hi: least and greatest value, or percentiles."""
    return df.groupBy(*by).agg((F.min(x) if low is None else F.percentile(x, low / 100)).alias("lo"), (F.max(x) if high is None else F.percentile(x, high / 100)).alias("hi"))


def histogram(df: DataFrame, by: Sequence[str], x: str, bins: int, rule=equal_bin, low: float | None = None, high: float | None = None) -> DataFrame:
    """by, bin, lo, hi, n for every bin, empty ones too."""
    edges = F.broadcast(ranges(df, by, x, low, high))  # a row for each sample
    counted = df.join(edges, list(by)).withColumn("bin", rule(F.col(x), F.col("lo"), F.col("hi"), bins)).where("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n"))
    grid = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counted, [*by, "bin"], "left").select(*by, "bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def moving_average(h: DataFrame, by: Sequence[str], width: int = 5, zero_padded: bool = True, x: str = "n", name: str = "smooth") -> DataFrame:
    """h with the mean of `width` bins around each; beyond the ends there are zeros, or nothing."""
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(-(width // 2), width // 2)
    return h.withColumn(name, F.sum(x).over(w) / F.lit(float(width)) if zero_padded else F.avg(x).over(w))


def box_passes(h: DataFrame, by: Sequence[str], passes: int = 3, width: int = 5) -> DataFrame:
    """h with `smooth` after several passes of the mean of the bins that there are."""
    h = h.withColumn("smooth", F.col("n").cast("double"))
    for i in range(passes):
        h = moving_average(h, by, width, False, "smooth", "smooth")
    return h


def mode(df: DataFrame, by: Sequence[str], x: str, bins: int = 256) -> DataFrame:
    """by, mode: the centre of the first tallest bin of a smoothed histogram; of a constant its value."""
    edges = ranges(df, by, x)
    flat = edges.where("hi <= lo").select(*by, F.col("lo").alias("mode"))
    h = box_passes(histogram(df.join(edges.where("hi > lo").select(*by), list(by), "left_semi"), by, x, bins, clamped_bin), by)
    top = h.groupBy(*by).agg(F.max(F.struct(F.round("smooth", 9).alias("s"), (-F.col("bin")).alias("b"), "lo", "hi")).alias("t"))
    return top.select(*by, (F.col("t.lo") + (F.lit(0.5) - F.col("t.b")) / (F.lit(float(bins)) / (F.col("t.hi") - F.col("t.lo")))).alias("mode")).unionByName(flat)


def otsu_clamped(df: DataFrame, by: Sequence[str], x: str, bins: int = 256) -> DataFrame:
    """by, threshold: Otsu's on `bins` steps; class 0 takes in the threshold's bin; the bin's centre."""
    h = histogram(df, by, x, bins, clamped_bin)
    upto, whole = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    h = h.select(*by, "bin", "lo", "hi", F.sum("n").over(upto).alias("w"), F.sum("n").over(whole).alias("all"), F.sum(F.col("n") * F.col("bin")).over(upto).alias("s"), F.sum(F.col("n") * F.col("bin")).over(whole).alias("sum"))
    h = h.where("w > 0 and w < all")
    between = F.col("w").cast("double") * (F.col("all") - F.col("w")) * F.pow(F.col("s") / F.col("w") - (F.col("sum") - F.col("s")) / (F.col("all") - F.col("w")), F.lit(2.0))
    top = h.groupBy(*by).agg(F.max(F.struct(F.round(between, 3).alias("v"), (-F.col("bin")).alias("b"), "lo", "hi")).alias("t"))
    return top.select(*by, (F.col("t.lo") + (F.lit(0.5) - F.col("t.b")) / (F.lit(float(bins)) / (F.col("t.hi") - F.col("t.lo")))).alias("threshold"))


def otsu_trimmed(df: DataFrame, by: Sequence[str], x: str, bins: int = 256) -> DataFrame:
    """by, threshold: Otsu's over equal bins on the 0.5th to the 99.5th percentile; the bin's middle."""
    h = histogram(df, by, x, bins, equal_bin, 0.5, 99.5)
    upto, whole = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    mid = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    h = h.withColumn("mid", mid).select(*by, "bin", "mid", F.sum("n").over(upto).alias("w0"), F.sum("n").over(whole).alias("all"), F.sum(F.col("n") * F.col("mid")).over(upto).alias("s"), F.sum(F.col("n") * F.col("mid")).over(whole).alias("sum"))
    w0, w1 = F.col("w0") / F.col("all"), 1 - F.col("w0") / F.col("all")
    m0, m1 = F.col("s") / F.greatest(F.col("w0"), F.lit(1)), (F.col("sum") - F.col("s")) / F.greatest(F.col("all") - F.col("w0"), F.lit(1))
    top = h.where("w0 > 0 and w0 < all").groupBy(*by).agg(F.max(F.struct(F.round(w0 * w1 * (m0 - m1) * (m0 - m1), 9).alias("v"), (-F.col("bin")).alias("b"), "mid")).alias("t"))
    return top.select(*by, F.col("t.mid").alias("threshold"))


def isodata(df: DataFrame, by: Sequence[str], x: str, bins: int = 256) -> DataFrame:
    """by, threshold: the least bin middle that lies at the mean of the means below and above it (Ridler and Calvard)."""
    h = histogram(df, by, x, bins)
    upto, whole = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    h = h.withColumn("mid", F.col("lo") + (F.col("bin") + 0.5) * step).select(*by, "mid", step.alias("step"), F.sum("n").over(upto).alias("w"), F.sum("n").over(whole).alias("all"), F.sum(F.col("n") * F.col("mid")).over(upto).alias("s"), F.sum(F.col("n") * F.col("mid")).over(whole).alias("sum"))
    h = h.where("w > 0 and w < all").withColumn("gap", (F.col("s") / F.col("w") + (F.col("sum") - F.col("s")) / (F.col("all") - F.col("w"))) / 2 - F.col("mid"))
    return h.where("gap >= 0 and gap < step").groupBy(*by).agg(F.min("mid").alias("threshold"))


def triangle(df: DataFrame, by: Sequence[str], x: str, bins: int = 256) -> DataFrame:
    """by, threshold: the bin farthest below the line from the tallest bin to the end of the longer tail (Zack)."""
    h = histogram(df, by, x, bins)
    whole = Window.partitionBy(*by)
    peak = F.max(F.struct("n", (-F.col("bin")).alias("b"))).over(whole)
    h = h.withColumn("pb", -peak["b"]).withColumn("pn", peak["n"]).withColumn("first", F.min(F.when(F.col("n") > 0, F.col("bin"))).over(whole)).withColumn("last", F.max(F.when(F.col("n") > 0, F.col("bin"))).over(whole))
    left = F.col("pb") - F.col("first") > F.col("last") - F.col("pb")
    far = F.when(left, F.col("pb") - F.col("bin")).otherwise(F.col("bin") - F.col("pb"))
    span = F.when(left, F.col("pb") - F.col("first")).otherwise(F.col("last") - F.col("pb"))
    h = h.withColumn("far", far).withColumn("span", span).where("far >= 0 and far <= span and span > 0")
    gap = F.col("pn") - F.col("pn") * F.col("far") / F.col("span") - F.col("n")
    top = h.groupBy(*by).agg(F.max(F.struct(F.round(gap, 6).alias("g"), (-F.col("bin")).alias("b"), "lo", "hi")).alias("t"))
    return top.select(*by, (F.col("t.lo") + (F.lit(0.5) - F.col("t.b")) * (F.col("t.hi") - F.col("t.lo")) / F.lit(float(bins))).alias("threshold"))


def cumulative(h: DataFrame, by: Sequence[str]) -> DataFrame:
    """h with cdf: the share of all counts up to each bin."""
    upto = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return h.withColumn("cdf", F.sum("n").over(upto) / F.greatest(F.sum("n").over(Window.partitionBy(*by)), F.lit(1)))


def peaks(h: DataFrame, by: Sequence[str], x: str = "smooth") -> DataFrame:
    """h with kind: 1 at a local peak, -1 at a valley, 0 elsewhere."""
    w = Window.partitionBy(*by).orderBy("bin")
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    return h.withColumn("kind", F.when((F.col(x) > before) & (F.col(x) >= after), 1).when((F.col(x) < before) & (F.col(x) <= after), -1).otherwise(0))


def gaussian_blur(h: DataFrame, by: Sequence[str], radius: int, bins: int, x: str = "n") -> DataFrame:
    """by, bin, blur: a Gaussian of sigma = radius over 2 radius + 1 bins, beyond the ends the last bin again."""
    offsets = h.sparkSession.range(-radius, radius + 1).select(F.col("id").cast("int").alias("o"), F.exp(-F.pow(F.col("id").cast("double"), F.lit(2.0)) / F.lit(2.0 * radius * radius)).alias("k"))
    spread = h.select(*by, "bin").withColumn("o", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).join(F.broadcast(offsets), "o")
    source = h.select(*by, F.col("bin").alias("at"), F.col(x).cast("double").alias("v"))
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.col("bin") + F.col("o")))
    return spread.withColumn("at", at).join(source, [*by, "at"]).groupBy(*by, "bin").agg((F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("blur"))


def grid(df: DataFrame, by: Sequence[str], x: str, y: str, width: int, height: int, extra: dict[str, Column] | None = None) -> DataFrame:
    """by, px, py, n and more aggregates: counts by display cell; y grows upward, so row 0 is the top."""
    edges = df.groupBy(*by).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).where("x1 > x0 and y1 > y0")
    cells = df.join(F.broadcast(edges), list(by)).withColumn("px", display_bin(F.col(x), F.col("x0"), F.col("x1"), width)).withColumn("py", F.lit(height - 1) - display_bin(F.col(y), F.col("y0"), F.col("y1"), height))
    return cells.groupBy(*by, "px", "py").agg(F.count("*").alias("n"), *[v.alias(k) for k, v in (extra or {}).items()])


def palette(g: DataFrame, by: Sequence[str]) -> DataFrame:
    """g with shade 0..255 on a log scale of the counts."""
    top = F.max("n").over(Window.partitionBy(*by))
    return g.withColumn("shade", F.floor(F.ln(F.col("n") + 1) / F.ln(top + 1) * 255).cast("int"))


def contour_levels(g: DataFrame, by: Sequence[str], levels: int) -> DataFrame:
    """by, level, density: the density at which the mass of denser cells crosses level / (levels + 1)."""
    order = Window.partitionBy(*by).orderBy(F.col("n").desc(), "py", "px").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("share", F.sum("n").over(order) / F.sum("n").over(Window.partitionBy(*by)))
    marks = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(k / (levels + 1)).alias("mark")) for k in range(1, levels + 1)])
    return g.withColumn("m", F.explode(marks)).where(F.col("share") >= F.col("m.mark")).groupBy(*by, F.col("m.level").alias("level")).agg(F.max("n").alias("density"))
