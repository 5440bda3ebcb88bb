"""Spillover: matrices from controls, compensation as linear expressions, diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gateloom.core.order import joined, order_statistics
from gateloom.operators.statistics import correlation, ratio


def inverse(matrix: Sequence[Sequence[float]]) -> np.ndarray:
    """The inverse of a spillover matrix (row: source, column: where it leaks to); ValueError if it is singular."""
    m = np.asarray(matrix, float)
    if m.ndim != 2 or m.shape[0] != m.shape[1] or np.linalg.matrix_rank(m) < len(m):
        raise ValueError("the spillover matrix is singular or not square")
    return np.linalg.inv(m)


def compensated(df: DataFrame, channels: Sequence[str], matrix: Sequence[Sequence[float]], suffix: str = "") -> DataFrame:
    """df with raw @ inverse(matrix) over channels; the other columns as they are."""
    inv = inverse(matrix)
    new = {c + suffix: sum((F.col(s) * F.lit(float(inv[i, j])) for i, s in enumerate(channels)), F.lit(0.0)) for j, c in enumerate(channels)}
    return df.select(*[F.col(c) for c in df.columns if c not in new], *[v.alias(k) for k, v in new.items()]) if suffix else df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def spilled(df: DataFrame, channels: Sequence[str], matrix: Sequence[Sequence[float]]) -> DataFrame:
    """The inverse of compensated()."""
    return compensated(df, channels, np.linalg.inv(np.asarray(matrix, float)))


def nnls(s: np.ndarray, y: np.ndarray, rounds: int = 200) -> np.ndarray:
    """For each row of y the x >= 0 that minimises |x s - y|: cyclic coordinate descent on all rows together."""
    g, b = s @ s.T, y @ s.T
    x = np.maximum(0, y @ np.linalg.pinv(s))
    for _ in range(rounds):
        old = x.copy()
        for j in range(len(g)):
            if g[j, j] > 0:
                x[:, j] = np.maximum(0, x[:, j] + (b[:, j] - x @ g[:, j]) / g[j, j])
        if np.abs(x - old).max(initial=0) < 1e-10:
            break
    return x


def compensated_nonnegative(df: DataFrame, channels: Sequence[str], matrix: Sequence[Sequence[float]]) -> DataFrame:
    """df with the non-negative least-squares unmixing of each event; batches of rows in Arrow, no shuffle."""
    s, names = np.asarray(matrix, float), list(channels)

    def run(batches):
        for b in batches:
            y = np.stack([np.nan_to_num(b.column(c).to_numpy(zero_copy_only=False).astype(float)) for c in names], axis=1)
            x = nnls(s, y)
            cols = {c: (pa.array(x[:, names.index(c)]) if c in names else b.column(c)) for c in b.schema.names}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    out = df.select(*[F.col(c).cast("double").alias(c) if c in names else F.col(c) for c in df.columns])
    return out.mapInArrow(run, out.schema)


def spillover_rows(controls: DataFrame, channels: Sequence[str], positive: Column, baseline: dict[str, float], control: str = "sample", primary: str = "primary") -> DataFrame:
    """control, target, coef: (median of positives - baseline) over that of the primary channel, 5 digits, 1 on the diagonal."""
    med = controls.groupBy(control, primary).agg(*[F.median(F.when(positive, F.col(c))).alias(c) for c in channels])
    signal = {c: F.col(c) - F.lit(baseline.get(c, 0.0)) for c in channels}
    own = F.lit(None).cast("double")
    for c in channels:
        own = F.when(F.col(primary) == c, signal[c]).otherwise(own)
    rows = F.array(*[F.struct(F.lit(c).alias("target"), F.when(F.col(primary) == c, F.lit(1.0)).otherwise(F.round(ratio(signal[c], own), 5)).alias("coef")) for c in channels])
    return med.select(control, F.explode(rows).alias("r")).select(control, "r.*")


def slopes(df: DataFrame, by: Sequence[str], x: Column, ys: dict[str, Column]) -> DataFrame:
    """by and for each y the least-squares slope through the origin on x."""
    return df.groupBy(*by).agg(*[ratio(F.sum(x * y), F.sum(x * x)).alias(k) for k, y in ys.items()])


def huber_slope(x: np.ndarray, y: np.ndarray, delta: float = 1.35, rounds: int = 200) -> float:
    """Slope through the origin under Huber's loss: reweighted least squares with a robust scale."""
    if not len(x) or not (x * x).sum():
        return 0.0
    k = float((x * y).sum() / (x * x).sum())
    for _ in range(rounds):
        r = y - k * x
        scale = np.median(np.abs(r)) * 1.4826
        if scale == 0:
            break
        w = np.minimum(1.0, delta * scale / np.maximum(np.abs(r), 1e-300))
        new = float((w * x * y).sum() / (w * x * x).sum())
        if abs(new - k) < 1e-12:
            break
        k = new
    return k


def huber_slopes(df: DataFrame, by: Sequence[str], x: str, y: str, delta: float = 1.35, rounds: int = 30, least: float = 1e-6) -> DataFrame:
    """by, slope: huber_slope() of every group, for groups of any size. A round is an exact median of residuals and one aggregation of weighted products; a row for each group (a control) reaches the driver.

    Rows with a null or NaN in x or y are left out; a group without others has 0.
    """
    spark, keys = df.sparkSession, list(by)
    rows = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).withColumn("_ok", ~(F.isnull("_x") | F.isnull("_y") | F.isnan("_x") | F.isnan("_y")))
    ok = F.col("_ok")
    first = rows.groupBy(*keys).agg(F.sum(F.when(ok, F.col("_x") * F.col("_y"))).alias("xy"), F.sum(F.when(ok, F.col("_x") * F.col("_x"))).alias("xx")).collect()
    slope = {tuple(r[k] for k in keys): r["xy"] / r["xx"] if r["xx"] else 0.0 for r in first}
    live = {g for g in slope if any(tuple(r[k] for k in keys) == g and r["xx"] for r in first)}
    schema = [df.schema[k] for k in keys]
    table = lambda values, name: spark.createDataFrame([(*g, float(v)) for g, v in values.items()], T.StructType([*schema, T.StructField(name, T.DoubleType())]))
    for _ in range(rounds):
        if not live:
            break
        far = joined(rows.filter(ok), table({g: slope[g] for g in live}, "_k"), keys).withColumn("_r", F.abs(F.col("_y") - F.col("_k") * F.col("_x")))
        scale = {tuple(r[k] for k in keys): 1.4826 * r["value"] for r in order_statistics(far, keys, ["_r"], [0.5]).collect()}
        live = {g for g in live if scale.get(g)}
        if not live:
            break
        w = F.least(F.lit(1.0), F.lit(delta) * F.col("_s") / F.greatest("_r", F.lit(1e-300)))
        sums = joined(far, table({g: scale[g] for g in live}, "_s"), keys).groupBy(*keys).agg(F.sum(w * F.col("_x") * F.col("_y")).alias("xy"), F.sum(w * F.col("_x") * F.col("_x")).alias("xx")).collect()
        for r in sums:
            g = tuple(r[k] for k in keys)
            new = r["xy"] / r["xx"]
            if abs(new - slope[g]) < least * max(1.0, abs(new)):
                live.discard(g)
            slope[g] = new
    return table(slope, "slope")


def stain_index(df: DataFrame, by: Sequence[str], x: str, threshold: Column) -> DataFrame:
    """by, stain_index: (median of positives - median of negatives) / (2 x SD of negatives), with a verdict."""
    pos, neg = F.when(F.col(x) >= threshold, F.col(x)), F.when(F.col(x) < threshold, F.col(x))
    si = F.round((F.median(pos) - F.median(neg)) / (F.greatest(F.stddev_pop(neg), F.lit(1e-9)) * 2), 2)
    return df.groupBy(*by).agg(si.alias("stain_index")).withColumn("verdict", F.when(F.col("stain_index") >= 5, "Good").when(F.col("stain_index") >= 2, "Moderate").otherwise("Weak"))


def residual_pairs(df: DataFrame, channels: Sequence[str], threshold: float = 0.2) -> DataFrame:
    """a, b, r, flagged, direction for all pairs of channels, in one pass; r is 0 for a constant channel."""
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[i + 1 :]]
    one = df.agg(*[F.round(correlation(F.col(a), F.col(b)), 6).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.col(f"r{i}"), F.lit(0.0)).alias("r")) for i, (a, b) in enumerate(pairs)])
    out = one.select(F.explode(rows).alias("p")).select("p.*")
    return out.withColumn("flagged", F.abs("r") > threshold).withColumn("direction", F.when(F.col("r") > 0, "under").otherwise("over"))


def auto_controls(events: DataFrame, by: str, channels: Sequence[str], unstained=None) -> DataFrame:
    """sample, channel: in the samples' order each but the unstained one gets the detector of the highest median that none before it has.

    A row for each sample and channel reaches the driver; samples beyond the number of detectors get none.
    """
    m = events if unstained is None else events.where(F.col(by) != F.lit(unstained))
    rows = m.groupBy(by).agg(*[F.median(c).alias(c) for c in channels]).orderBy(by).collect()
    used: dict[str, object] = {}
    for r in rows:
        free = [c for c in channels if c not in used and r[c] is not None]
        if free:
            used[max(free, key=lambda c: r[c])] = r[by]
    return events.sparkSession.createDataFrame([(v, c) for c, v in used.items()], f"sample {events.schema[by].dataType.simpleString()}, channel string")


def threshold(own: Column, mixture: Column, otsu: Column, cofactor: float = 150.0) -> Column:
    """The user's threshold (on the arcsinh scale) before the mixture's and Otsu's."""
    return F.coalesce(F.sinh(own.cast("double")) * F.lit(cofactor), mixture, otsu)
