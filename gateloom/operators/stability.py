"""Quality control over acquisition time: where peaks of the signal move, events go.

A sample's events, in their order, are cut into bins of equal size (BINS at most, LEAST events at least each). For each channel and bin an aggregation counts a histogram over the
channel's range; from there on a sample is a few hundred bins, whatever its number of events. The peaks of each bin are matched with the sample's own, which gives a place in each bin for each peak. An isolation tree
over bins, which splits as long as a split lessens the spread of one peak's places by more than `limit`, keeps the largest leaf; a bin with a place farther than `deviations` median absolute
deviations from the median of its (smoothed) peak goes too, as do kept runs of fewer than `run` bins between removed ones. Rows of removed bins go by an anti-join.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateloom.core.order import joined
from gateloom.operators.models import found_peaks

#: Bins of a sample at most, events of a bin at least, cells of a bin's histogram.
BINS, LEAST, CELLS = 500, 150, 128


def with_bins(events: DataFrame, by: str, row: str, bins: int = BINS, least: int = LEAST) -> DataFrame:
    """events and bin, from 0 in the order of row (0-based in each sample)."""
    n = events.groupBy(by).agg(F.count("*").alias("_n"))
    k = F.greatest(F.lit(1), F.least(F.lit(bins), F.floor(F.col("_n") / least)))
    return joined(events, n, [by]).withColumn("bin", F.least(F.floor(F.col(row) * k / F.col("_n")), k - 1).cast("int")).drop("_n")


def smooth(y: np.ndarray, width: float) -> np.ndarray:
    r = int(4 * width)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / width) ** 2)
    return np.convolve(y, k / k.sum(), mode="same")


def places_of(counts: np.ndarray, share: float = 1 / 3) -> np.ndarray:
    """bins by peaks: where (in cells) each of the sample's peaks lies in each bin; the sample's place where a bin has none near. counts: bins by cells."""
    whole = smooth(counts.sum(0).astype(float), 2)
    pad = lambda y: np.r_[0, y, 0]
    own = [i - 1 for i, _ in found_peaks(pad(whole), distance=6, height=share * whole.max())] or [int(whole.argmax())]
    reach = max(4, min((b - a for a, b in zip(own, own[1:])), default=counts.shape[1]) / 2)
    out = np.tile(np.array(own, float), (len(counts), 1))
    for b, row in enumerate(counts):
        s = smooth(row.astype(float), 3)
        if s.max() <= 0:
            continue
        at = np.array([i - 1 for i, _ in found_peaks(pad(s), distance=6, height=share * s.max())] or [int(s.argmax())])
        for j, p in enumerate(own):
            near = at[np.abs(at - p).argmin()]
            if abs(near - p) <= reach:
                lo, hi = max(near - 3, 0), near + 4
                out[b, j] = np.average(np.arange(lo, lo + len(s[lo:hi])), weights=np.maximum(s[lo:hi], 1e-12))
    return out


def isolation_leaf(x: np.ndarray, limit: float = 0.6, smallest: int = 2, least: float = 0.5) -> np.ndarray:
    """Rows of the largest leaf of a tree that splits on the column and value with the largest gain, while that is over limit.

    Gain: one less the mean of both sides' deviations over the node's. A column whose deviation in a node is below least is taken as steady there: half a cell is the noise of a peak's place.
    """
    leaves, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        best = (limit, None, None)
        for c in range(x.shape[1]):
            order = at[np.argsort(x[at, c], kind="stable")]
            v = x[order, c]
            sd = v.std()
            if sd < least or len(v) < 2 * smallest:
                continue
            n = np.arange(1, len(v))
            s, q = np.cumsum(v - v.mean()), np.cumsum((v - v.mean()) ** 2)
            left = np.sqrt(np.maximum(q[:-1] / n - (s[:-1] / n) ** 2, 0))
            m = len(v) - n
            right = np.sqrt(np.maximum((q[-1] - q[:-1]) / m - ((s[-1] - s[:-1]) / m) ** 2, 0))
            gain = np.where((v[1:] > v[:-1]) & (n >= smallest) & (m >= smallest), (sd - (left + right) / 2) / sd, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), order[: k + 1], order[k + 1 :])
        if best[1] is None:
            leaves.append(at)
        else:
            todo += [best[1], best[2]]
    return max(leaves, key=len) if leaves else np.arange(0)


def outliers(x: np.ndarray, deviations: float = 6.0, width: int = 5) -> np.ndarray:
    """Rows with a place too far from its column's median, after a running median over neighbouring bins."""
    bad = np.zeros(len(x), bool)
    for c in range(x.shape[1]):
        r = width // 2
        v = np.pad(x[:, c], r, mode="edge")
        v = np.median(np.lib.stride_tricks.sliding_window_view(v, width), axis=1) if len(x) else x[:, c]
        middle = np.median(v) if len(v) else 0.0
        mad = max(1.4826 * np.median(np.abs(v - middle)) if len(v) else 0.0, 0.25)  # less than a quarter of a cell is no movement
        bad |= np.abs(v - middle) > deviations * mad
    return bad


def short_runs(bad: np.ndarray, run: int = 5) -> np.ndarray:
    """bad, with runs of good bins shorter than run between bad ones, or between a bad one and an end, made bad."""
    out, edge = bad.copy(), np.r_[0, np.nonzero(np.diff(bad.astype(int)))[0] + 1, len(bad)]
    for a, b in zip(edge[:-1], edge[1:]):
        if b > a and not bad[a] and b - a < run and b - a < len(bad):
            out[a:b] = True
    return out


def bin_verdicts(events: DataFrame, channels: Sequence[str], by: str = "sample", row: str = "row_index", bins: int = BINS, least: int = LEAST, limit: float = 0.6, deviations: float = 6.0, run: int = 5, scale=lambda x: F.asinh(x / F.lit(150.0))) -> DataFrame:
    """by, bin, n, by_tree, by_deviation, removed: for each bin. A sample with fewer than 2 * least events is one bin, which stays. Numbers that are null or NaN count in no histogram."""
    cut = with_bins(events, by, row, bins, least)
    long = cut.select(by, "bin", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), scale(F.col(c).cast("double")).alias("v")) for c in channels])).alias("r")).select(by, "bin", "r.*").filter(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = long.groupBy(by, "c").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    cell = F.when(F.col("high") > F.col("low"), F.least(F.lit(CELLS - 1).cast("bigint"), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * CELLS))).otherwise(F.lit(0)).cast("int")
    counts = joined(long, ends, [by, "c"]).groupBy(by, "bin", "c", cell.alias("cell")).agg(F.count("*").alias("n"))
    sizes = cut.groupBy(by, "bin").agg(F.count("*").alias("n"))
    both = counts.unionByName(sizes.select(by, "bin", F.lit(None).cast("string").alias("c"), F.lit(None).cast("int").alias("cell"), "n"))
    kind = events.schema[by].dataType.simpleString()

    def judged(rows):  # BINS * CELLS * channels rows of a sample at most
        import pandas as pd

        own = rows[rows["c"].isna()].sort_values("bin")
        at = {b: i for i, b in enumerate(own["bin"])}
        found = []
        for _, part in rows[rows["c"].notna()].sort_values(["c", "bin", "cell"]).groupby("c"):
            m = np.zeros((len(at), CELLS))
            m[[at[b] for b in part["bin"]], part["cell"].astype(int)] = part["n"]
            found.append(places_of(m))
        x = np.hstack(found) if found else np.zeros((len(at), 0))
        good = np.zeros(len(at), bool)
        good[isolation_leaf(x, limit)] = True
        far = outliers(x, deviations)
        removed = short_runs(~good | far, run) if len(at) > 1 else np.zeros(len(at), bool)
        return pd.DataFrame({by: own[by].to_numpy(), "bin": own["bin"].to_numpy(), "n": own["n"].to_numpy(), "by_tree": ~good, "by_deviation": far, "removed": removed})

    return both.groupBy(by).applyInPandas(judged, f"{by} {kind}, bin int, n bigint, by_tree boolean, by_deviation boolean, removed boolean")


def stable(events: DataFrame, verdicts: DataFrame, by: str = "sample", row: str = "row_index", bins: int = BINS, least: int = LEAST) -> DataFrame:
    """events without those of removed bins."""
    return with_bins(events, by, row, bins, least).join(verdicts.filter("removed").select(by, "bin"), [by, "bin"], "left_anti").select(*events.columns)


def removed_shares(verdicts: DataFrame, by: str = "sample") -> DataFrame:
    """by, events, removed, pct_removed, pct_tree, pct_deviation."""
    pct = lambda c: F.round(F.lit(100.0) * F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)) / F.sum("n"), 6)
    return verdicts.groupBy(by).agg(F.sum("n").alias("events"), F.coalesce(F.sum(F.when(F.col("removed"), F.col("n"))), F.lit(0)).alias("removed"), pct("removed").alias("pct_removed"), pct("by_tree").alias("pct_tree"), pct("by_deviation").alias("pct_deviation"))
