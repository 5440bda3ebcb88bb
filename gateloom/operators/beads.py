"""Calibration by beads: peaks of known fluorescence give the standard curve from arbitrary units to molecules.

A channel's bead events become a histogram on an inverse hyperbolic sine scale (one aggregation); as many Gaussians as there are known values are fitted to its bins; events go to the
likeliest one by cuts between them, and each population's exact median is matched, in order, with its known value. Populations whose value is None are left out, as are saturated ones
(median within half a per cent of the range's end). The curve is known + auto = exp(b) median^m on logarithms, fitted for m, b and the beads' own fluorescence auto; the table has
exp(b) x^m at 50 places between the first and 99th percentile.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateloom.core.order import order_statistics

#: Bins of a channel's histogram, events of which stay on their side whatever their number; places of the curve.
BINS, PLACES = 1024, 50
SCHEMA = "channel string, ok boolean, n_populations int, slope double, offset double, auto double, error string, place int, x double, y double"


def peaks(middle: np.ndarray, count: np.ndarray, k: int, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations and weights, ascending, of k Gaussians fitted to a histogram; starts are k-means centres of the bins, from spread quantiles."""
    total = count.sum()
    cum = np.cumsum(count) / total
    starts = []
    for shift in (0.5, 0.25, 0.75):
        starts.append(middle[np.minimum(np.searchsorted(cum, (np.arange(k) + shift) / k), len(middle) - 1)])
    starts.append(np.linspace(middle[count > 0].min(), middle[count > 0].max(), k))
    best = None
    for m in starts:
        m = m.astype(float).copy()
        for _ in range(100):
            own = np.abs(middle[:, None] - m).argmin(1)
            new = np.array([np.average(middle[own == j], weights=count[own == j]) if count[own == j].sum() > 0 else m[j] for j in range(k)])
            if np.allclose(new, m):
                break
            m = new
        cost = float((count * np.abs(middle[:, None] - m).min(1) ** 2).sum())
        if best is None or cost < best[0]:
            best = cost, np.sort(m)
    m = best[1]
    step = float(middle[1] - middle[0])
    own = np.abs(middle[:, None] - m).argmin(1)
    s = np.array([max(step, math.sqrt(np.average((middle[own == j] - m[j]) ** 2, weights=count[own == j])) if count[own == j].sum() else step) for j in range(k)])
    w = np.array([max(count[own == j].sum() / total, 1e-6) for j in range(k)])
    for _ in range(rounds):
        p = w / s * np.exp(-0.5 * ((middle[:, None] - m) / s) ** 2)
        p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
        n = (p * count[:, None]).sum(0)
        n = np.maximum(n, 1e-9)
        new = (p * count[:, None] * middle[:, None]).sum(0) / n
        s = np.maximum(np.sqrt((p * count[:, None] * (middle[:, None] - new) ** 2).sum(0) / n), step)
        w = n / total
        if np.abs(new - m).max() < 1e-6 * step:
            m = new
            break
        m = new
    order = np.argsort(m)
    return m[order], s[order], w[order]


def cuts(m: np.ndarray, s: np.ndarray, w: np.ndarray) -> list[float]:
    """Where the next Gaussian becomes the likelier one, between neighbouring means."""
    out = []
    for i in range(len(m) - 1):
        x = np.linspace(m[i], m[i + 1], 2001)
        f = lambda j, x=x: np.log(w[j] / s[j]) - 0.5 * ((x - m[j]) / s[j]) ** 2
        out.append(float(x[int((f(i + 1) > f(i)).argmax())]) if (f(i + 1) > f(i)).any() else float((m[i] + m[i + 1]) / 2))
    return out


def standard_curve(median: np.ndarray, known: np.ndarray) -> tuple[float, float, float]:
    """m, b, auto of log(known + auto) = m log(median) + b: for each auto the line is a regression; auto by a golden-section search over its logarithm."""
    x = np.log(median)

    def line(auto: float) -> tuple[float, float, float]:
        y = np.log(known + auto)
        m = float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())
        b = float(y.mean() - m * x.mean())
        return float(((y - m * x - b) ** 2).sum()), m, b

    low = 1e-6 * float(known[known > 0].min()) if (known > 0).any() else 1e-6
    high = 10 * float(known.max()) if known.max() > 0 else 1.0
    grid = np.exp(np.linspace(math.log(low), math.log(high), 200))
    at = int(np.argmin([line(a)[0] for a in grid]))
    a, c = math.log(grid[max(at - 1, 0)]), math.log(grid[min(at + 1, len(grid) - 1)])
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(80):
        p, q = c - golden * (c - a), a + golden * (c - a)
        if line(math.exp(p))[0] < line(math.exp(q))[0]:
            c = q
        else:
            a = p
    auto = math.exp((a + c) / 2)
    _, m, b = line(auto)
    if (known > 0).all() and line(0.0)[0] <= line(auto)[0]:
        auto, (_, m, b) = 0.0, line(0.0)
    return m, b, auto


def histograms(beads: DataFrame, channels: Sequence[str], cofactor: float, bins: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Middles and counts of each channel's bins on the scale asinh(x / cofactor)."""
    scaled = {c: F.asinh(F.col(c).cast("double") / F.lit(cofactor)) for c in channels}
    fits = lambda c: scaled[c].isNotNull() & ~F.isnan(scaled[c]) & (F.abs(scaled[c]) < F.lit(math.inf))
    r = beads.agg(*[f(F.when(fits(c), scaled[c])).alias(f"{n}{i}") for i, c in enumerate(channels) for n, f in (("a", F.min), ("b", F.max))]).first()
    ends = {c: (r[f"a{i}"], r[f"b{i}"]) for i, c in enumerate(channels) if r[f"a{i}"] is not None}
    if not ends:
        return {}
    place = lambda c: F.least(F.lit(bins - 1).cast("bigint"), F.floor((scaled[c] - F.lit(ends[c][0])) / F.lit(max(ends[c][1] - ends[c][0], 1e-12)) * bins))
    rows = F.array_compact(F.array(*[F.when(fits(c), F.struct(F.lit(c).alias("c"), place(c).alias("i"))) for c in ends]))
    out = {c: (lo + (np.arange(bins) + 0.5) * max(hi - lo, 1e-12) / bins, np.zeros(bins)) for c, (lo, hi) in ends.items()}
    for row in beads.select(F.explode(rows).alias("r")).groupBy("r.c", "r.i").count().collect():  # bins numbers a channel
        out[row["c"]][1][row["i"]] = row["count"]
    return out


def calibrated(beads: DataFrame, known: Mapping[str, Sequence[float | None]], channels: Sequence[str] | None = None, cofactor: float = 150.0, bins: int = BINS) -> DataFrame:
    """channel, ok, n_populations, slope, offset, auto, error, place, x, y: 50 rows of a channel's curve, or one row that says what is wrong with it.

    known: for each channel the values of the bead populations, ascending; None for one to ignore. A channel needs three values; what it lacks, or why it fits no curve, is its error.
    """
    spark, rows = beads.sparkSession, []
    error = lambda c, n, text: rows.append((c, False, n, None, None, None, text, None, None, None))
    wanted = [c for c in (channels if channels is not None else known) if c in beads.columns]
    if not wanted:
        raise ValueError("no channel to calibrate")
    counts = {c: sum(v is not None for v in known.get(c) or ()) for c in wanted}
    for c in wanted:
        if not known.get(c):
            error(c, None, "no known values")
        elif counts[c] < 3:
            error(c, counts[c], f"a curve needs at least 3 known values, not {counts[c]}")
    able = [c for c in wanted if counts[c] >= 3]
    found = histograms(beads, able, cofactor, bins) if able else {}
    split = {}
    for c in able:
        if c not in found or (found[c][1] > 0).sum() < len(known[c]):
            error(c, counts[c], "fewer distinct values than populations")
        else:
            split[c] = [math.sinh(v) * cofactor for v in cuts(*peaks(*found[c], len(known[c])))]
    if split:
        number = lambda c: sum((F.when(F.col(c) > F.lit(v), 1).otherwise(0) for v in split[c]), F.lit(0))
        long = beads.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), number(c).alias("p"), F.col(c).cast("double").alias("v")) for c in split])).alias("r")).select("r.*")
        medians = {(r["c"], r["p"]): r["value"] for r in order_statistics(long, ["c", "p"], ["v"], [0.5]).collect()}  # a number for each population
        tails = {(r["channel"], r["fraction"]): r["value"] for r in order_statistics(beads, [], list(split), [0.0, 0.01, 0.99, 1.0]).collect()}
        for c in split:
            edge = 0.005 * (tails[c, 1.0] - tails[c, 0.0])
            pairs = [(medians[c, p], float(v)) for p, v in enumerate(known[c]) if v is not None and (c, p) in medians]
            pairs = [(m, v) for m, v in pairs if m > 0 and m < tails[c, 1.0] - edge and v >= 0]
            if len(pairs) < 3:
                error(c, counts[c], f"only {len(pairs)} populations lie within the range")
                continue
            m, b, auto = standard_curve(*map(np.array, zip(*pairs)))
            x = np.linspace(tails[c, 0.01], tails[c, 0.99], PLACES)
            y = np.where(x > 0, np.exp(b) * np.maximum(x, 1e-300) ** m, 0.0)
            rows += [(c, True, counts[c], m, b, auto, None, i, float(u), float(v)) for i, (u, v) in enumerate(zip(x, y))]
    order = {c: i for i, c in enumerate(wanted)}
    return spark.createDataFrame(sorted(rows, key=lambda r: (order[r[0]], r[7] or 0)), SCHEMA)


def in_molecules(events: DataFrame, curves: DataFrame, channels: Sequence[str], suffix: str = "_mef") -> DataFrame:
    """events with calibrated copies of channels: exp(offset) x^slope, 0 at 0 and below; a channel without a curve gives null."""
    fit = {r["channel"]: (r["slope"], r["offset"]) for r in curves.filter("ok AND place = 0").select("channel", "slope", "offset").collect()}  # a row for each channel
    new = {c + suffix: (F.when(F.col(c) > 0, F.exp(F.lit(fit[c][1])) * F.pow(F.col(c), F.lit(fit[c][0]))).otherwise(F.when(F.col(c).isNotNull(), F.lit(0.0))) if c in fit else F.lit(None).cast("double")) for c in channels}
    return events.withColumns(new)
