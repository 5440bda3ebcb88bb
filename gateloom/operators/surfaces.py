"""Smoothed density surfaces on a grid, and how well gates' edges lie on them; the counts come from Spark, the grid is small."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateloom.core.order import joined
from gateloom.operators.gates import Gate
from gateloom.operators.histograms import display_bin

#: Cells of a side.
CELLS = 128


class Surface:
    """Blurred counts of two channels on CELLS x CELLS cells over their ranges."""

    def __init__(self, counts: np.ndarray, x: tuple[float, float], y: tuple[float, float]):
        self.grid, self.x, self.y = counts, x, y
        self.top = float(counts.max(initial=0))

    def cell(self, x: float, y: float) -> tuple[float, float]:
        n = len(self.grid) - 1
        return (x - self.x[0]) / (self.x[1] - self.x[0]) * n, (y - self.y[0]) / (self.y[1] - self.y[0]) * n

    def at(self, cx: float, cy: float) -> float:
        """Density between cells, bilinear; 0 outside."""
        n = len(self.grid)
        if not (0 <= cx <= n - 1 and 0 <= cy <= n - 1):
            return 0.0
        i, j = min(int(cx), n - 2), min(int(cy), n - 2)
        u, v = cx - i, cy - j
        g = self.grid
        return float((1 - v) * ((1 - u) * g[j, i] + u * g[j, i + 1]) + v * ((1 - u) * g[j + 1, i] + u * g[j + 1, i + 1]))


def blurred(counts: np.ndarray, radius: int = 3) -> np.ndarray:
    """A separable Gaussian of sigma = radius; beyond the edges the edge goes on."""
    k = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2.0 * radius * radius))
    k /= k.sum()
    for axis in (0, 1):
        pad = np.pad(counts.astype(float), [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], "edge")
        counts = sum(w * np.take(pad, np.arange(counts.shape[axis]) + i, axis) for i, w in enumerate(k))
    return counts


def surface(events: DataFrame, x: str, y: str, radius: int = 3) -> Surface:
    """At most CELLS x CELLS rows come to the driver."""
    x0, x1, y0, y1 = events.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if x0 is None or x1 <= x0 or y1 <= y0:
        return Surface(np.zeros((CELLS, CELLS)), (0.0, 1.0), (0.0, 1.0))
    cells = events.groupBy(display_bin(F.col(x), F.lit(x0), F.lit(x1), CELLS).alias("i"), display_bin(F.col(y), F.lit(y0), F.lit(y1), CELLS).alias("j")).count().where("i is not null and j is not null")
    counts = np.zeros((CELLS, CELLS))
    for r in cells.collect():
        counts[r["j"], r["i"]] = r["count"]
    return Surface(blurred(counts, radius), (x0, x1), (y0, y1))


def boundary(gate: Gate, per_edge: int = 64) -> list[tuple[float, float]]:
    """Points along a gate's edges."""
    pts = gate.outline()
    return [(ax + (bx - ax) * i / per_edge, ay + (by - ay) * i / per_edge) for (ax, ay), (bx, by) in zip(pts, pts[1:] + pts[:1]) for i in range(per_edge)]


def boundary_confidence(s: Surface, gate: Gate) -> float | None:
    """Mean density under a gate's edge over the greatest; none for gates without a closed edge."""
    if gate.kind not in ("rectangle", "ellipse", "polygon") or s.top <= 0:
        return None
    n, found = len(s.grid), []
    for x, y in boundary(gate):
        cx, cy = s.cell(x, y)
        if 0 <= cx < n and 0 <= cy < n:
            found.append(s.grid[int(cy), int(cx)])
    return float(np.mean(found)) / s.top if found else None


def edge_confidence(s: Surface, gate: Gate, inward: float = 4.0) -> list[tuple[int, str]]:
    """Each edge's verdict by how much denser it is some cells towards the gate's middle: good, flat or through (a population)."""
    pts = [s.cell(x, y) for x, y in gate.outline()]
    cx, cy = np.mean([p[0] for p in pts]), np.mean([p[1] for p in pts])
    out = []
    for i, ((ax, ay), (bx, by)) in enumerate(zip(pts, pts[1:] + pts[:1])):
        length = float(np.hypot(bx - ax, by - ay))
        if length < 1e-6 or s.top <= 0:
            out.append((i, "flat"))
            continue
        mx, my, nx, ny = (ax + bx) / 2, (ay + by) / 2, (ay - by) / length, (bx - ax) / length
        if nx * (cx - mx) + ny * (cy - my) < 0:
            nx, ny = -nx, -ny
        rise = (s.at(mx + inward * nx, my + inward * ny) - s.at(mx, my)) / s.top
        out.append((i, "good" if rise > 0.08 else "flat" if rise > -0.04 else "through"))
    return out


def valleys(y: Sequence[float], least_peak: float = 0.05, depth: float = 0.85) -> list[int]:
    """Bins of the lowest places between peaks of at least least_peak of the highest, where they lie below depth of the lower flank."""
    y = np.asarray(y, float)
    peaks = [i for i in range(1, len(y) - 1) if y[i] > y[i - 1] and y[i] >= y[i + 1] and y[i] > least_peak * y.max()]
    out = []
    for a, b in zip(peaks, peaks[1:]):
        k = a + int(y[a : b + 1].argmin())
        if y[k] < depth * min(y[a], y[b]):
            out.append(k)
    return out


def outline(points: np.ndarray, concavity: float = 2.0) -> list[tuple[float, float]]:
    """The convex hull drawn in: an edge longer than concavity x the median edge goes by way of an inner point near it, while there is one."""
    from gateloom.operators.models import hull

    shape = hull(points)
    if concavity <= 0 or len(shape) < 4:
        return shape
    far = lambda a, b: float(np.hypot(a[0] - b[0], a[1] - b[1]))
    limit = concavity * sorted(far(a, b) for a, b in zip(shape, shape[1:] + shape[:1]))[len(shape) // 2]
    free = np.array([p for p in set(map(tuple, np.asarray(points, float).tolist())) if p not in set(shape)], float).reshape(-1, 2)
    edges = list(zip(shape, shape[1:] + shape[:1]))
    done: list[tuple[float, float]] = []
    while edges:  # each step settles an edge, or spends an inner point
        a, b = edges.pop(0)
        length = far(a, b)
        if length > limit and len(free):
            da, db = np.hypot(*(free - a).T), np.hypot(*(free - b).T)
            way = np.where((da < length) & (db < length) & (da + db < 1.8 * length), da + db, np.inf)
            k = int(way.argmin())
            if np.isfinite(way[k]):
                c = tuple(free[k].tolist())
                free = np.delete(free, k, axis=0)
                edges[:0] = [(a, c), (c, b)]
                continue
        done.append(a)
    return done


def outlines(df: DataFrame, by: Sequence[str], x: str, y: str, cells: int = 64, concavity: float = 2.0) -> DataFrame:
    """by, i, x, y: outline() of each group, of all its points.

    The hull of a group is that of its batches' hulls; of the points within, one for each cell of a grid over the group's ranges stays, so a group ends as a few thousand points whatever its size.
    Points with a null or NaN are left out.
    """
    keys = list(by)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)
    own = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter(~(F.isnull("x") | F.isnull("y") | F.isnan("x") | F.isnan("y")))
    ends = own.groupBy(*keys).agg(*[f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("a", F.min), ("b", F.max))])
    cell = lambda c: F.when(F.col(f"b{c}") > F.col(f"a{c}"), F.floor((F.col(c) - F.col(f"a{c}")) / (F.col(f"b{c}") - F.col(f"a{c}")) * cells)).otherwise(F.lit(0))
    inner = joined(own, ends, keys).groupBy(*keys, cell("x").alias("cx"), cell("y").alias("cy")).agg(F.min_by(F.struct("x", "y"), F.xxhash64("x", "y")).alias("p")).select(*keys, "p.x", "p.y")

    def table(like, key: Sequence, points: Sequence[tuple[float, float]]):
        return type(like)({k: [v] * len(points) for k, v in zip(keys, key)} | {"x": [p[0] for p in points], "y": [p[1] for p in points]})

    def hulls(batches):
        from gateloom.operators.models import hull

        for b in batches:
            for key, part in b.groupby(keys, dropna=False, sort=False) if keys else [((), b)]:
                yield table(b, [None if k != k else k for k in key], hull(part[["x", "y"]].to_numpy(float)))

    def drawn(part):
        out = table(part, [part[k].iloc[0] for k in keys], outline(part[["x", "y"]].to_numpy(float), concavity))
        out.insert(len(keys), "i", range(len(out)))
        return out

    rim = own.mapInPandas(hulls, f"{kinds}{', ' * bool(keys)}x double, y double")
    return rim.unionAll(inner).groupBy(*keys).applyInPandas(drawn, f"{kinds}{', ' * bool(keys)}i int, x double, y double")
