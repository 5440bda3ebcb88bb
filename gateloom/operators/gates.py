"""Gates, populations and trees of them; every geometric gate is one Catalyst expression.

A comparison with NaN is false, a missing x channel passes nothing, and a missing y channel counts as 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    """Geometry in raw data space. kind: rectangle, interval, line, ellipse, polygon, q1 to q4, index."""

    kind: str
    x: str
    y: str | None = None
    xs: tuple[float, ...] = ()
    ys: tuple[float, ...] = ()
    angle: float = 0.0
    invert: bool = False

    def column(self, channels: Iterable[str]) -> Column:
        """Membership of a row of a table with those channels."""
        have = set(channels)
        if self.x not in have or self.kind == "index":
            return F.lit(False)
        x = F.col(self.x)
        y = F.col(self.y) if self.y in have else F.lit(0.0)
        inside = F.coalesce(self._inside(x, y), F.lit(False)) & ~F.isnan(x) & ~F.isnan(y)
        return ~inside if self.invert else inside

    def _inside(self, x: Column, y: Column) -> Column:
        xs, ys = self.xs, self.ys
        if self.kind in ("interval", "line"):
            return x.between(min(xs), max(xs))
        if self.kind == "rectangle":
            return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
        if self.kind == "ellipse":
            rx, ry = (max(xs) - min(xs)) / 2, (max(ys) - min(ys)) / 2
            if rx == 0 or ry == 0:
                return F.lit(False)
            dx, dy = x - F.lit((min(xs) + max(xs)) / 2), y - F.lit((min(ys) + max(ys)) / 2)
            if self.angle:
                c, s = F.lit(math.cos(self.angle)), F.lit(math.sin(self.angle))
                dx, dy = dx * c + dy * s, dy * c - dx * s
            return (dx / F.lit(rx)) * (dx / F.lit(rx)) + (dy / F.lit(ry)) * (dy / F.lit(ry)) <= 1.0
        if self.kind == "polygon":
            crossed = F.lit(0)
            for (x0, y0), (x1, y1) in zip(zip(xs, ys), [(xs[-1], ys[-1]), *zip(xs[:-1], ys[:-1])]):
                if y0 != y1:  # a level edge is crossed by no ray
                    crossed += ((F.lit(y0) > y) != (F.lit(y1) > y)).cast("int") * (x < F.lit(x1 - x0) * (y - F.lit(y0)) / F.lit(y1 - y0) + F.lit(x0)).cast("int")
            return crossed % 2 == 1
        if self.kind in ("q1", "q2", "q3", "q4"):
            if len(xs) < 5:
                up, right = y >= ys[0], x >= xs[0]
                up_is = {"q1": (up, right), "q2": (up, ~right), "q3": (~up, ~right), "q4": (~up, right)}[self.kind]
                return up_is[0] & up_is[1]
            px, py = x - F.lit(xs[0]), y - F.lit(ys[0])
            first = F.lit(xs[1] - xs[0]) * py - F.lit(ys[1] - ys[0]) * px > 0
            second = F.lit(xs[3] - xs[0]) * py - F.lit(ys[3] - ys[0]) * px > 0
            return {"q1": first & ~second, "q2": first & second, "q3": ~first & second, "q4": ~first & ~second}[self.kind]
        return F.lit(False)

    def outline(self, points: int = 32) -> list[tuple[float, float]]:
        """Vertices of a polygon with the same extent: 4 for a rectangle, `points` for an ellipse."""
        if self.kind == "polygon":
            return list(zip(self.xs, self.ys))
        x0, x1, y0, y1 = min(self.xs), max(self.xs), min(self.ys or (0.0,)), max(self.ys or (0.0,))
        if self.kind == "ellipse":
            cx, cy, rx, ry = (x0 + x1) / 2, (y0 + y1) / 2, (x1 - x0) / 2, (y1 - y0) / 2
            c, s = math.cos(self.angle), math.sin(self.angle)
            turn = [2 * math.pi * i / points for i in range(points)]
            return [(cx + rx * math.cos(t) * c - ry * math.sin(t) * s, cy + rx * math.cos(t) * s + ry * math.sin(t) * c) for t in turn]
        return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]

    def as_polygon(self) -> Gate:
        pts = self.outline()
        return replace(self, kind="polygon", xs=tuple(p[0] for p in pts), ys=tuple(p[1] for p in pts), angle=0.0)

    def with_vertex(self, x: float | None = None, y: float | None = None) -> Gate:
        """A polygon with one more vertex: in the middle of the edge nearest to (x, y), or of the longest edge."""
        pts = list(zip(self.xs, self.ys))
        edges = [(a, b) for a, b in zip(pts, pts[1:] + pts[:1])]

        def far(edge) -> float:
            (ax, ay), (bx, by) = edge
            n = (bx - ax) ** 2 + (by - ay) ** 2
            t = 0.0 if n == 0 else max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n))
            return math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))

        k = min(range(len(edges)), key=lambda i: far(edges[i])) if x is not None and y is not None else max(range(len(edges)), key=lambda i: math.dist(*edges[i]))
        (ax, ay), (bx, by) = edges[k]
        pts.insert(k + 1, ((ax + bx) / 2, (ay + by) / 2))
        return replace(self, xs=tuple(p[0] for p in pts), ys=tuple(p[1] for p in pts))

    def moved(self, dx: float, dy: float, x_scale=None, y_scale=None) -> Gate:
        """Shifted in display space; each scale is (to display, from display), none for a linear axis."""
        shift = lambda v, d, s: v + d if s is None else s[1](s[0](v) + d)
        return replace(self, xs=tuple(shift(v, dx, x_scale) for v in self.xs), ys=tuple(shift(v, dy, y_scale) for v in self.ys))


def engine_chain(gates: Sequence[Gate], channels: Iterable[str]) -> Column:
    """A chain by the headless engine's rules, which differ from Gate.column(): ranges go from the first number to the last, all others are
    polygons, and a gate without its channels, with fewer than two numbers for a range or three vertices lets everything pass."""
    have, out = set(channels), F.lit(True)
    for g in gates:
        if g.x not in have:
            continue
        if g.kind.lower() in ("range", "h_range"):
            if len(g.xs) >= 2:
                out &= (F.col(g.x) >= F.lit(g.xs[0])) & (F.col(g.x) <= F.lit(g.xs[-1]))
        elif g.y in have and len(g.xs) >= 3:
            out &= replace(g, kind="polygon", invert=False).column(have)
    return out


def quadrants(x: str, y: str, cx: float, cy: float, prefix: str = "") -> list[Population]:
    """The four sibling populations that one drawn cross makes."""
    return [Population(f"{prefix} Q{i}".strip(), Gate(f"q{i}", x, y, (cx,), (cy,))) for i in (1, 2, 3, 4)]


@dataclass(frozen=True)
class Population:
    """A node of a gating tree: rows of its parent that its gate takes in."""

    name: str
    gate: Gate
    children: tuple[Population, ...] = field(default=())

    def walk(self, path: tuple[str, ...] = (), gates: tuple[Gate, ...] = ()) -> Iterator[tuple[tuple[str, ...], tuple[Gate, ...]]]:
        """(path, gates from the root on) of this node and all below it, depth first."""
        path, gates = (*path, self.name), (*gates, self.gate)
        yield path, gates
        for child in self.children:
            yield from child.walk(path, gates)

    # trees are values: each edit gives a new one
    def with_child(self, child: Population) -> Population:
        """child replaces a sibling of its name."""
        return replace(self, children=(*(c for c in self.children if c.name != child.name), child))

    def without(self, name: str) -> Population:
        return replace(self, children=tuple(c.without(name) for c in self.children if c.name != name))

    def renamed(self, old: str, new: str) -> Population:
        return replace(self, name=new if self.name == old else self.name, children=tuple(c.renamed(old, new) for c in self.children))

    def toggled(self, name: str) -> Population:
        """The named node's gate turned into its complement, or back."""
        gate = replace(self.gate, invert=not self.gate.invert) if self.name == name else self.gate
        return replace(self, gate=gate, children=tuple(c.toggled(name) for c in self.children))


class Edits:
    """Undo and redo over tree values, the last `most` kept."""

    def __init__(self, tree: tuple[Population, ...], most: int = 50):
        self.past, self.future, self.now, self.most = [], [], tree, most

    def set(self, tree: tuple[Population, ...]) -> None:
        self.past = [*self.past, self.now][-self.most :]
        self.now, self.future = tree, []

    def undo(self) -> None:
        if self.past:
            self.future.append(self.now)
            self.now = self.past.pop()

    def redo(self) -> None:
        if self.future:
            self.past.append(self.now)
            self.now = self.future.pop()


def copy_name(base: str, taken: Iterable[str]) -> str:
    """base copy, base copy 2, ...: the first that isn't taken."""
    used, k, name = set(taken), 1, f"{base} copy"
    while name in used:
        k += 1
        name = f"{base} copy {k}"
    return name


def chain(gates: Sequence[Gate], channels: Iterable[str]) -> Column:
    """Rows that all gates take in."""
    have, out = list(channels), F.lit(True)
    for g in gates:
        out = out & g.column(have)
    return out


def nodes(tree: Sequence[Population]) -> list[tuple[str, str | None, tuple[Gate, ...]]]:
    """(path, parent's path, gates) of all populations, depth first."""
    return [("/".join(p), "/".join(p[:-1]) or None, g) for root in tree for p, g in root.walk()]


def tree_counts(events: DataFrame, tree: Sequence[Population], by: str = "sample") -> DataFrame:
    """by, population, parent, count, parent_count, total, pct_parent, pct_total: all populations in one pass."""
    found = nodes(tree)
    where = {path: chain(gates, events.columns) for path, _, gates in found}
    flat = events.groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(where[path]).alias(f"c{i}") for i, (path, *_) in enumerate(found)])
    at = {path: i for i, (path, *_) in enumerate(found)}
    rows = [F.struct(F.lit(path).alias("population"), F.lit(parent or "root").alias("parent"), F.col(f"c{i}").alias("count"), (F.col(f"c{at[parent]}") if parent else F.col("n")).alias("parent_count"), F.col("n").alias("total")) for i, (path, parent, _) in enumerate(found)]
    out = flat.select(by, F.explode(F.array(*rows)).alias("r")).select(by, "r.*")
    return out.withColumn("pct_parent", percent("count", "parent_count")).withColumn("pct_total", percent("count", "total"))


def percent(part: str, whole: str, digits: int = 6) -> Column:
    """100 part / whole; 0 where there is nothing to divide by."""
    return F.when(F.col(whole) > 0, F.round(F.lit(100.0) * F.col(part) / F.col(whole), digits)).otherwise(F.lit(0.0))


def population(events: DataFrame, gates: Sequence[Gate]) -> DataFrame:
    return events.where(chain(gates, events.columns))


def members(events: DataFrame, index: DataFrame, keys: Sequence[str] = ("sample", "row_index")) -> DataFrame:
    """Rows whose keys an index population lists. The index is hashed in its tasks; events stream past it unsorted."""
    return events.join(index.hint("shuffle_hash"), list(keys), "left_semi")


def rule(clauses: Sequence[tuple[str, bool]], thresholds: dict[str, float], channels: Iterable[str]) -> Column:
    """All clauses hold: (channel, positive); positive is strictly above the threshold. Nothing if there is none, or one can't be judged."""
    have = set(channels)
    if not clauses or any(c not in have or c not in thresholds for c, _ in clauses):
        return F.lit(False)
    out = F.lit(True)
    for c, positive in clauses:
        above = F.col(c) > thresholds[c]
        out = out & (above if positive else ~above)
    return F.coalesce(out, F.lit(False))


def first_match(rules: Sequence[Column]) -> Column:
    """The number of the first rule that holds, else -1."""
    out = F.lit(-1)
    for i in reversed(range(len(rules))):
        out = F.when(rules[i], i).otherwise(out)
    return out
