"""Workspace files (.wsp) of the kind in which nested gates, axis scales and compensation of many samples are exchanged.

read() makes a value of the file; its trees compile to column expressions, so counts of all populations of a sample come from one aggregation, and memberships from one
map-free pass. write() is its inverse: what is read again gives the same counts. Gates are rectangles and ranges (open ends too), polygons, ellipses, and populations that are
made of others (not, and, or). Limits of rectangles are data values. Polygons and ellipses lie in scaled space: vertices and events both pass the scale of their channel, as the
sides between vertices are straight there.

A gate of an unknown kind, or on a channel that the events lack, takes in nothing; a reference to an unknown population likewise; populations of one name under one parent keep the first.
"""

from __future__ import annotations

import math
import urllib.parse
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gateloom.functions.scales import Scale
from gateloom.operators.compensation import compensated
from gateloom.operators.gates import Gate, Population, chain, nodes, tree_counts

# fixed values: names of the published gating standard, which the files use
GATING = "http://www.isac-net.org/std/Gating-ML/v2.0/gating"
TYPES = "http://www.isac-net.org/std/Gating-ML/v2.0/datatypes"
TRANSFORMS = "http://www.isac-net.org/std/Gating-ML/v2.0/transformations"
PREFIX = "Comp-"


@dataclass(frozen=True)
class ScaledGate(Gate):
    """A polygon or an ellipse in scaled space; foci and distance describe an ellipse there: the sum of the distances to both foci is at most `angle`.

    xs, ys are data values (of a polygon's vertices, of an ellipse's foci in scaled space).
    """

    x_scale: Scale = field(default_factory=Scale)
    y_scale: Scale = field(default_factory=Scale)

    def column(self, channels: Iterable[str]) -> Column:
        have = set(channels)
        if self.x not in have or self.y not in have or len(self.xs) < (3 if self.kind == "polygon" else 2):
            return F.lit(self.invert)
        x, y = self.x_scale.column(F.col(self.x)), self.y_scale.column(F.col(self.y))
        if self.kind == "polygon":
            xs, ys = tuple(map(float, self.x_scale.of(self.xs))), tuple(map(float, self.y_scale.of(self.ys)))
            inside = Gate("polygon", self.x, self.y, xs, ys)._inside(x, y)
        else:
            far = [F.hypot(x - F.lit(a), y - F.lit(b)) for a, b in zip(self.xs, self.ys)]
            inside = far[0] + far[1] <= F.lit(self.angle)
        inside = F.coalesce(inside, F.lit(False)) & ~F.isnan(F.col(self.x)) & ~F.isnan(F.col(self.y))
        return ~inside if self.invert else inside


@dataclass(frozen=True)
class Box(Gate):
    """A rectangle or range: every dimension is (channel, least, most), infinite where it is open."""

    sides: tuple[tuple[str, float, float], ...] = ()

    def column(self, channels: Iterable[str]) -> Column:
        have, inside = set(channels), F.lit(bool(self.sides))
        for c, low, high in self.sides:
            if c not in have:
                return F.lit(self.invert)
            x = F.col(c)
            inside = inside & ~F.isnan(x) & x.isNotNull() & (x >= F.lit(low)) & (x < F.lit(high) if math.isfinite(high) else F.lit(True))
        inside = F.coalesce(inside, F.lit(False))
        return ~inside if self.invert else inside


@dataclass(frozen=True)
class Made(Gate):
    """kind not, and, or: of the populations at paths, each with its gates from the root on."""

    paths: tuple[str, ...] = ()
    chains: tuple[tuple[Gate, ...] | None, ...] = ()

    def column(self, channels: Iterable[str]) -> Column:
        have = list(channels)
        parts = [F.lit(False) if c is None else chain(c, have) for c in self.chains]
        if not parts:
            return F.lit(False)
        if self.kind == "not":
            return ~parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if self.kind == "and" else (out | p)
        return out


@dataclass(frozen=True)
class Sample:
    """A sample of a workspace: its file, scales by channel, compensation, trees, and the counts that the file states (by path)."""

    name: str
    uri: str = ""
    scales: Mapping[str, Scale] = field(default_factory=dict)
    spill_channels: tuple[str, ...] = ()
    spill: tuple[tuple[float, ...], ...] = ()
    trees: tuple[Population, ...] = ()
    counts: Mapping[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Workspace:
    samples: tuple[Sample, ...] = ()
    groups: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    def sample(self, name: str) -> Sample | None:
        return next((s for s in self.samples if s.name == name), None)


def tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def value(e: ET.Element, name: str, default: str | None = None) -> str | None:
    """An attribute, with or without a namespace."""
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), default)


def number(e: ET.Element, name: str, default: float) -> float:
    try:
        return float(value(e, name, ""))
    except ValueError:
        return default


def children(e: ET.Element, *names: str) -> list[ET.Element]:
    return [c for c in e if tag(c) in names]


def below(e: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in e.iter() if tag(c) == name]


def channel(e: ET.Element) -> str:
    """The channel of a dimension."""
    return next((value(c, "name", "") for c in e.iter() if tag(c) == "fcs-dimension"), "")


def scale_of(e: ET.Element) -> Scale | None:
    kind = tag(e)
    if kind == "linear":
        low, high = number(e, "minRange", 0.0), number(e, "maxRange", 262144.0)
        return Scale("linear", (low, high if high != low else low + 1))
    if kind == "log":
        return Scale("log", (max(number(e, "offset", 1.0), 1e-12), number(e, "decades", 4.5)))
    if kind == "fasinh":
        return Scale("asinh", (number(e, "T", number(e, "maxRange", 262144.0)), number(e, "M", 4.5), number(e, "A", 0.0)))
    if kind == "logicle":
        return Scale("logicle", (number(e, "T", 262144.0), number(e, "W", 0.5), number(e, "M", 4.5), number(e, "A", 0.0)))
    if kind == "biex":
        return Scale.biex(number(e, "maxRange", 262144.0), number(e, "width", -10.0), number(e, "pos", 4.5), number(e, "neg", 0.0))
    return None


def vertices(e: ET.Element) -> list[tuple[float, float]]:
    out = []
    for v in below(e, "vertex"):
        at = [number(c, "value", math.nan) for c in children(v, "coordinate")]
        if len(at) == 2:
            out.append((at[0], at[1]))
    return out


def gate_of(e: ET.Element, scales: Mapping[str, Scale]) -> Gate:
    """The gate of a Gate element."""
    for g in e:
        kind, names = tag(g), [channel(d) for d in children(g, "dimension")]
        invert = value(g, "eventsInside", "1") in ("0", "false")
        if kind == "RectangleGate":
            sides = tuple((channel(d), number(d, "min", -math.inf), number(d, "max", math.inf)) for d in children(g, "dimension"))
            return Box("box", names[0] if names else "", names[1] if len(names) > 1 else None, invert=invert, sides=sides)
        if kind in ("PolygonGate", "EllipsoidGate") and len(names) == 2:
            own = {"x_scale": scales.get(names[0], Scale()), "y_scale": scales.get(names[1], Scale())}
            if kind == "PolygonGate":
                points = vertices(g)
                return ScaledGate("polygon", *names, tuple(p[0] for p in points), tuple(p[1] for p in points), invert=invert, **own)
            foci = [p for f in children(g, "foci") for p in vertices(f)]
            return ScaledGate("ellipse", *names, tuple(p[0] for p in foci), tuple(p[1] for p in foci), number(g, "distance", 0.0), invert=invert, **own)
    return Box("box", "")


def trees_in(e: ET.Element, scales: Mapping[str, Scale]) -> tuple[tuple[Population, ...], dict[str, int]]:
    """The trees below a sample's node and the counts that it states."""
    counts: dict[str, int] = {}

    def build(at: ET.Element, path: tuple[str, ...]) -> tuple[Population, ...]:
        out: dict[str, Population] = {}
        for p in (p for s in children(at, "Subpopulations") for p in s):
            name = value(p, "name", "")
            if name in out or tag(p) not in ("Population", "NotNode", "AndNode", "OrNode"):
                continue
            if (n := value(p, "count", "")) and n.lstrip("-").isdigit() and int(n) >= 0:
                counts["/".join((*path, name))] = int(n)
            if tag(p) == "Population":
                gate = next((gate_of(g, scales) for g in children(p, "Gate")), Box("box", ""))
            else:
                gate = Made(tag(p).removesuffix("Node").lower(), "", paths=tuple(value(d, "name", "") for d in below(p, "Dependent")))
            out[name] = Population(name, gate, build(p, (*path, name)))
        return tuple(out.values())

    return resolved(build(e, ())), counts


def resolved(trees: Sequence[Population]) -> tuple[Population, ...]:
    """Trees whose made populations know the gates of those that they name; one that is made of itself, however indirectly, takes in nothing."""
    by_path = {"/".join(p): g for root in trees for p, g in root.walk()}

    def gates_at(path: str, seen: frozenset) -> tuple[Gate, ...] | None:
        if path not in by_path or path in seen:
            return None
        return tuple(known(g, seen | {path}) for g in by_path[path])

    def known(g: Gate, seen: frozenset) -> Gate:
        return Made(g.kind, "", paths=g.paths, chains=tuple(gates_at(p, seen) for p in g.paths)) if isinstance(g, Made) else g

    def rebuilt(p: Population, path: str) -> Population:
        here = f"{path}/{p.name}" if path else p.name
        return Population(p.name, known(p.gate, frozenset([here])), tuple(rebuilt(c, here) for c in p.children))

    return tuple(rebuilt(p, "") for p in trees)


def parsed(text: str) -> Workspace:
    """The workspace of a file's text."""
    root = ET.fromstring(text)
    samples, ids = [], {}
    for e in (s for at in below(root, "SampleList") for s in children(at, "Sample")):
        node = next(iter(children(e, "SampleNode")), None)
        data = next(iter(children(e, "DataSet")), None)
        uri = urllib.parse.unquote(value(data, "uri", "") or "") if data is not None else ""
        name = (value(node, "name") if node is not None else None) or uri.rsplit("/", 1)[-1]
        scales = {value(p, "name", ""): s for t in children(e, "Transformations") for x in t if (s := scale_of(x)) for p in below(x, "parameter")}
        matrix = next(iter(children(e, "spilloverMatrix")), None)
        rows = {value(r, "parameter", ""): {value(c, "parameter", ""): number(c, "value", 0.0) for c in children(r, "coefficient")} for r in (children(matrix, "spillover") if matrix is not None else [])}
        trees, counts = trees_in(node, scales) if node is not None else ((), {})
        ids[value(data, "sampleID", value(node, "sampleID", "") if node is not None else "") if data is not None else ""] = name
        samples.append(Sample(name, uri, scales, tuple(rows), tuple(tuple(r.get(c, 0.0) for c in rows) for r in rows.values()), trees, counts))
    groups = {value(g, "name", ""): tuple(ids[i] for r in below(g, "SampleRef") if (i := value(r, "sampleID", "")) in ids) for g in below(root, "GroupNode")}
    return Workspace(tuple(samples), groups)


def read(spark: SparkSession, path: str) -> Workspace:
    """The workspace in a file of any file system that Spark reads."""
    return parsed("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def written(workspace: Workspace) -> str:
    """The text of a workspace file."""
    for prefix, uri in (("gating", GATING), ("data-type", TYPES), ("transforms", TRANSFORMS)):
        ET.register_namespace(prefix, uri)
    g, t, x = (lambda n, u=u: f"{{{u}}}{n}" for u in (GATING, TYPES, TRANSFORMS))
    root = ET.Element("Workspace", {"version": "20.0"})
    ids = {s.name: str(i + 1) for i, s in enumerate(workspace.samples)}
    groups = ET.SubElement(root, "Groups")
    for name, members in ({"All Samples": tuple(ids)} | dict(workspace.groups)).items():
        at = ET.SubElement(ET.SubElement(ET.SubElement(groups, "GroupNode", {"name": name}), "Group", {"name": name}), "SampleRefs")
        for m in members:
            if m in ids:
                ET.SubElement(at, "SampleRef", {"sampleID": ids[m]})
    samples = ET.SubElement(root, "SampleList")

    def dimension(at: ET.Element, name: str, **limits: float) -> None:
        d = ET.SubElement(at, g("dimension"), {g(k): repr(float(v)) for k, v in limits.items() if math.isfinite(v)})
        ET.SubElement(d, t("fcs-dimension"), {t("name"): name})

    def vertex(at: ET.Element, a: float, b: float) -> None:
        v = ET.SubElement(at, g("vertex"))
        for c in (a, b):
            ET.SubElement(v, g("coordinate"), {t("value"): repr(float(c))})

    def gate(at: ET.Element, gate: Gate, ident: str) -> None:
        shape = lambda kind, **more: ET.SubElement(ET.SubElement(at, "Gate", {g("id"): ident}), g(kind), {"eventsInside": "0" if gate.invert else "1"} | {g(k): v for k, v in more.items()})
        if isinstance(gate, Box):
            e = shape("RectangleGate")
            for c, low, high in gate.sides:
                dimension(e, c, min=low, max=high)
        elif isinstance(gate, ScaledGate):
            e = shape("PolygonGate") if gate.kind == "polygon" else shape("EllipsoidGate", distance=repr(float(gate.angle)))
            dimension(e, gate.x)
            dimension(e, gate.y)
            to = e if gate.kind == "polygon" else ET.SubElement(e, g("foci"))
            for a, b in zip(gate.xs, gate.ys):
                vertex(to, a, b)
        else:
            raise ValueError(f"a {gate.kind} gate has no form in a workspace file; see portable()")

    def tree(at: ET.Element, found: Sequence[Population], ident: str, path: str, counts: Mapping[str, int]) -> None:
        if not found:
            return
        into = ET.SubElement(at, "Subpopulations")
        for i, p in enumerate(found):
            here, own = f"{path}/{p.name}" if path else p.name, f"{ident}.{i + 1}"
            said = {"name": p.name} | ({"count": str(counts[here])} if here in counts else {})
            if isinstance(p.gate, Made):
                e = ET.SubElement(into, f"{p.gate.kind.capitalize()}Node", said)
                names = ET.SubElement(e, "Dependents")
                for n in p.gate.paths:
                    ET.SubElement(names, "Dependent", {"name": n})
            else:
                e = ET.SubElement(into, "Population", said)
                gate(e, p.gate, own)
            tree(e, p.children, own, here, counts)

    kinds = {"linear": ("linear", ("minRange", "maxRange")), "log": ("log", ("offset", "decades")), "asinh": ("fasinh", ("T", "M", "A")), "logicle": ("logicle", ("T", "W", "M", "A"))}
    for s in workspace.samples:
        e = ET.SubElement(samples, "Sample")
        ET.SubElement(e, "DataSet", {"uri": urllib.parse.quote(s.uri, safe="/:"), "sampleID": ids[s.name]})
        if s.spill:
            m = ET.SubElement(e, x("spilloverMatrix"), {"prefix": PREFIX, "name": "matrix"})
            own = ET.SubElement(m, t("parameters"))
            for c in s.spill_channels:
                ET.SubElement(own, t("parameter"), {t("name"): c})
            for c, row in zip(s.spill_channels, s.spill):
                r = ET.SubElement(m, x("spillover"), {t("parameter"): c})
                for d, v in zip(s.spill_channels, row):
                    ET.SubElement(r, x("coefficient"), {t("parameter"): d, x("value"): repr(float(v))})
        own, scales = ET.SubElement(e, "Transformations"), dict(s.scales)
        for c, scale in ((c, scale) for _, _, gates in nodes(s.trees) for g in gates if isinstance(g, ScaledGate) for c, scale in ((g.x, g.x_scale), (g.y, g.y_scale))):
            if scales.setdefault(c, scale) != scale:
                raise ValueError(f"sample {s.name}: a file has one scale for {c}")
        for c, scale in scales.items():
            kind, names = kinds[scale.kind]
            ET.SubElement(ET.SubElement(own, x(kind), {x(n): repr(float(v)) for n, v in zip(names, scale.parameters)}), t("parameter"), {t("name"): c})
        node = ET.SubElement(e, "SampleNode", {"name": s.name, "sampleID": ids[s.name]})
        tree(node, s.trees, f"ID{ids[s.name]}", "", s.counts)
    ET.indent(root)
    return ET.tostring(root, encoding="unicode", xml_declaration=True)


def portable(trees: Sequence[Population], scales: Mapping[str, Scale] = {}) -> tuple[Population, ...]:
    """Trees of drawn gates in the kinds that a workspace file has: ranges and rectangles as boxes up to the next number after their upper limit, which is
    taken in here and not there; quadrants as open boxes; all others as polygons on the scales."""

    def one(gate: Gate) -> Gate:
        if isinstance(gate, (Box, ScaledGate, Made)):
            return gate
        after = lambda v: float(np.nextafter(v, math.inf))
        xs, ys = gate.xs, gate.ys
        if gate.kind in ("interval", "line"):
            return Box("box", gate.x, invert=gate.invert, sides=((gate.x, min(xs), after(max(xs))),))
        if gate.kind == "rectangle":
            return Box("box", gate.x, gate.y, invert=gate.invert, sides=((gate.x, min(xs), after(max(xs))), (gate.y, min(ys), after(max(ys)))))
        if gate.kind in ("q1", "q2", "q3", "q4") and len(xs) < 5:
            right, up = gate.kind in ("q1", "q4"), gate.kind in ("q1", "q2")
            return Box("box", gate.x, gate.y, invert=gate.invert, sides=((gate.x, xs[0], math.inf) if right else (gate.x, -math.inf, xs[0]), (gate.y, ys[0], math.inf) if up else (gate.y, -math.inf, ys[0])))
        if gate.kind == "index" or not xs or not gate.y:
            return Box("box", gate.x)
        p = gate.as_polygon()
        return ScaledGate("polygon", p.x, p.y, p.xs, p.ys, invert=gate.invert, x_scale=scales.get(p.x, Scale()), y_scale=scales.get(p.y, Scale()))

    return tuple(Population(p.name, one(p.gate), portable(p.children, scales)) for p in trees)


def same_trees(workspace: Workspace) -> list[tuple[list[str], Sample]]:
    """Names of samples that share trees and compensation, and one of them: each such set is one pass."""
    out: dict[tuple, tuple[list[str], Sample]] = {}
    for s in workspace.samples:
        if s.trees:
            out.setdefault((s.trees, s.spill_channels, s.spill), ([], s))[0].append(s.name)
    return list(out.values())


def sample_counts(events: DataFrame, workspace: Workspace, by: str = "sample") -> DataFrame:
    """by, population, parent, count, parent_count, total, pct_parent, pct_total of every sample by its own trees and compensation; samples without trees, and events of samples that the workspace lacks, have none."""
    found = [tree_counts(ready(events.filter(F.col(by).isin(names)), s), s.trees, by) for names, s in same_trees(workspace)]
    return reduce(DataFrame.unionByName, found) if found else tree_counts(events.limit(0), [Population("none", Box("box", ""))], by)


def ready(events: DataFrame, sample: Sample) -> DataFrame:
    """Events with the compensated channels that the sample's gates name: Comp-<channel> beside the channel."""
    if not sample.spill:
        return events
    own = compensated(events, list(sample.spill_channels), np.array(sample.spill), "_c")
    return own.withColumnsRenamed({f"{c}_c": f"{PREFIX}{c}" for c in sample.spill_channels})


def memberships(events: DataFrame, workspace: Workspace, by: str = "sample", row: str = "row_index") -> DataFrame:
    """by, population, row: the rows of every population, as an index table that joins with events by its keys."""
    out = [events.limit(0).select(by, F.lit("").alias("population"), row)]
    for names, s in same_trees(workspace):
        own = ready(events.filter(F.col(by).isin(names)), s)
        inside = F.array_compact(F.array(*[F.when(chain(gates, own.columns), F.lit(path)) for path, _, gates in nodes(s.trees)]))
        out.append(own.select(by, F.explode(inside).alias("population"), row))
    return reduce(DataFrame.unionAll, out)
