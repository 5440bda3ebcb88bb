"""Sessions on disk: workspace files, gate trees as rows, standard gate files, tables as delimited text, plugins."""

from __future__ import annotations

import json
import os
import xml.etree.ElementTree as ET
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gateloom.functions.scalars import as_text
from gateloom.operators.gates import Gate, Population


@dataclass(frozen=True)
class Session:
    """An experiment as a value: files, compensation, transforms, trees by sample, groups, audit log. Each change gives a new one."""

    name: str = ""
    files: tuple[str, ...] = ()
    spill_channels: tuple[str, ...] = ()
    spill: tuple[tuple[float, ...], ...] = ()
    compensated: bool = False
    transforms: Mapping[str, tuple[str, float]] = field(default_factory=dict)
    trees: Mapping[str, tuple[Population, ...]] = field(default_factory=dict)
    groups: Mapping[str, str] = field(default_factory=dict)
    audit: tuple[dict, ...] = ()

    def loaded(self, files: Sequence[str]) -> Session:
        """Other files: gates, compensation and transforms of the old ones go."""
        return Session(name=self.name, files=tuple(files))

    def with_transform(self, channels: Sequence[str], method: str = "logicle", cofactor: float = 150.0) -> Session:
        if method not in ("logicle", "arcsinh", "log", "none"):
            raise ValueError(f"unknown transform {method}")
        return replace(self, transforms=dict(self.transforms) | {c: (method, max(1e-9, cofactor)) for c in channels})

    def with_spill(self, channels: Sequence[str], matrix: Sequence[Sequence[float]]) -> Session:
        return replace(self, spill_channels=tuple(channels), spill=tuple(map(tuple, matrix)))

    def common_transform(self, channels: Sequence[str]) -> tuple[str, float]:
        """The method of most channels and the first cofactor; arcsinh with 150 if none is set."""
        own = [self.transforms[c] for c in channels if c in self.transforms]
        if not own:
            return "arcsinh", 150.0
        methods = [m for m, _ in own]
        return max(dict.fromkeys(methods), key=methods.count), own[0][1]

    def gate_everywhere(self, population: Population, samples: Sequence[str]) -> Session:
        """population under the root of every sample, in place of one of its name."""
        trees = {s: (*(p for p in self.trees.get(s, ()) if p.name != population.name), population) for s in samples}
        return replace(self, trees=dict(self.trees) | trees)

    def logged(self, time: str, kind: str, sample: str, detail: str) -> Session:
        return replace(self, audit=(*self.audit, {"time": time, "type": kind, "sample": sample, "detail": detail}))


def tree_rows(trees: Mapping[str, Sequence[Population]]) -> list[dict]:
    """Gates as rows: ids G1.. depth first, no parent_id at the root; all of a gate's geometry, exclusion too."""
    out: list[dict] = []

    def walk(sample: str, nodes: Sequence[Population], parent: str | None) -> None:
        for p in nodes:
            g, own = p.gate, f"G{len(out) + 1}"
            out.append({"sample": sample, "id": own, "name": p.name, "type": g.kind, "x_channel": g.x, "y_channel": g.y, "xs": list(g.xs), "ys": list(g.ys), "angle": g.angle, "invert": g.invert} | ({"parent_id": parent} if parent else {}))
            walk(sample, p.children, own)

    for sample, nodes in trees.items():
        walk(sample, nodes, None)
    return out


def trees_of(rows: Sequence[Mapping]) -> dict[str, tuple[Population, ...]]:
    """Trees from rows in any order: an unknown parent is the root, of siblings of one name the first stays."""
    known = {(r["sample"], r["id"]) for r in rows}

    def build(sample: str, parent: str | None) -> tuple[Population, ...]:
        out: dict[str, Population] = {}
        for r in rows:
            own = r.get("parent_id") if (sample, r.get("parent_id")) in known else None
            if r["sample"] == sample and own == parent and r["name"] not in out:
                gate = Gate(r["type"], r["x_channel"], r.get("y_channel"), tuple(r.get("xs") or ()), tuple(r.get("ys") or ()), r.get("angle") or 0.0, bool(r.get("invert")))
                out[r["name"]] = Population(r["name"], gate, build(sample, r["id"]))
        return tuple(out.values())

    return {s: build(s, None) for s in dict.fromkeys(r["sample"] for r in rows)}


def save(session: Session, path: str) -> dict:
    """Writes a workspace file; what was saved."""
    gates = tree_rows(session.trees)
    body = {"version": 1, "experiment": session.name, "files": list(session.files), "comp_applied": session.compensated, "comp_matrix": {"channels": list(session.spill_channels), "matrix": [list(r) for r in session.spill]} if session.spill else None, "transforms": {k: {"method": m, "cofactor": c} for k, (m, c) in session.transforms.items()}, "gates": gates, "audit_log": list(session.audit), "groups": dict(session.groups)}
    part = f"{path}.part"
    with open(part, "w") as f:
        json.dump(body, f)
    os.replace(part, path)
    return {"file": path, "n_samples": len(session.files), "n_gates": len(gates)}


def load(path: str) -> tuple[Session, int]:
    """A session, and the number of files that are gone."""
    with open(path) as f:
        b = json.load(f)
    files = [f for f in b.get("files", []) if os.path.exists(f)]
    comp = b.get("comp_matrix") or {"channels": [], "matrix": []}
    out = Session(b.get("experiment", ""), tuple(files), tuple(comp["channels"]), tuple(map(tuple, comp["matrix"])), bool(b.get("comp_applied")), {k: (v["method"], v["cofactor"]) for k, v in b.get("transforms", {}).items()}, trees_of(b.get("gates", [])), b.get("groups", {}), tuple(b.get("audit_log", [])))
    return out, len(b.get("files", [])) - len(files)


GATING = "http://www.isac-net.org/std/Gating-ML/v2.0/gating"
TYPES = "http://www.isac-net.org/std/Gating-ML/v2.0/datatypes"


def gating_xml(trees: Mapping[str, Sequence[Population]]) -> str:
    """Gates in the published XML form: intervals and rectangles as RectangleGate, all others as PolygonGate; gates without geometry are left out."""
    ET.register_namespace("gating", GATING)
    ET.register_namespace("data-type", TYPES)
    root = ET.Element(f"{{{GATING}}}Gating-ML")

    def dimension(at: ET.Element, name: str, low: float | None = None, high: float | None = None) -> None:
        limits = {f"{{{GATING}}}{k}": repr(float(v)) for k, v in (("min", low), ("max", high)) if v is not None}
        d = ET.SubElement(at, f"{{{GATING}}}dimension", limits | {f"{{{GATING}}}compensation-ref": "uncompensated"})
        ET.SubElement(d, f"{{{TYPES}}}fcs-dimension", {f"{{{TYPES}}}name": name})

    for r in tree_rows(trees):
        g = Gate(r["type"], r["x_channel"], r["y_channel"], tuple(r["xs"]), tuple(r["ys"]), r["angle"])
        if not g.xs or g.kind == "index" or g.kind.startswith("q"):
            continue
        inside = {f"{{{GATING}}}eventsInside": "false" if r["invert"] else "true"}
        ident = {f"{{{GATING}}}id": f"{r['sample']}_{r['id']}", f"{{{GATING}}}name": r["name"]} | inside | ({f"{{{GATING}}}parent_id": f"{r['sample']}_{r['parent_id']}"} if "parent_id" in r else {})
        if g.kind in ("interval", "line", "rectangle"):
            e = ET.SubElement(root, f"{{{GATING}}}RectangleGate", ident)
            dimension(e, g.x, min(g.xs), max(g.xs))
            if g.kind == "rectangle" and g.y:
                dimension(e, g.y, min(g.ys), max(g.ys))
        else:
            e = ET.SubElement(root, f"{{{GATING}}}PolygonGate", ident)
            dimension(e, g.x)
            dimension(e, g.y or "")
            for x, y in g.outline():
                v = ET.SubElement(e, f"{{{GATING}}}vertex")
                for c in (x, y):
                    ET.SubElement(v, f"{{{GATING}}}coordinate", {f"{{{TYPES}}}value": repr(float(c))})
    return ET.tostring(root, encoding="unicode", xml_declaration=True)


def write_table(df: DataFrame, path: str, sep: str = ",", quote_all: bool = False) -> None:
    """Delimited text with a header; quotes only where they are needed, nothing for no value."""
    df.write.option("header", True).option("sep", sep).option("quoteAll", str(quote_all).lower()).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


@dataclass(frozen=True)
class Plugin:
    """A described extension: what it needs, its parameters and what it gives."""

    id: str
    name: str
    entry: str
    requires: tuple[str, ...] = ()
    params: tuple[dict, ...] = ()
    outputs: tuple[str, ...] = ()

    def arguments(self, given: Mapping) -> dict:
        """Defaults filled in; ValueError for an unknown name or a value out of range."""
        if unknown := set(given) - {p["name"] for p in self.params}:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        out = {p["name"]: given.get(p["name"], p.get("default")) for p in self.params}
        for p in self.params:
            v = out[p["name"]]
            if v is not None and (("min" in p and v < p["min"]) or ("max" in p and v > p["max"])):
                raise ValueError(f"{p['name']} is out of range")
        return out


def plugins(folder: str) -> list[Plugin]:
    """Plugins of the subfolders with a plugin.json, by name; malformed ones are skipped."""
    out = []
    for d in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        try:
            with open(os.path.join(folder, d, "plugin.json")) as f:
                m = json.load(f)
            out.append(Plugin(m["id"], m.get("name", m["id"]), m["entry"], tuple(m.get("requires", [])), tuple(m.get("params", [])), tuple(m.get("outputs", []))))
        except (OSError, ValueError, KeyError, TypeError, AttributeError):
            continue
    return sorted(out, key=lambda p: p.name.lower())


def run_on_samples(events: DataFrame, f: Callable, schema: str, by: str = "sample") -> DataFrame:
    """f(pandas frame) on each sample; a failure gives a row with ok false and the error, the others go on. f's columns follow schema."""
    from pyspark.sql.types import StructType

    names = [c.name for c in StructType.fromDDL(schema).fields]

    def run(key, pdf):
        import pandas as pd

        try:
            out = f(pdf).assign(**{by: key[0], "ok": True, "error": None})
        except Exception as e:  # noqa: BLE001  a plugin may fail in any way
            out = pd.DataFrame([{by: key[0], "ok": False, "error": str(e)} | dict.fromkeys(names)])
        return out[[by, "ok", "error", *names]]

    return events.groupBy(by).applyInPandas(run, f"{by} string, ok boolean, error string, {schema}")


COMMANDS: dict[str, Callable] = {}


def command(name: str):
    """Registers a command: f(session, arguments)."""

    def add(f: Callable) -> Callable:
        COMMANDS[name] = f
        return f

    return add


def call(name: str, session: Session, arguments: Mapping | None = None):
    if name not in COMMANDS:
        raise ValueError(f"unknown command: {name}")
    return COMMANDS[name](session, dict(arguments or {}))


@command("ping")
def _ping(session: Session, arguments: dict) -> dict:
    return {"pong": True}


@command("echo")
def _echo(session: Session, arguments: dict) -> dict:
    return arguments


@command("capabilities")
def _capabilities(session: Session, arguments: dict) -> dict:
    return {"commands": sorted(COMMANDS)}


@command("import_files")
def _import(session: Session, arguments: dict) -> Session:
    return replace(session, files=(*session.files, *(f for f in arguments["files"] if f not in session.files)))


@command("get_state")
def _state(session: Session, arguments: dict) -> dict:
    return {"experiment": session.name, "samples": [os.path.basename(f) for f in session.files], "n_gates": len(tree_rows(session.trees)), "compensated": session.compensated}


@command("set_experiment_name")
def _named(session: Session, arguments: dict) -> Session:
    return replace(session, name=str(arguments.get("name", "")))


@command("reset")
def _reset(session: Session, arguments: dict) -> Session:
    return Session()


@command("set_spillover")
def _spill(session: Session, arguments: dict) -> Session:
    return session.with_spill(arguments["channels"], arguments["matrix"])


@command("apply_transformation")
def _transform(session: Session, arguments: dict) -> Session:
    return session.with_transform(arguments["channels"], arguments.get("method", "logicle"), arguments.get("cofactor", 150.0))


@command("save_workspace")
def _save(session: Session, arguments: dict) -> dict:
    return save(session, arguments["file"])


@command("load_workspace")
def _load(session: Session, arguments: dict) -> Session:
    return load(arguments["file"])[0]


@command("save_gatingml")
def _gates(session: Session, arguments: dict) -> dict:
    with open(arguments["file"], "w") as f:
        f.write(gating_xml(session.trees))
    return {"file": arguments["file"], "n_gates": len(tree_rows(session.trees))}


def audit_table(spark: SparkSession, session: Session) -> DataFrame:
    return spark.createDataFrame([(a["time"], a["type"], a["sample"], a["detail"]) for a in session.audit], "time string, type string, sample string, detail string")


def methods_text(session: Session, most_gates: int = 8, most_analyses: int = 5) -> str:
    """A paragraph on what was done: counts by type, the first distinct gates and analyses."""
    kinds: dict[str, int] = {}
    for a in session.audit:
        kinds[a["type"]] = kinds.get(a["type"], 0) + 1
    gates = list(dict.fromkeys(a["detail"] for a in session.audit if a["type"] == "GATE"))[:most_gates]
    done = list(dict.fromkeys(a["detail"] for a in session.audit if a["type"] == "ANALYSIS"))[:most_analyses]
    parts = [f"{len(session.files)} samples were analysed."]
    if kinds:
        parts.append("Actions: " + ", ".join(f"{n} {k.lower()}" for k, n in sorted(kinds.items())) + ".")
    parts += [f"Gates: {'; '.join(gates)}."] * bool(gates) + [f"Analyses: {'; '.join(done)}."] * bool(done)
    return " ".join(parts)


def label_of(channel: Column, aliases: Mapping[str, str]) -> Column:
    """The marker that a channel is mapped to, else its own name."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[channel], channel) if aliases else channel


def gating_methods(counts: DataFrame, tree: Sequence[Population], aliases: Mapping[str, str] | None = None) -> DataFrame:
    """text: one row, a paragraph on a tree of populations. counts is a tree_counts() table; shares are of the parent, mean and SD over samples."""
    names = dict(aliases or {})
    nodes = [(i, "/".join(path), path[-1], gates[-1].kind, " and ".join(names.get(c, c) for c in (gates[-1].x, gates[-1].y) if c), path[-2] if len(path) > 1 else "the sample") for i, (path, gates) in enumerate(n for p in tree for n in p.walk())]
    share = F.col("count") * 100.0 / F.col("parent_count")
    stat = counts.where("parent_count > 0").groupBy("population").agg(F.avg(share).alias("m"), F.coalesce(F.stddev_samp(share), F.lit(0.0)).alias("sd"), F.count("*").alias("n"))
    rows = counts.sparkSession.createDataFrame(nodes, "i int, population string, name string, kind string, axes string, parent string").join(stat, "population", "left")
    part = F.format_string("%s is a %s on %s and held %s%% of %s (SD %s, samples: %d)", "name", "kind", "axes", as_text(F.coalesce("m", F.lit(0.0)), "%.1f"), "parent", as_text(F.coalesce("sd", F.lit(0.0)), "%.1f"), F.coalesce("n", F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", part.alias("t")))), lambda x: x["t"]), ". ")
    return rows.agg(F.concat(F.lit("Gates, from the outermost in. "), text, F.lit(". Each percentage is averaged over the samples in which the enclosing population has events.")).alias("text"))
