"""An experiment that is worked by named commands: files and a session, and tables that Spark works out when they are asked for.

    e = Engine(spark)
    e.run("load_fcs", {"folder": "/data"})
    e.run("add_gate", {"sample": "s1", "name": "Cells", "type": "rectangle", "x_channel": "FSC-A", "y_channel": "SSC-A", "xs": [1, 9], "ys": [1, 9]})
    e.run("gate_tree_stats").show()

A command returns a table, or a few values in a dict. Commands on sessions alone (workspace.COMMANDS) are there too; those that give a new session set it. Row caps are parameters (n): none
is set unless it is asked for, and statistics are over all rows.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateloom.functions.scalars import asinh
from gateloom.operators import analysis, bayes, beads, compensation, embedding, gates, histograms, models, statistics, umap
from gateloom.operators.gates import Gate, Population
from gateloom.sources import fcs, workspace, wsp

VERSION = "3"
#: Names of channels that no method takes unless it is told to.
NO_FEATURE = re.compile("FSC|SSC|Time|Width|Event", re.I)


class Engine:
    """spark, session, and events: sample, row_index and channels of all loaded files."""

    def __init__(self, spark: SparkSession, events: DataFrame | None = None, session: workspace.Session | None = None):
        self.spark, self.raw, self.session = spark, events, session or workspace.Session()
        self.mode, self.layout, self.features = "standard", None, []

    def run(self, name: str, arguments: Mapping | None = None):
        if name in ENGINE:
            return ENGINE[name](self, dict(arguments or {}))
        out = workspace.call(name, self.session, arguments)
        if isinstance(out, workspace.Session):
            self.session = out
            return {"ok": True}
        return out

    def channels(self) -> list[str]:
        return [c for c in self.all().columns if c not in ("sample", "row_index")]

    def colours(self) -> list[str]:
        return [c for c in self.channels() if not NO_FEATURE.search(c)]

    def all(self) -> DataFrame:
        if self.raw is None:
            raise ValueError("load files first")
        return self.raw

    def events(self, a: Mapping | None = None) -> DataFrame:
        """Events as the session has them: compensated if it is; of a sample, if one is named."""
        ev, s = self.all(), self.session
        if s.compensated and s.spill:
            ev = (compensation.compensated if self.mode == "standard" else compensation.compensated_nonnegative)(ev, list(s.spill_channels), s.spill)
        if a and a.get("sample") is not None:
            ev = ev.filter(F.col("sample") == a["sample"])
        return ev

    def samples(self) -> list[str]:
        return [r["sample"] for r in self.all().select("sample").distinct().orderBy("sample").collect()]

    def wanted(self, a: Mapping) -> list[str]:
        names = [c for c in a.get("features") or a.get("channels") or self.colours() if c not in set(a.get("exclude") or ())]
        if missing := [c for c in names if c not in self.channels()]:
            raise ValueError("no such channel: " + ", ".join(missing))
        if not names:
            raise ValueError("no channel is left")
        return names

    def gated(self, a: Mapping) -> DataFrame:
        """Events of a sample, within a population if one is named by its path."""
        ev = self.events(a)
        if not a.get("population"):
            return ev
        for tree in self.session.trees.values():
            for path, _, found in gates.nodes(tree):
                if path == a["population"]:
                    return gates.population(ev, found)
        raise ValueError(f"no population {a['population']}")

    def scaled(self, ev: DataFrame, names: Sequence[str]) -> DataFrame:
        """Channels as the session's transforms show them: arcsinh, log, logicle or none."""
        from gateloom.functions.scales import Scale

        own = {c: self.session.transforms.get(c, ("arcsinh", 150.0)) for c in names}
        shapes = {"arcsinh": lambda x, f: asinh(x, f), "log": lambda x, f: F.log10(F.greatest(x, F.lit(1.0))), "logicle": lambda x, f: Scale("logicle", (262144.0, 0.5, 4.5, 0.0)).column(x), "none": lambda x, f: x}
        return ev.withColumns({c: shapes[m](F.col(c), f) for c, (m, f) in own.items()})


ENGINE: dict[str, Callable] = {}


def command(name: str):
    def add(f: Callable) -> Callable:
        ENGINE[name] = f
        return f

    return add


# ---- of the engine itself ----


@command("version")
def _version(e: Engine, a: dict) -> dict:
    return {"version": VERSION, "engine": "spark " + e.spark.version}


@command("capabilities")
def _capabilities(e: Engine, a: dict) -> dict:
    return {"commands": sorted({*ENGINE, *workspace.COMMANDS})}


@command("sleep")
def _sleep(e: Engine, a: dict) -> dict:
    began, steps = time.monotonic(), int(a.get("steps", 10))
    for i in range(steps):
        time.sleep(a.get("step_ms", 200) / 1000)
        if a.get("progress"):
            a["progress"]((i + 1) / steps)
    return {"slept_ms": round((time.monotonic() - began) * 1000)}


@command("boom")
def _boom(e: Engine, a: dict) -> dict:
    raise RuntimeError("asked to fail")


@command("noisy")
def _noisy(e: Engine, a: dict) -> dict:
    print("a line that is no answer")
    return {"noisy": True}


# ---- files and channels ----


@command("load_fcs")
def _load(e: Engine, a: dict) -> DataFrame:
    """The report of the files read; bad ones are left out. Gates, compensation and transforms of files loaded before go."""
    e.spark.dataSource.register(fcs.FcsSource)
    paths = [a["folder"]] if "folder" in a else list(a["files"])
    read = lambda p, what: e.spark.read.format("fcs").option("recursive", str(bool(a.get("recursive"))).lower()).option("onBad", "skip").option("what", what).load(p)
    e.raw = reduce(DataFrame.unionByName, [read(p, "events") for p in paths])
    report = reduce(DataFrame.unionByName, [read(p, "files") for p in paths])
    e.session = e.session.loaded([r["path"] for r in report.filter("error IS NULL").select("path").orderBy("path").collect()])
    e.layout = None
    return report


@command("list_channels")
def _channels(e: Engine, a: dict) -> dict:
    return {"channels": e.channels(), "samples": e.samples()}


@command("list_fluor_channels")
def _colours(e: Engine, a: dict) -> dict:
    return {"channels": e.colours()}


@command("dimredux_channels")
def _suggested(e: Engine, a: dict) -> dict:
    return {"channels": e.channels(), "suggest_exclude": [c for c in e.channels() if c not in e.colours()]}


@command("get_events")
def _events(e: Engine, a: dict) -> DataFrame:
    """Rows in order; n caps them, if given."""
    ev = e.all() if a.get("source", "raw") == "raw" else e.events()
    ev = ev.filter(F.col("sample") == a["sample"]).select("sample", "row_index", *(a.get("channels") or e.channels()))
    return ev.orderBy("row_index").limit(a["n"]) if a.get("n") else ev


@command("sample_path")
def _path(e: Engine, a: dict) -> dict:
    by_name = {fcs.sample_name(f): f for f in e.session.files}
    name = a.get("sample") if a.get("sample") in by_name else next(iter(by_name), None)
    return {"sample": name, "path": by_name.get(name)}


@command("get_metadata")
def _keywords(e: Engine, a: dict) -> DataFrame:
    e.spark.dataSource.register(fcs.FcsSource)
    return e.spark.read.format("fcs").option("what", "keywords").load(e.run("sample_path", a)["path"])


@command("subsample")
def _subsample(e: Engine, a: dict) -> DataFrame:
    ev = e.all().filter(F.col("sample") == a["sample"]).select("sample", "row_index")
    return analysis.equal_sample(ev, a.get("n", 10_000), seed=a.get("seed", 12345))


@command("export_fcs")
def _export(e: Engine, a: dict) -> DataFrame:
    """Files of all samples, or of one, in a folder that all executors see."""
    os.makedirs(a["folder"], exist_ok=True)
    return fcs.write_files(e.gated(a) if a.get("compensated", True) else e.all(), a.get("channels") or e.channels(), a["folder"])


# ---- compensation and transforms ----


def spill_of(rows: DataFrame, channels: Sequence[str]) -> dict:
    found = {(r["source"], r["target"]): r["coef"] for r in rows.collect()}  # a number for each pair of channels
    own = [c for c in channels if (c, c) in found]
    return {"channels": own, "matrix": [[found.get((a, b), float(a == b)) for b in own] for a in own]}


@command("extract_spillover")
def _extract(e: Engine, a: dict) -> dict:
    words = e.run("get_metadata", a)
    return spill_of(fcs.spillover(words), e.channels())


@command("compute_spillover")
def _first(e: Engine, a: dict) -> dict:
    """The matrix of the first file that has one; it becomes the session's."""
    for f in e.session.files:
        found = e.run("extract_spillover", {"sample": fcs.sample_name(f)})
        if found["channels"]:
            e.session = e.session.with_spill(found["channels"], found["matrix"])
            return found
    raise ValueError("no file has a spillover matrix")


@command("apply_compensation")
def _compensate(e: Engine, a: dict) -> dict:
    if a.get("channels"):
        e.session = e.session.with_spill(a["channels"], a["matrix"])
    if not e.session.spill:
        raise ValueError("there is no matrix")
    compensation.inverse(e.session.spill)
    e.mode = a.get("mode", "standard")
    e.session = replace(e.session, compensated=True)
    return {"channels": list(e.session.spill_channels), "applied": True, "mode": e.mode}


@command("comp_preview")
def _preview(e: Engine, a: dict) -> DataFrame:
    """Two channels before and after; n caps the rows, if given."""
    channels, matrix = a.get("channels") or list(e.session.spill_channels), a.get("matrix") or e.session.spill
    ev = compensation.compensated(e.all().filter(F.col("sample") == a["sample"]), channels, matrix, "_comp")
    out = ev.select("row_index", a["x"], a["y"], *[f"{c}_comp" for c in (a["x"], a["y"]) if c in channels])
    return out.orderBy("row_index").limit(a["n"]) if a.get("n") else out


@command("compute_spillover_from_controls")
def _controls(e: Engine, a: dict) -> dict:
    """By the control of each channel ({channel: sample}, else by the brightest detector): medians of its positive events less the unstained one's."""
    channels, blank = a.get("channels") or e.colours(), a.get("unstained")
    owners = a.get("controls") or {r["channel"]: r["sample"] for r in compensation.auto_controls(e.all(), "sample", channels, blank).collect()}
    if not owners:
        raise ValueError("there is no control")
    own = [c for c in channels if c in owners]
    base = e.all().filter(F.col("sample") == blank).agg(*[F.median(c).alias(c) for c in own]).first() if blank else {c: 0.0 for c in own}
    primary = F.create_map(*[F.lit(v) for c in own for v in (owners[c], c)])[F.col("sample")]
    k = e.all().filter(F.col("sample").isin([owners[c] for c in own])).withColumn("primary", primary)
    value = reduce(lambda x, c: F.when(F.col("primary") == c, F.col(c)).otherwise(x), own, F.lit(None).cast("double"))
    cuts = a.get("threshold_overrides") or {}
    found = histograms.otsu_trimmed(k.withColumn("_v", asinh(value)), ["primary"], "_v")
    cut = F.coalesce(F.create_map(*[F.lit(v) for kv in cuts.items() for v in kv])[F.col("primary")] if cuts else F.lit(None).cast("double"), F.sinh("threshold") * 150.0)
    positive = k.join(found, "primary").withColumn("_v", value).filter(F.col("_v") >= cut)
    rows = positive.groupBy("primary").agg(*[F.median(c).alias(c) for c in own]).collect()  # a row for each channel
    medians = {r["primary"]: r for r in rows}
    matrix = [[1.0 if t == c else max(0.0, (medians[c][t] - base[t]) / max(medians[c][c] - base[c], 1e-9)) if c in medians else 0.0 for t in own] for c in own]
    e.session = e.session.with_spill(own, matrix)
    return {"channels": own, "matrix": matrix, "controls": [{"channel": c, "sample": owners[c]} for c in own]}


@command("comp_residual")
def _residual(e: Engine, a: dict) -> DataFrame:
    return compensation.residual_pairs(e.events(a), a.get("channels") or e.colours(), a.get("threshold", 0.2))


@command("suggest_transform")
def _suggest(e: Engine, a: dict) -> DataFrame:
    names = e.colours()
    below = e.events().agg(*[(F.lit(100.0) * F.count_if(F.col(c) < 0) / F.count("*")).alias(f"p{i}") for i, c in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), F.round(f"p{i}", 6).alias("pct_negative"), F.when(F.col(f"p{i}") > 2, "logicle").otherwise("arcsinh").alias("method")) for i, c in enumerate(names)])
    return below.select(F.explode(rows).alias("r")).select("r.*")


# ---- gates ----


@command("add_gate")
def _add(e: Engine, a: dict) -> dict:
    """A gate below the population at path parent (none: the root) of a sample, or of all of them."""
    made = Population(a["name"], Gate(a["type"], a["x_channel"], a.get("y_channel"), tuple(a.get("xs") or ()), tuple(a.get("ys") or ()), a.get("angle") or 0.0, bool(a.get("invert"))))

    def put(tree: tuple[Population, ...], path: list[str]) -> tuple[Population, ...]:
        if not path:
            return (*(p for p in tree if p.name != made.name), made)
        if path[0] not in {p.name for p in tree}:
            raise ValueError(f"no population {a['parent']}")
        return tuple(replace(p, children=put(p.children, path[1:])) if p.name == path[0] else p for p in tree)

    own = [a["sample"]] if a.get("sample") is not None else e.samples()
    path = [x for x in (a.get("parent") or "").split("/") if x]
    e.session = replace(e.session, trees=dict(e.session.trees) | {s: put(e.session.trees.get(s, ()), path) for s in own})
    return {"ok": True, "n_gates": len(workspace.tree_rows(e.session.trees))}


@command("remove_gate")
def _remove(e: Engine, a: dict) -> dict:
    """The gate of a name, and all below it, from a sample or from all."""

    def without(tree: tuple[Population, ...]) -> tuple[Population, ...]:
        return tuple(replace(p, children=without(p.children)) for p in tree if p.name != a["name"])

    e.session = replace(e.session, trees={s: without(t) if a.get("sample") in (None, s) else t for s, t in e.session.trees.items()})
    return {"ok": True, "n_gates": len(workspace.tree_rows(e.session.trees))}


@command("list_gates")
def _gates(e: Engine, a: dict) -> dict:
    return {"gates": [r for r in workspace.tree_rows(e.session.trees) if a.get("sample") in (None, r["sample"])]}


def grouped(e: Engine) -> dict[tuple[Population, ...], list[str]]:
    """Samples by their tree: those that share one are one pass."""
    out: dict[tuple[Population, ...], list[str]] = {}
    for s, t in e.session.trees.items():
        if t:
            out.setdefault(t, []).append(s)
    if not out:
        raise ValueError("there is no gate")
    return out


@command("gate_tree_stats")
def _tree(e: Engine, a: dict) -> DataFrame:
    ev = e.events()
    return reduce(DataFrame.unionByName, [gates.tree_counts(ev.filter(F.col("sample").isin(own)), t) for t, own in grouped(e).items()])


@command("compute_stats")
def _stats(e: Engine, a: dict) -> DataFrame:
    """sample, population, count, percent_total and a statistic (median unless stat names another) of each colour, of all events and of every population."""
    names, f = a.get("channels") or e.colours(), statistics.BY_KEY[a.get("stat", "median")]
    ev, parts = e.events(), [((), None)]
    if any(e.session.trees.values()):
        parts = [(own, t) for t, own in grouped(e).items()]
        rest = set(e.samples()) - {s for own, _ in parts for s in own}
        parts += [(sorted(rest), ())] * bool(rest)
    out = []
    for own, t in parts:
        some = ev.filter(F.col("sample").isin(list(own))) if own else ev
        where = {"root": F.lit(True)} | {p: gates.chain(g, ev.columns) for p, _, g in gates.nodes(t or ())}
        flat = some.groupBy("sample").agg(F.count("*").alias("_n"), *[x.alias(f"{i}_{j}") for i, w in enumerate(where.values()) for j, x in enumerate([F.count_if(w), *[f(F.when(w, F.col(c))) for c in names]])])
        rows = F.array(*[F.struct(F.lit(p).alias("population"), F.col(f"{i}_0").alias("count"), *[F.col(f"{i}_{j + 1}").alias(c) for j, c in enumerate(names)]) for i, p in enumerate(where)])
        out.append(flat.select("sample", "_n", F.explode(rows).alias("r")).select("sample", "r.*", (F.lit(100.0) * F.col("r.count") / F.col("_n")).alias("percent_total")))
    return reduce(DataFrame.unionByName, out)


@command("positivity_thresholds")
def _positive(e: Engine, a: dict) -> DataFrame:
    """channel, threshold, pct_positive: Otsu's on the arcsinh scale, of a sample or of all."""
    names, cofactor = a.get("channels") or e.colours(), a.get("cofactor", 150.0)
    rows = analysis.long(e.events(a), [], names).withColumn("t", asinh(F.col("value"), cofactor))
    cut = {"otsu": histograms.otsu_trimmed, "isodata": histograms.isodata, "triangle": histograms.triangle}[a.get("method", "otsu")](rows, ["channel"], "t")
    found = rows.join(cut, "channel").groupBy("channel").agg(F.first("threshold").alias("threshold_t"), (F.lit(100.0) * F.count_if(F.col("t") >= F.col("threshold")) / F.count("*")).alias("pct_positive"))
    return found.select("channel", (F.sinh("threshold_t") * cofactor).alias("threshold"), "threshold_t", "pct_positive")


# ---- layouts and clusters ----


@command("run_dimredux")
def _layout(e: Engine, a: dict) -> DataFrame:
    """sample, row_index, d1, d2 and the raw features; all rows, or n_per_sample of each. The method that ran is the one asked for: umap, tsne or pca."""
    names, method = e.wanted(a), a.get("method", "umap")
    ev = e.gated(a)
    if a.get("samples"):
        ev = ev.filter(F.col("sample").isin(list(a["samples"])))
    for p in a.get("positivity") or ():
        above = F.col(p["channel"]) >= p["threshold"]
        ev = ev.filter(~above if p.get("drop", "positive") == "positive" else above)
    if a.get("n_per_sample"):
        ev = analysis.equal_sample(ev, a["n_per_sample"], seed=a.get("seed", 42))
    x, seed = e.scaled(ev, names), a.get("seed", 42)
    if method == "umap":
        places = umap.umap(x, names, ("sample", "row_index"), a.get("neighbours", 15), a.get("min_dist", 0.1), rounds=a.get("rounds", 12), seed=seed)
    elif method == "tsne":
        places = embedding.tsne(x, names, "sample", a.get("n_per_sample") or embedding.FIT_ROWS, seed=seed)
    elif method == "pca":
        keyed = x.withColumn("_key", F.struct("sample", "row_index"))
        places = embedding.pca(keyed, names, 2, "_key").select("_key.sample", "_key.row_index", F.col("c0").alias("d1"), F.col("c1").alias("d2"))
    else:
        raise ValueError(f"unknown method {method}")
    e.layout, e.features = x.join(places.select("sample", "row_index"), ["sample", "row_index"]).select("sample", "row_index", *names), names
    return places.join(ev.select("sample", "row_index", *names), ["sample", "row_index"])


def clustered(x: DataFrame, names: Sequence[str], a: dict) -> DataFrame:
    """sample, row_index, label (and confidence) of scaled features."""
    k, method, seed = max(2, int(a.get("k", 8))), a.get("method", "flowsom"), a.get("seed", 42)
    keyed = embedding.scaled(x, names, a.get("scale", "zscore")).withColumn("_key", F.struct("sample", "row_index"))
    ways = {
        "flowsom": lambda: embedding.som_clusters(keyed, names, k, "_key", seed=seed),
        "kmeans": lambda: embedding.kmeans(keyed, names, k, "_key", seed),
        "phenograph": lambda: embedding.graph_clusters(keyed, names, a.get("neighbours", 30), "_key", seed),
        "bayesian": lambda: bayes.process_clusters(keyed, names, k, ("_key",), seed=seed),
        "flowgrid": lambda: embedding.grid_clusters(keyed, names, a.get("bin_n", 20), row="_key", eps=a.get("eps")),
    }
    if method not in ways:
        raise ValueError(f"unknown method {method}")
    out = ways[method]()
    return out.select("_key.sample", "_key.row_index", *[c for c in out.columns if c != "_key"])


@command("cluster_embedding")
def _cluster(e: Engine, a: dict) -> DataFrame:
    """Labels of the last layout's rows, by their features, not by their places."""
    if e.layout is None:
        raise ValueError("run a layout first")
    return clustered(e.layout, e.features, a)


@command("run_clustering")
def _clusters(e: Engine, a: dict) -> DataFrame:
    """cluster, n, pct and the median of each feature on its scale."""
    names = e.wanted(a)
    x = e.scaled(e.gated(a), names)
    x = analysis.equal_sample(x, a["n_events"]) if a.get("n_events") else x
    labels = clustered(x, names, a | {"k": a.get("k", 10)})
    return analysis.cluster_table(x.join(labels, ["sample", "row_index"]).withColumnRenamed("label", "cluster"), names)


# ---- analyses ----


def bins_of(e: Engine, a: dict, x: str, value, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Middles and counts of a channel of a population: bins numbers."""
    h = histograms.histogram(e.gated(a).select("sample", value(F.col(x)).alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")), ["sample"], "v", bins).orderBy("bin").toPandas()
    if not len(h):
        raise ValueError("no events")
    width = (h["hi"] - h["lo"]) / bins
    return (h["lo"] + (h["bin"] + 0.5) * width).to_numpy(float), h["n"].to_numpy(float)


@command("run_cell_cycle")
def _cycle(e: Engine, a: dict) -> dict:
    x, y = bins_of(e, a, a["channel"], lambda c: c, a.get("bins", 256))
    return models.cell_cycle(x, y, a.get("model", "watson") != "watson", a.get("mu_g1_hint"))


@command("run_proliferation")
def _divisions(e: Engine, a: dict) -> dict:
    x, y = bins_of(e, a, a["channel"], lambda c: F.log10(F.greatest(c, F.lit(1.0))), a.get("bins", 256))
    found = models.generations(x, y, a.get("n_peaks", 8))
    table = e.spark.createDataFrame([(g, float(n)) for g, n in found], "gen int, n double")
    return analysis.proliferation_indices(table).first().asDict() | {"generations": found}


@command("run_apoptosis")
def _apoptosis(e: Engine, a: dict) -> DataFrame:
    """Quadrants by thresholds that are given, else Otsu's."""
    x, y = a["annexin_channel"], a["pi_channel"]
    cuts = a.get("thresholds") or {r["channel"]: r["threshold"] for r in _positive(e, {"channels": [x, y], "sample": a.get("sample")}).collect()}
    return analysis.quadrant_table(e.gated(a), x, y, cuts[x], cuts[y])


@command("run_kinetic")
def _kinetic(e: Engine, a: dict) -> DataFrame:
    groups = e.spark.createDataFrame(list(a["groups"].items()), "sample string, grp string") if a.get("groups") else None
    ev = e.gated(a)
    ev = ev.filter(F.col("sample").isin(list(a["samples"]))) if a.get("samples") else ev
    return analysis.kinetic(ev, a["channel"], a.get("bins", 100), groups, time=a.get("time_channel", "Time"))


@command("run_stats_comparison")
def _compare(e: Engine, a: dict) -> DataFrame:
    """The groups' shares of a population compared by ranks: Mann-Whitney's test for two, Kruskal-Wallis' for more."""
    groups = e.spark.createDataFrame(list(a["groups"].items()), "sample string, grp string")
    shares = e.run("gate_tree_stats").filter(F.col("population") == a["gate"]).join(groups, "sample").select("sample", "grp", F.col("pct_parent").alias("x"))
    names = sorted(set(a["groups"].values()))
    if len(names) < 2:
        raise ValueError("there must be two groups at least")
    return analysis.mann_whitney(shares, "grp", "x", *names) if len(names) == 2 else analysis.kruskal_wallis(shares, "grp", "x")


@command("run_classifier")
def _classify(e: Engine, a: dict) -> DataFrame:
    """feature, importance: which features ({sample: {feature: value}}) tell the samples' groups apart."""
    labels = sorted(set(a["group_labels"].values()))
    names = sorted({f for v in a["features"].values() for f in v})
    rows = [(s, labels.index(a["group_labels"][s]), *[float(v.get(f, 0.0)) for f in names]) for s, v in a["features"].items() if s in a["group_labels"]]
    table = e.spark.createDataFrame(rows, "sample string, grp int, " + ", ".join(f"`{f}` double" for f in names))
    return embedding.forest_importance(table, names, "grp", a.get("top", 10), a.get("trees", 200), a.get("seed", 42))


@command("bead_calibration")
def _beads(e: Engine, a: dict) -> DataFrame:
    name = a.get("beads_sample") or a.get("sample")
    return beads.calibrated(e.all().filter(F.col("sample") == name), a.get("mef_values") or {}, a.get("channels"))


# ---- workspace files ----


@command("save_wsp")
def _save(e: Engine, a: dict) -> dict:
    """Samples, drawn trees, scales and compensation as a workspace file; counts of all populations are written with it."""
    from gateloom.functions.scales import Scale

    kinds = {"arcsinh": lambda f: Scale("asinh", (262144.0, float(np.log10(2 * 262144.0 / f)), 0.0)), "log": lambda f: Scale("log", (1.0, 4.5)), "logicle": lambda f: Scale("logicle", (262144.0, 0.5, 4.5, 0.0)), "none": lambda f: Scale()}
    scales = {c: kinds[m](f) for c, (m, f) in e.session.transforms.items()}
    paths = {fcs.sample_name(f): f for f in e.session.files}
    own = sorted({*paths, *e.session.trees})
    spill = (e.session.spill_channels, e.session.spill) if e.session.compensated else ((), ())
    found = tuple(wsp.Sample(s, f"file:{paths[s]}" if s in paths else "", scales, *spill, wsp.resolved(wsp.portable(e.session.trees.get(s, ()), scales))) for s in own)
    text = wsp.written(wsp.Workspace(found))
    part = f"{a['file']}.part"
    with open(part, "w") as f:
        f.write(text)
    os.replace(part, a["file"])
    return {"ok": True, "file": a["file"], "samples": len(found)}


@command("load_wsp")
def _load_wsp(e: Engine, a: dict) -> dict:
    w = wsp.read(e.spark, a["file"])
    e.session = replace(e.session, trees={s.name: s.trees for s in w.samples if s.trees}, groups={s: g for g, own in w.groups.items() for s in own}, name=os.path.splitext(os.path.basename(a["file"]))[0])
    return {"samples": [s.name for s in w.samples], "n_gates": len(workspace.tree_rows(e.session.trees))}


@command("import_wsp")
def _import_wsp(e: Engine, a: dict) -> DataFrame:
    """sample, population, row_index: a workspace file's trees, counted on the loaded events; samples without events have no rows."""
    return wsp.memberships(e.all(), wsp.read(e.spark, a["file"]))
