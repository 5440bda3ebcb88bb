"""Methods on all rows against plain numpy, and workspace files against what was written."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gateloom.core.shared import Stages, exists
from gateloom.functions.scales import Scale
from gateloom.operators import bayes, neighbours, snapshots, umap
from gateloom.operators.gates import Gate, Population, tree_counts
from gateloom.sources import wsp


def groups(n=240, dims=5, k=3, seed=0, apart=8.0):
    rng = np.random.default_rng(seed)
    label = np.arange(n) % k
    return rng.normal(size=(k, dims))[label] * apart + rng.normal(size=(n, dims)), label


def frame(spark, x, **more):
    return spark.createDataFrame(pd.DataFrame(x, columns=[f"f{i}" for i in range(x.shape[1])]).assign(row_index=range(len(x)), **more)).repartition(3, "row_index")


def distances(x):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return d


def trustworthiness(x, y, k=10):
    n = len(x)
    rank = distances(x).argsort(1).argsort(1) + 1
    near = distances(y).argsort(1)[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum()


@pytest.fixture(scope="module")
def points(spark):
    x, _ = groups()
    return x, frame(spark, x).select(F.col("row_index").alias("id"), F.array(*[F.col(f"f{i}").cast("float") for i in range(5)]).alias("v"))


def recall(graph, x, k):
    want = distances(x.astype(np.float32).astype(float)).argsort(1)[:, :k]
    return np.mean([len({e["b"] for e in r["nb"]} & set(want[r["id"]].tolist())) / k for r in graph.collect()])


def test_neighbours_join_until_they_are_found(spark, points):
    x, df = points
    stages = Stages(spark)
    start = stages.store(neighbours.run_lists(df, 8, 2, 24, 1), "start")
    graph = neighbours.neighbour_graph(df, 8, stages, orders=2, run=24, rounds=4, seed=1)
    assert recall(start, x, 8) < 0.9 < recall(graph, x, 8)
    assert recall(neighbours.neighbour_graph(df, 8, stages), x, 8) == 1
    for r in graph.collect():
        assert [e["d"] for e in r["nb"]] == sorted(e["d"] for e in r["nb"]) and r["id"] not in {e["b"] for e in r["nb"]} and len(r["nb"]) == 8
    kept = [p for paths in stages.held.values() for p in paths]
    stages.close()
    assert len(kept) == 3 and not any(exists(spark, p) for p in kept)


def test_neighbours_of_equal_points(spark):
    """A third of the rows is one point: all lists are full, and no row is named by all."""
    rows = [(i, [1.0, 1.0] if i % 3 == 0 else [float(i), 0.0]) for i in range(90)]
    graph = neighbours.neighbour_graph(spark.createDataFrame(rows, "id bigint, v array<float>"), 5, Stages(spark), run=30).collect()
    named = pd.Series([e["b"] for r in graph if r["id"] % 3 == 0 for e in r["nb"]]).value_counts()
    assert all(len(r["nb"]) == 5 for r in graph) and named.max() < 20


def test_weights_sum_to_the_logarithm():
    d = np.sort(np.random.default_rng(3).random((50, 14)), axis=1) + 0.1
    w = umap.weights(d, 15)
    assert np.allclose(w.sum(1), math.log2(15), atol=1e-4) and (w[:, 0] == 1).all() and (np.diff(w, axis=1) <= 0).all()
    assert (umap.weights(np.zeros((4, 3)), 4) == 1).all()


def test_union_of_directions(spark):
    x, _ = groups(60)
    df = frame(spark, x).select(F.col("row_index").alias("id"), F.array(*[F.col(f"f{i}").cast("float") for i in range(5)]).alias("v"))
    graph = neighbours.neighbour_graph(df, 5, Stages(spark))
    w = np.zeros((60, 60))
    for r in graph.collect():
        w[r["id"], [e["b"] for e in r["nb"]]] = umap.weights(np.array([[e["d"] for e in r["nb"]]]), 6)[0]
    want = w + w.T - w * w.T
    got = umap.fuzzy_union(graph, 6).collect()
    assert len(got) == (want > 0).sum() / 2 and all(abs(r["w"] - want[r["a"], r["b"]]) < 1e-9 and r["a"] < r["b"] for r in got)


def test_umap_keeps_neighbours(spark):
    x, label = groups()
    ev = frame(spark, x).unionByName(spark.createDataFrame([(None, 0.0, 0.0, 0.0, 0.0, 999)], "f0 double, f1 double, f2 double, f3 double, f4 double, row_index bigint"))
    for part_rows in (10_000, 90):  # one part, and several that see each other's places of the round before
        got = umap.umap(ev, [f"f{i}" for i in range(5)], rounds=5, part_rows=part_rows).toPandas().sort_values("row_index")
        assert got["row_index"].tolist() == list(range(240))
        y = got[["d1", "d2"]].to_numpy()
        assert trustworthiness(x, y) > 0.9
        assert (label[distances(y).argsort(1)[:, 0]] == label).mean() > 0.97
    assert umap.curve(1.0, 0.1) == pytest.approx((1.577, 0.895), abs=0.01)


def test_umap_of_few(spark):
    none = frame(spark, np.zeros((1, 2))).limit(0)
    assert umap.umap(none, ["f0", "f1"]).count() == 0
    assert umap.umap(frame(spark, np.zeros((1, 2))), ["f0", "f1"], rounds=1).count() == 1
    same = umap.umap(frame(spark, np.ones((7, 2))), ["f0", "f1"], rounds=1).toPandas()
    assert len(same) == 7 and np.isfinite(same[["d1", "d2"]].to_numpy()).all()


# ---- a mixture under a Dirichlet process, against densities and updates written out with inverse matrices ----


def single_machine(x, k, label, rounds):
    n, d = x.shape
    psi = lambda v: (math.lgamma(v + 1e-5) - math.lgamma(v - 1e-5)) / 2e-5
    m0, w0 = x.mean(0), np.cov(x.T)
    r = np.eye(k)[label]
    for step in range(rounds + 1):
        if step:
            rho = np.empty((n, k))
            for j in range(k):
                off = x - m[j]
                stick = psi(a[j]) - psi(a[j] + b[j]) + sum(psi(b[i]) - psi(a[i] + b[i]) for i in range(j))
                log_det = sum(psi((nu[j] - i) / 2) for i in range(d)) + d * math.log(2) - np.linalg.slogdet(s[j])[1]
                rho[:, j] = stick + 0.5 * log_det - 0.5 * (d / kappa[j] + nu[j] * np.einsum("ni,ij,nj->n", off, np.linalg.inv(s[j]), off)) - 0.5 * d * math.log(2 * math.pi)
            r = np.exp(rho - rho.max(1, keepdims=True))
            r /= r.sum(1, keepdims=True)
        nk = r.sum(0) + 10 * np.finfo(float).eps
        mean = r.T @ x / nk[:, None]
        a, b = 1 + nk, np.array([1 / k + nk[j + 1 :].sum() for j in range(k)])
        kappa, nu = 1 + nk, d + nk
        m = (m0 + nk[:, None] * mean) / kappa[:, None]
        s = [w0 + (r[:, j, None] * (x - mean[j])).T @ (x - mean[j]) + 1e-4 * nk[j] * np.eye(d) + nk[j] / kappa[j] * np.outer(mean[j] - m0, mean[j] - m0) for j in range(k)]
    return m, nu, s, r


def test_mixture_equals_a_single_machine(spark):
    x, label = groups(150, 3, 2, 4, 2.0)
    rng = np.random.default_rng(1)
    start = np.where(rng.random(150) < 0.2, rng.integers(4, size=150), label)
    model = bayes.fit(frame(spark, x, start=start), ["f0", "f1", "f2"], 4, rounds=6, least=0, start="start")
    mean, nu, s, _ = single_machine(x, 4, start, 6)
    assert np.allclose(model.mean, mean, atol=1e-6) and np.allclose(model.dof, nu, atol=1e-6)
    assert np.allclose(model.covariance * model.dof[:, None, None], s, atol=1e-5)


def test_mixture_drops_what_is_not_needed(spark):
    x, label = groups(600, 3, 3, 7)
    ev = frame(spark, x)
    model = bayes.fit(ev, ["f0", "f1", "f2"], 8, rounds=60)
    assert (np.sort(model.weights())[:-3] < 0.02).sum() >= 4
    got = bayes.process_clusters(ev.withColumn("f0", F.when(F.col("row_index") != 5, F.col("f0"))), ["f0", "f1", "f2"], 4, rounds=60).toPandas()
    assert len(got) == 599 and got["confidence"].between(0, 1).all() and sorted(got["label"].unique()) == list(range(got["label"].nunique()))
    true = label[got["row_index"]]
    assert (got.groupby("label")["row_index"].apply(lambda i: pd.Series(label[i]).value_counts().iloc[0]).sum()) / len(true) > 0.98
    assert bayes.process_clusters(ev.limit(0), ["f0"], 3).count() == 0


def test_mixture_bound_rises(spark):
    x, label = groups(90, 2, 3, 2, 2.0)
    prior = bayes.Prior(1 / 4, x.mean(0), 1.0, 2.0, np.cov(x.T), 0.0)
    with np.errstate(divide="ignore"):
        model = prior.posterior(bayes.sums_of(x, np.log(np.eye(4)[label])))
    bounds = []
    for _ in range(30):
        model = prior.posterior(bayes.sums_of(x, model.log_responsibilities(x)))
        bounds.append(model.bound)
    assert all(b >= a - 1e-6 for a, b in zip(bounds, bounds[1:]))


# ---- workspace files ----

FILE = """<?xml version="1.0" encoding="UTF-8"?>
<Workspace version="20.0" xmlns:gating="http://www.isac-net.org/std/Gating-ML/v2.0/gating" xmlns:transforms="http://www.isac-net.org/std/Gating-ML/v2.0/transformations" xmlns:data-type="http://www.isac-net.org/std/Gating-ML/v2.0/datatypes">
 <Groups><GroupNode name="Mine"><Group name="Mine"><SampleRefs><SampleRef sampleID="7"/><SampleRef sampleID="99"/></SampleRefs></Group></GroupNode></Groups>
 <SampleList><Sample><DataSet uri="file:/a%20b/one.fcs" sampleID="7"/>
  <transforms:spilloverMatrix prefix="Comp-"><data-type:parameters><data-type:parameter data-type:name="A"/><data-type:parameter data-type:name="B"/></data-type:parameters>
   <transforms:spillover data-type:parameter="A"><transforms:coefficient data-type:parameter="A" transforms:value="1"/><transforms:coefficient data-type:parameter="B" transforms:value="0.5"/></transforms:spillover>
   <transforms:spillover data-type:parameter="B"><transforms:coefficient data-type:parameter="A" transforms:value="0"/><transforms:coefficient data-type:parameter="B" transforms:value="1"/></transforms:spillover></transforms:spilloverMatrix>
  <Transformations><transforms:biex transforms:length="256" transforms:maxRange="262144" transforms:neg="0" transforms:width="-100" transforms:pos="4.5"><data-type:parameter data-type:name="Comp-B"/></transforms:biex>
   <transforms:unknown><data-type:parameter data-type:name="A"/></transforms:unknown></Transformations>
  <SampleNode name="one.fcs" count="4" sampleID="7"><Subpopulations>
   <Population name="low" count="3"><Gate gating:id="ID1"><gating:RectangleGate eventsInside="1"><gating:dimension gating:max="15"><data-type:fcs-dimension data-type:name="Comp-B"/></gating:dimension></gating:RectangleGate></Gate>
    <Subpopulations><Population name="odd"><Gate><gating:SpiralGate/></Gate></Population></Subpopulations></Population>
   <Population name="low" count="9"><Gate/></Population>
   <NotNode name="rest" count="-1"><Dependents><Dependent name="low"/></Dependents></NotNode>
   <OrNode name="all"><Dependents><Dependent name="low"/><Dependent name="rest"/></Dependents></OrNode>
   <NotNode name="self"><Dependents><Dependent name="self"/></Dependents></NotNode>
  </Subpopulations></SampleNode></Sample></SampleList></Workspace>"""


def test_workspace_file_is_read(spark, tmp_path):
    (tmp_path / "w.wsp").write_text(FILE)
    w = wsp.read(spark, f"file://{tmp_path}/w.wsp")
    s = w.sample("one.fcs")
    assert w.groups == {"Mine": ("one.fcs",)} and s.uri == "file:/a b/one.fcs" and s.spill == ((1.0, 0.5), (0.0, 1.0)) and s.counts == {"low": 3}
    assert s.scales == {"Comp-B": Scale("logicle", (262144.0, 1.0, 4.5, 0.0))}
    ev = spark.createDataFrame([("one.fcs", i, 20.0, b) for i, b in enumerate([10.0, 20.0, 24.0, 25.0, float("nan")])] + [("two.fcs", 0, 1.0, 1.0)], "sample string, row_index bigint, A double, B double")
    counts = {r["population"]: r["count"] for r in wsp.sample_counts(ev, w).collect()}
    assert counts == {"low": 3, "low/odd": 0, "rest": 2, "all": 5, "self": 5}  # B less half of A; 15 is out; what is made of itself takes in nothing
    got = {(r["population"], r["row_index"]) for r in wsp.memberships(ev, w).collect()}
    assert {i for p, i in got if p == "low"} == {0, 1, 2} and {i for p, i in got if p == "rest"} == {3, 4}
    assert wsp.sample_counts(ev, wsp.Workspace()).count() == 0 and wsp.memberships(ev, wsp.Workspace()).count() == 0


SCALES = {"a": Scale("logicle", (262144.0, 0.5, 4.5, 0.0)), "b": Scale("asinh", (262144.0, 4.5, 1.0)), "c": Scale("log", (1.0, 4.5))}


def test_workspace_round_trip(spark):
    rng = np.random.default_rng(5)
    ev = spark.createDataFrame(pd.DataFrame({"sample": rng.choice(["s1", "s2", "s3"], 400), "row_index": range(400)} | {c: rng.normal(1e3, 2e3, 400) for c in "abc"}))
    drawn = (
        Population("r", Gate("rectangle", "a", "b", (0, 3000), (-500, 4000)), (Population("p", Gate("polygon", "a", "c", (0, 4000, 4000), (0, 0, 5000))), Population("x", Gate("ellipse", "a", "b", (0, 3000), (0, 3000), 0.4, True)))),
        *(Population(f"q{i}", Gate(f"q{i}", "a", "b", (800,), (900,))) for i in (1, 2, 3, 4)),
        Population("i", Gate("interval", "c", None, (0, 1000), invert=True)),
    )
    trees = wsp.resolved((*wsp.portable(drawn, SCALES), Population("either", wsp.Made("or", "", paths=("r/p", "i"))), Population("gone", wsp.Made("and", "", paths=("no such",)))))
    w = wsp.Workspace((wsp.Sample("s1", "file:/x y.fcs", SCALES, ("a", "b"), ((1.0, 0.1), (0.0, 1.0)), trees, {"r/p": 3}), wsp.Sample("s2", scales=SCALES, trees=trees), wsp.Sample("s3")), {"g": ("s2", "s1")})
    again = wsp.parsed(wsp.written(w))
    assert again.samples == w.samples and again.groups == {"All Samples": ("s1", "s2", "s3"), "g": ("s2", "s1")}
    assert wsp.parsed(wsp.written(wsp.Workspace((wsp.Sample("s2", trees=trees),)))).samples[0].trees == trees
    with pytest.raises(ValueError):
        wsp.written(wsp.Workspace((wsp.Sample("s2", scales={"a": Scale()}, trees=trees),)))
    counts = lambda w: {(r["sample"], r["population"]): r["count"] for r in wsp.sample_counts(ev, w).collect()}
    got = counts(again)
    assert got == counts(w) and {s for s, _ in got} == {"s1", "s2"} and got["s2", "gone"] == 0
    straight = {(r["sample"], r["population"]): r["count"] for r in tree_counts(ev, [drawn[0], *drawn[1:]]).collect()}
    same = ["r", "q1", "q2", "q3", "q4", "i"]
    assert all(got[s, p] == straight[s, p] for s in ("s1", "s2") for p in same)
    rows = wsp.memberships(ev, again).groupBy("sample", "population").count().collect()
    assert {(r["sample"], r["population"]): r["count"] for r in rows} == {k: v for k, v in got.items() if v}


@pytest.mark.parametrize("scale", [*SCALES.values(), Scale("linear", (-10.0, 90.0)), Scale.biex(262144, -100, 4.5, 0)])
def test_scales_of_columns_and_numbers(spark, scale):
    x = [-5e3, -1.0, 0.0, 0.5, 3.0, 1e3, 2e5]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(scale.column(F.col("x"))).collect()]
    assert np.allclose(got, scale.of(x), atol=1e-9) and all(a <= b for a, b in zip(got, got[1:]))


# ---- snapshots ----


def test_snapshot_is_made_once(spark, tmp_path):
    calls = []

    def make(rows):
        calls.append(1)
        return rows.select("row_index", (F.col("f0") * 2).alias("d1"))

    x, _ = groups(30, 2)
    df, folder = frame(spark, x), f"file://{tmp_path}/kept"
    first = snapshots.kept(folder, df, "twice", {"k": 1}, make).orderBy("row_index").collect()
    again = snapshots.kept(folder, df.repartition(7), "twice", {"k": 1}, make)  # other order, same rows
    assert again.orderBy("row_index").collect() == first and len(calls) == 1
    assert all("snapshot-" in f and ".part/" not in f for f in again.inputFiles())
    snapshots.kept(folder, df, "twice", {"k": 2}, make)
    snapshots.kept(folder, df.filter("row_index <> 3"), "twice", {"k": 1}, make)
    snapshots.kept(folder, df.unionAll(df.filter("row_index = 3")), "twice", {"k": 1}, make)
    assert len(calls) == 4 and len([p for p in (tmp_path / "kept").iterdir() if p.name.endswith(".part")]) == 0
    key = snapshots.digest(df, "twice", {"k": 1})
    assert snapshots.restored(spark, folder, key).count() == 30 and snapshots.restored(spark, folder, "none") is None
    assert snapshots.with_coordinates(df, again).count() == 30


def test_merged_lists_are_the_best_of_all(spark):
    """Entries by distance, then tie, then neighbour, each once; an id without neighbours keeps an empty list."""
    from gateloom.operators import neighbours

    rng = np.random.default_rng(3)
    rows = [(int(i), [(float(np.float32(d)), int(d * 8) % 3, int(b)) for d, b in zip(rng.integers(0, 6, 9) / 4, rng.integers(0, 5, 9))]) for i in rng.integers(0, 40, 400)] + [(99, [])]
    lists = spark.createDataFrame(rows, f"id bigint, nb {neighbours.LIST}")
    got = {r["id"]: [tuple(e) for e in r["nb"]] for r in neighbours.merged(lists, 7).collect()}
    want = {}
    for i, nb in rows:
        want.setdefault(i, set()).update(nb)
    assert got == {i: sorted(nb)[:7] for i, nb in want.items()}
    assert "array_sort" not in neighbours.merged(lists, 7)._jdf.queryExecution().optimizedPlan().toString()
