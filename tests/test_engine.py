"""Named commands on a folder of files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gateloom.sources import fcs
from gateloom.sources.engine import ENGINE, Engine
from gateloom.sources.workspace import COMMANDS

NAMES = ["FSC-A", "SSC-A", "FL1-A", "FL2-A", "Time"]


def sample(k, n=400):
    rng = np.random.default_rng(k)
    half = np.arange(n) % 2 == 0
    f1 = np.where(half, rng.normal(5000, 300, n), rng.normal(100, 20, n))
    return np.c_[rng.uniform(1e3, 9e4, n), rng.uniform(1e3, 9e4, n), f1, 0.2 * f1 + rng.normal(50, 10, n), np.arange(n)].astype(np.float32)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    for k in (1, 2, 3):
        (at / f"s{k}.fcs").write_bytes(fcs.written(sample(k), NAMES, extra={"$SPILLOVER": "2,FL1-A,FL2-A,1,0.2,0,1"}))
    (at / "bad.fcs").write_bytes(b"nothing")
    return at


@pytest.fixture
def engine(spark, folder):
    e = Engine(spark)
    report = {r["sample"]: r["error"] for r in e.run("load_fcs", {"folder": str(folder)}).collect()}
    assert report["s1"] is None and "not an FCS file" in report["bad"]
    return e


def test_files_and_channels(engine, folder):
    assert engine.run("list_channels") == {"channels": NAMES, "samples": ["s1", "s2", "s3"]} and engine.run("list_fluor_channels") == {"channels": ["FL1-A", "FL2-A"]}
    assert engine.run("dimredux_channels")["suggest_exclude"] == ["FSC-A", "SSC-A", "Time"]
    assert engine.run("sample_path", {"sample": "s2"})["path"].endswith("/s2.fcs")
    assert {r["keyword"]: r["value"] for r in engine.run("get_metadata", {"sample": "s1"}).collect()}["$TOT"] == "400"
    ev = engine.run("get_events", {"sample": "s2", "channels": ["Time"], "n": 7}).collect()
    assert [r["Time"] for r in ev] == list(range(7)) and engine.run("get_events", {"sample": "s2"}).count() == 400
    assert engine.run("subsample", {"sample": "s3", "n": 50}).count() == 50
    made = engine.run("export_fcs", {"folder": str(folder / "out"), "sample": "s1", "channels": ["FL1-A"]}).collect()
    assert [r["events"] for r in made] == [400] and (fcs.matrix((folder / "out/s1.fcs").read_bytes())[:, 0] == sample(1)[:, 2]).all()


def test_compensation(engine):
    found = engine.run("compute_spillover")
    assert found["channels"] == ["FL1-A", "FL2-A"] and np.allclose(found["matrix"], [[1, 0.2], [0, 1]])
    before = {(r["a"], r["b"]): r["r"] for r in engine.run("comp_residual").collect()}
    assert engine.run("apply_compensation") == {"channels": ["FL1-A", "FL2-A"], "applied": True, "mode": "standard"}
    after = {(r["a"], r["b"]): r["r"] for r in engine.run("comp_residual").collect()}
    assert before["FL1-A", "FL2-A"] > 0.9 and abs(after["FL1-A", "FL2-A"]) < 0.15
    p = engine.run("comp_preview", {"sample": "s1", "x": "FL1-A", "y": "FL2-A"}).toPandas()
    assert np.allclose(p["FL2-A_comp"], p["FL2-A"] - 0.2 * p["FL1-A"], atol=1e-3)
    with pytest.raises(ValueError):
        engine.run("apply_compensation", {"channels": ["FL1-A", "FL2-A"], "matrix": [[1, 1], [1, 1]]})


def test_spillover_from_controls(spark):
    rng = np.random.default_rng(0)
    rows = [("blank", i, 10.0, 10.0) for i in range(50)]
    for name, own in (("a", 0), ("b", 1)):
        for i in range(400):
            v = rng.normal(8000, 200) if i % 2 else 10.0
            rows.append((name, i, *((v, 10 + 0.1 * (v - 10)) if own == 0 else (10 + 0.05 * (v - 10), v))))
    e = Engine(spark, spark.createDataFrame(rows, "sample string, row_index bigint, A double, B double"))
    got = e.run("compute_spillover_from_controls", {"unstained": "blank"})
    assert got["controls"] == [{"channel": "A", "sample": "a"}, {"channel": "B", "sample": "b"}] and np.allclose(got["matrix"], [[1, 0.1], [0.05, 1]], atol=0.005)


def test_gates_and_statistics(engine, tmp_path):
    box = {"name": "Cells", "type": "rectangle", "x_channel": "FSC-A", "y_channel": "SSC-A", "xs": [2e4, 8e4], "ys": [1e4, 9e4]}
    assert engine.run("add_gate", box)["n_gates"] == 3
    engine.run("add_gate", {"name": "Bright", "parent": "Cells", "type": "interval", "x_channel": "FL1-A", "xs": [1000, 9000]})
    with pytest.raises(ValueError):
        engine.run("add_gate", box | {"parent": "none"})
    counts = {(r["sample"], r["population"]): r["count"] for r in engine.run("gate_tree_stats").collect()}
    for k in (1, 2, 3):
        x = sample(k)
        cells = (x[:, 0] >= 2e4) & (x[:, 0] <= 8e4) & (x[:, 1] >= 1e4) & (x[:, 1] <= 9e4)
        assert counts[f"s{k}", "Cells"] == cells.sum() and counts[f"s{k}", "Cells/Bright"] == (cells & (x[:, 2] >= 1000) & (x[:, 2] <= 9000)).sum()
    stats = {(r["sample"], r["population"]): r for r in engine.run("compute_stats").collect()}
    assert stats["s1", "root"]["FL1-A"] == pytest.approx(np.median(sample(1)[:, 2])) and stats["s1", "Cells/Bright"]["count"] == counts["s1", "Cells/Bright"]
    cut = {r["channel"]: r for r in engine.run("positivity_thresholds", {"channels": ["FL1-A"]}).collect()}["FL1-A"]
    assert 140 < cut["threshold"] < 4000 and cut["pct_positive"] == pytest.approx(50, abs=2)
    assert engine.run("run_stats_comparison", {"gate": "Cells", "groups": {"s1": "x", "s2": "y", "s3": "y"}}).count() == 1
    file = str(tmp_path / "w.wsp")
    assert engine.run("save_wsp", {"file": file})["samples"] == 3
    rows = engine.run("import_wsp", {"file": file}).groupBy("sample", "population").count().collect()
    assert {(r["sample"], r["population"]): r["count"] for r in rows} == counts
    engine.run("load_wsp", {"file": file})
    assert {(r["sample"], r["population"]): r["count"] for r in engine.run("gate_tree_stats").collect()} == counts
    assert engine.run("remove_gate", {"name": "Bright", "sample": "s1"})["n_gates"] == 5 and len(engine.run("list_gates", {"sample": "s1"})["gates"]) == 1


def test_layouts_and_clusters(engine):
    with pytest.raises(ValueError):
        engine.run("cluster_embedding")
    p = engine.run("run_dimredux", {"method": "pca", "n_per_sample": 40}).toPandas()
    assert len(p) == 120 and {"d1", "d2", "FL1-A"} <= set(p.columns)
    labels = engine.run("cluster_embedding", {"method": "kmeans", "k": 2}).toPandas()
    both = labels.merge(p, on=["sample", "row_index"])
    assert len(both) == 120 and both.groupby("label")["FL1-A"].max().min() < both.groupby("label")["FL1-A"].min().max()
    t = engine.run("run_clustering", {"method": "kmeans", "k": 2}).collect()
    assert sum(r["n"] for r in t) == 1200
    for bad in ({"method": "none"}, {"features": ["Q"]}, {"exclude": ["FL1-A", "FL2-A"]}):
        with pytest.raises(ValueError):
            engine.run("run_dimredux", bad)


def test_analyses(engine):
    q = {r["quadrant"]: r["count"] for r in engine.run("run_apoptosis", {"sample": "s1", "annexin_channel": "FL1-A", "pi_channel": "FL2-A", "thresholds": {"FL1-A": 1000, "FL2-A": 500}}).collect()}
    assert sum(r["count"] for r in engine.run("run_apoptosis", {"sample": "s1", "annexin_channel": "FL1-A", "pi_channel": "FL2-A"}).collect()) == 400
    assert q == {"live": 200, "early": 0, "late": 200, "necrotic": 0}
    assert {r["grp"] for r in engine.run("run_kinetic", {"channel": "FL1-A", "bins": 4, "groups": {"s1": "a", "s2": "a"}}).collect()} == {"a", "s3"}
    got = engine.run("run_classifier", {"features": {f"s{i}": {"x": float(i), "y": 1.0} for i in range(8)}, "group_labels": {f"s{i}": "ab"[i // 4] for i in range(8)}, "trees": 5}).first()
    assert got["feature"] == "x"
    assert {r["channel"]: r["method"] for r in engine.run("suggest_transform").collect()} == {"FL1-A": "arcsinh", "FL2-A": "arcsinh"}
    assert not engine.run("bead_calibration", {"sample": "s1", "channels": ["FL1-A"], "mef_values": {"FL1-A": [1, 2]}}).first()["ok"]


def test_engine_itself(spark, engine):
    assert engine.run("ping") == {"pong": True} and engine.run("version")["version"] and engine.run("sleep", {"steps": 2, "step_ms": 1})["slept_ms"] >= 2 and engine.run("noisy") == {"noisy": True}
    with pytest.raises(RuntimeError):
        engine.run("boom")
    with pytest.raises(ValueError):
        engine.run("no such command")
    with pytest.raises(ValueError):
        Engine(spark).run("list_channels")
    assert len(set(engine.run("capabilities")["commands"])) == len({*ENGINE, *COMMANDS}) >= 46
    assert engine.run("apply_transformation", {"channels": ["FL1-A"], "method": "log"}) == {"ok": True} and engine.session.transforms["FL1-A"][0] == "log"
