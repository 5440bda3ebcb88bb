"""Files, workspaces, plugins, streams."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gateloom.operators.gates import Gate, Population
from gateloom.sources import fcs, workspace
from gateloom.streaming.binning import binned

X = np.array([[1.5, -2.0, 3.0], [4.0, 5.25, 6.0]])


def test_fcs_round_trip():
    data = fcs.written(X, ["FSC-A", "FL1/A", "Time"], ["", "CD4", ""], {"$SPILL": "2,FSC-A,FL1/A,1,0.1,0.2,1"})
    words = fcs.keywords(data)
    assert fcs.channels(words) == [("FSC-A", ""), ("FL1/A", "CD4"), ("Time", "")]
    assert (fcs.matrix(data) == X).all() and words["$SPILL"].startswith("2,")
    assert fcs.matrix(fcs.written(X[:0], ["a", "b", "c"])).shape == (0, 3)


@pytest.mark.parametrize("order,mark", [("<", "1,2,3,4"), (">", "4,3,2,1")])
def test_integers_with_masks(order, mark):
    body = struct.pack(f"{order}HIHI", 0xFFFF, 70000, 5, 7)
    text = f"/$PAR/2/$TOT/2/$MODE/L/$DATATYPE/I/$BYTEORD/{mark}/$P1B/16/$P2B/32/$P1R/1024/$P2R/262144/".encode()
    a = 58 + len(text)
    data = f"FCS3.0    {58:>8}{a - 1:>8}{a:>8}{a + len(body) - 1:>8}{0:>8}{0:>8}".encode() + text + body
    assert fcs.matrix(data).tolist() == [[1023, 70000], [5, 7]]
    assert fcs.channels(fcs.keywords(data)) == [("P1", ""), ("P2", "")]


def test_source_and_mixed_panels(spark, tmp_path):
    (tmp_path / "a.fcs").write_bytes(fcs.written(X, ["x", "y", "z"], extra={"SPILL": "2,x,y,1,0.1,0.2,1"}))
    (tmp_path / "b.FCS").write_bytes(b"not one")
    spark.dataSource.register(fcs.FcsSource)
    df = spark.read.format("fcs").load(str(tmp_path))
    assert df.columns == ["sample", "row_index", "x", "y", "z"] and df.count() == 2
    k = spark.read.format("fcs").option("what", "keywords").load(str(tmp_path))
    assert {(r["source"], r["target"]): r["coef"] for r in fcs.spillover(k).collect()} == {("x", "x"): 1, ("x", "y"): 0.1, ("y", "x"): 0.2, ("y", "y"): 1}
    (tmp_path / "c.fcs").write_bytes(fcs.written(X, ["x", "q", "z"]))
    with pytest.raises(Exception, match="channel layout"):
        spark.read.format("fcs").load(str(tmp_path)).count()
    with pytest.raises(Exception, match="no FCS file"):
        spark.read.format("fcs").load(str(tmp_path / "none")).count()


def test_ranges_columns_and_bad_files(spark, tmp_path):
    """A file of many partitions; only the wanted channels are read; files that can't be read are reported, and skipped if asked."""
    big = np.arange(3000.0).reshape(1000, 3)
    (tmp_path / "big.fcs").write_bytes(fcs.written(big, ["x", "y", "z"]))
    (tmp_path / "bad.fcs").write_bytes(b"not one")
    whole = fcs.written(X, ["x", "y", "z"])
    (tmp_path / "cut.fcs").write_bytes(whole[:-4])
    spark.dataSource.register(fcs.FcsSource)
    read = spark.read.format("fcs").option("onBad", "skip").option("splitBytes", "1200")
    df = read.load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 10
    got = df.orderBy("row_index").toPandas()
    assert (got[["x", "y", "z"]].to_numpy() == big).all() and got["row_index"].tolist() == list(range(1000)) and set(got["sample"]) == {"big"}
    some = read.schema("z double, sample string").load(str(tmp_path))
    assert some.columns == ["z", "sample"] and some.agg(F.sum("z")).first()[0] == big[:, 2].sum()
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "z#" in plan and "x#" not in plan and "row_index" not in plan
    with pytest.raises(Exception, match="no such channel"):
        read.schema("q double").load(str(tmp_path)).count()
    with pytest.raises(Exception, match="unreadable"):
        spark.read.format("fcs").load(str(tmp_path)).count()
    report = {r["sample"]: r for r in spark.read.format("fcs").option("what", "files").load(str(tmp_path)).collect()}
    assert report["big"]["events"] == 1000 and report["big"]["error"] is None and "not an FCS file" in report["bad"]["error"] and "don't fit" in report["cut"]["error"]


def test_written_files_stream(spark, tmp_path):
    ev = spark.range(700).select((F.col("id") % 3).cast("string").alias("sample"), F.floor(F.col("id") / 3).alias("row_index"), F.col("id").cast("double").alias("x")).repartition(7)
    made = {r["sample"]: r for r in fcs.write_files(ev, ["x"], str(tmp_path)).collect()}
    assert {k: r["events"] for k, r in made.items()} == {"0": 234, "1": 233, "2": 233} and sorted(p.name for p in tmp_path.iterdir()) == ["0.fcs", "1.fcs", "2.fcs"]
    assert fcs.matrix((tmp_path / "1.fcs").read_bytes())[:, 0].tolist() == [float(i) for i in range(1, 700, 3)]
    assert fcs.write_files(ev.limit(0), ["x"], str(tmp_path)).count() == 0


def test_workspace(tmp_path):
    f = tmp_path / "s.fcs"
    f.write_bytes(b"")
    tree = (Population("a", Gate("polygon", "x", "y", (0.0, 1.0, 1.0), (0.0, 0.0, 1.0), 0.0, True), (Population("b", Gate("interval", "x", None, (0.0, 1.0))),)),)
    s = workspace.Session("e", (str(f), "/gone.fcs"), trees={"s": tree}, groups={"s": "g"}).with_transform(["x"], "log").logged("t", "GATE", "s", "a gate")
    assert workspace.call("save_workspace", s, {"file": str(tmp_path / "w")})["n_gates"] == 2
    back, skipped = workspace.load(str(tmp_path / "w"))
    assert skipped == 1 and back.trees == {"s": tree} and back.files == (str(f),) and back.common_transform(["x"]) == ("log", 150.0)
    assert "Gates: a gate." in workspace.methods_text(back)
    xml = workspace.gating_xml(back.trees)
    assert xml.count('eventsInside="false"') == 1 and xml.count('eventsInside="true"') == 1 and xml.count("Gate ") == 2 and "PolygonGate" in xml and "RectangleGate" in xml
    with pytest.raises(ValueError, match="unknown command"):
        workspace.call("no", s)
    assert s.loaded(["x"]).trees == {} and not s.loaded(["x"]).transforms


def test_restore_of_odd_rows():
    rows = [{"sample": "s", "id": "2", "parent_id": "9", "name": "orphan", "type": "interval", "x_channel": "x"}, {"sample": "s", "id": "3", "name": "twin", "type": "interval", "x_channel": "x"}, {"sample": "s", "id": "4", "name": "twin", "type": "line", "x_channel": "x"}]
    t = workspace.trees_of(rows)["s"]
    assert [p.name for p in t] == ["orphan", "twin"] and t[1].gate.kind == "interval"


def test_plugins(tmp_path):
    for d, body in (("z", {"id": "z", "name": "alpha", "entry": "f", "params": [{"name": "k", "min": 1, "max": 5, "default": 2}]}), ("y", {"id": "y", "name": "Beta", "entry": "g"}), ("bad", {"no": 1})):
        (tmp_path / d).mkdir()
        (tmp_path / d / "plugin.json").write_text(json.dumps(body))
    (tmp_path / "worse").mkdir()
    (tmp_path / "worse" / "plugin.json").write_text("{")
    found = workspace.plugins(str(tmp_path))
    assert [p.name for p in found] == ["alpha", "Beta"] and found[0].arguments({}) == {"k": 2}
    for wrong in ({"k": 9}, {"x": 1}):
        with pytest.raises(ValueError):
            found[0].arguments(wrong)


def test_stream(spark, tmp_path):
    rows = spark.range(100).select(F.lit("s").alias("sample"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").cast("double").alias("v"))
    rows.write.parquet(str(tmp_path / "in"))
    q = binned(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "v").writeStream.format("memory").queryName("binned").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("binned").agg(F.sum("n")).first()[0] == 100 and spark.table("binned").count() == 10


def test_files_are_written_and_read_by_ranges(spark, tmp_path, monkeypatch):
    """Blocks of a sample are written by several tasks; what mounted files hold never comes as one row."""
    monkeypatch.setattr(fcs, "WRITTEN", 50, raising=False)
    ev = spark.range(700).select((F.col("id") % 3).cast("string").alias("sample"), (F.col("id") * 2).alias("row_index"), F.col("id").cast("double").alias("x"), (-F.col("id")).cast("double").alias("y")).repartition(7)
    made = {r["sample"]: r["events"] for r in fcs.write_files(ev, ["x", "y"], str(tmp_path)).collect()}
    assert made == {"0": 234, "1": 233, "2": 233} and sorted(p.name for p in tmp_path.iterdir()) == ["0.fcs", "1.fcs", "2.fcs"]
    df = fcs.read_events(spark, str(tmp_path), ["y", "x"], size=160)
    assert "content" not in df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in fcs.read_keywords(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    got = df.toPandas().sort_values(["sample", "row_index"])
    for s in range(3):
        own = got[got["sample"] == str(s)]
        assert own["x"].tolist() == [float(i) for i in range(s, 700, 3)] and (own["y"] == -own["x"]).all() and own["row_index"].tolist() == list(range(len(own)))
    with pytest.raises(Exception, match="doesn't count"):
        fcs.write_files(ev, ["x"], str(tmp_path / "gaps"), by_row=True)
    with pytest.raises(Exception, match="no such channel"):
        fcs.read_events(spark, str(tmp_path), ["q"]).count()


def test_files_of_other_stores_are_decoded_from_their_content(spark, tmp_path, monkeypatch):
    (tmp_path / "a.fcs").write_bytes(fcs.written(X, ["x", "y", "z"]))
    plain = fcs.listed
    monkeypatch.setattr(fcs, "listed", lambda *a: (plain(*a)[0], False))
    assert [(r["row_index"], r["z"], r["x"]) for r in fcs.read_events(spark, str(tmp_path), ["z", "x"]).collect()] == [(0, 3.0, 1.5), (1, 6.0, 4.0)]
    assert {r["keyword"]: r["value"] for r in fcs.read_keywords(spark, str(tmp_path)).collect()}["$TOT"] == "2"
