"""Kernel densities, bead calibration and stability over time against direct evaluation and planted values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gateloom.operators import beads, density, stability


def gauss(z):
    return np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def test_density_equals_direct_evaluation(spark):
    rng = np.random.default_rng(2)
    x = {"a": rng.normal(0, 1, 500), "b": np.r_[rng.normal(-50, 3, 200), rng.normal(20, 5, 300)]}
    rows = [(g, float(v)) for g, v in x.items() for v in v] + [("a", None), ("a", float("nan")), ("c", None), ("one", 4.0), ("flat", 2.0), ("flat", 2.0)]
    got = density.density(spark.createDataFrame(rows, "g string, x double").repartition(3), ["g"], "x", 256).toPandas()
    assert set(got["g"]) == {"a", "b", "one", "flat"} and (got.groupby("g").size() == 256).all()
    for g, v in x.items():
        own = got[got["g"] == g].sort_values("x")
        iqr = np.subtract(*np.percentile(v, [75, 25])) / 1.34
        h = 0.9 * min(v.std(ddof=1), iqr) * len(v) ** -0.2
        assert own["h"].iloc[0] == pytest.approx(h) and own["n"].iloc[0] == len(v)
        direct = gauss((own["x"].to_numpy()[:, None] - v) / h).mean(1) / h
        step = own["x"].diff().iloc[1]
        assert np.abs(own["density"] - direct).max() < (step / h) ** 2 / 4 * direct.max()
        assert own["density"].sum() * step == pytest.approx(1, abs=0.01)
    assert density.density(spark.createDataFrame([], "g string, x double"), ["g"], "x").count() == 0


def test_binning_keeps_mass_and_mean(spark):
    v = np.random.default_rng(1).gamma(2, 3, 300)
    b = density.binned(spark.createDataFrame([(float(x),) for x in v], "x double"), [], "x", 64).toPandas()
    assert b["w"].sum() == pytest.approx(300) and (b["w"] * (b["start"] + b["step"] * b["i"])).sum() == pytest.approx(v.sum())


def test_density_2d_equals_direct_evaluation(spark):
    rng = np.random.default_rng(4)
    p = rng.normal(size=(300, 2)) @ [[2.0, 0.5], [0.0, 1.0]]
    df = spark.createDataFrame([("g", *map(float, r)) for r in p] + [("g", None, 1.0)], "g string, x double, y double")
    got = density.density_2d(df, ["g"], "x", "y", 96).toPandas()
    h = [min(v.std(ddof=1), np.subtract(*np.percentile(v, [75, 25])) / 1.34) * 300 ** (-1 / 6) for v in p.T]
    direct = (gauss((got["x"].to_numpy()[:, None] - p[:, 0]) / h[0]) * gauss((got["y"].to_numpy()[:, None] - p[:, 1]) / h[1])).mean(1) / h[0] / h[1]
    assert len(got) == 96 * 96 and np.abs(got["density"] - direct).max() < 0.02 * direct.max()


def test_nested_density_lies_below_its_parent(spark):
    ev = spark.range(4000).select(F.lit("s").alias("sample"), (F.col("id") % 97).cast("double").alias("x"))
    got = density.nested_density(ev, {"low": F.col("x") < 30}, "x", points=64)
    areas = {r["population"]: r["a"] for r in got.withColumn("w", F.col("share")).groupBy("population").agg(F.sum(F.col("share")).alias("a"), F.max("n").alias("n")).collect()}
    n = {r["population"]: r["n"] for r in got.select("population", "n").distinct().collect()}
    assert n["all"] == 4000 and n["low"] == ev.filter("x < 30").count() and set(areas) == {"all", "low"}


KNOWN = [0.0, 800.0, 2500.0, 8000.0, 25000.0, 80000.0]


def bead_frame(spark, auto=150.0, slope=1.05, offset=1.2, n=400, seed=1):
    """Beads whose medians obey the curve: median = ((known + auto) / exp(offset)) ** (1 / slope)."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in KNOWN:
        m = ((k + auto) / math.exp(offset)) ** (1 / slope)
        rows += [(float(m * v), float(m * w)) for v, w in zip(np.exp(rng.normal(0, 0.04, n)), np.exp(rng.normal(0, 0.04, n)))]
    return spark.createDataFrame(rows + [(None, float("nan"))], "FL1 double, FL2 double").repartition(4)


def test_beads_are_recovered(spark):
    got = beads.calibrated(bead_frame(spark), {"FL1": KNOWN, "FL2": [None, *KNOWN[1:]], "FL3": KNOWN, "FL4": []}, ["FL1", "FL2", "FL3"]).toPandas()
    for c in ("FL1", "FL2"):
        own = got[got["channel"] == c].sort_values("place")
        assert len(own) == 50 and own["ok"].all() and (own["y"].diff().iloc[1:] > 0).all()
        fit = own.iloc[0]
        for k in KNOWN[1:]:
            m = ((k + 150.0) / math.exp(1.2)) ** (1 / 1.05)
            assert math.exp(fit["offset"]) * m ** fit["slope"] - fit["auto"] == pytest.approx(k, rel=0.02, abs=10)
    assert set(got["channel"]) == {"FL1", "FL2"}
    mef = beads.in_molecules(bead_frame(spark), beads.calibrated(bead_frame(spark), {"FL1": KNOWN}), ["FL1", "FL2"]).select("FL1_mef", "FL2_mef").toPandas()
    assert mef["FL2_mef"].isna().all() and mef["FL1_mef"].max() == pytest.approx(80150, rel=0.2)


def test_bead_errors_are_rows(spark):
    df = bead_frame(spark, n=20).withColumn("flat", F.lit(1.0))
    got = {r["channel"]: r for r in beads.calibrated(df, {"FL1": [1.0, None, 2.0], "flat": KNOWN, "FL2": None}).collect()}
    assert not any(r["ok"] for r in got.values()) and "at least 3" in got["FL1"]["error"] and "distinct" in got["flat"]["error"] and got["FL2"]["error"] == "no known values"
    with pytest.raises(ValueError):
        beads.calibrated(df, {"no such": KNOWN})


def test_standard_curve_of_exact_points():
    m = np.array([50.0, 300.0, 900.0, 4000.0])
    slope, offset, auto = beads.standard_curve(m, np.exp(0.7) * m**1.1 - 90)
    assert (slope, offset, auto) == pytest.approx((1.1, 0.7, 90), rel=1e-3)


def unstable(spark, n=30_000, seed=3):
    """Two channels that are steady but for a jump in the middle of s1."""
    rng = np.random.default_rng(seed)
    frames = []
    for s in ("s1", "s2"):
        a = np.where(rng.random(n) < 0.5, rng.normal(300, 40, n), rng.normal(5000, 500, n))
        b = rng.normal(1000, 120, n)
        if s == "s1":
            a[12_000:15_000] *= 2.5
        frames.append(pd.DataFrame({"sample": s, "row_index": np.arange(n), "a": a, "b": b}))
    return spark.createDataFrame(pd.concat([*frames, pd.DataFrame({"sample": ["tiny"] * 3, "row_index": range(3), "a": [1.0, None, 3.0], "b": [1.0] * 3})])).repartition(5)


def test_planted_disturbance_goes(spark):
    ev = unstable(spark)
    verdicts = stability.bin_verdicts(ev, ["a", "b"]).cache()
    share = {r["sample"]: r for r in stability.removed_shares(verdicts).collect()}
    assert share["s2"]["pct_removed"] < 2 and share["tiny"]["removed"] == 0 and 8 <= share["s1"]["pct_removed"] <= 14
    kept = {r["row_index"] for r in stability.stable(ev, verdicts).filter("sample = 's1'").select("row_index").collect()}
    assert len(kept) == 30_000 - share["s1"]["removed"] and sum(12_300 <= i < 14_700 for i in kept) == 0 and sum(i < 11_500 or i > 15_500 for i in kept) > 25_500
    assert stability.bin_verdicts(ev.limit(0), ["a"]).count() == 0


def test_tree_isolates_the_odd_bins():
    x = np.r_[np.random.default_rng(1).normal(0, 0.1, (90, 2)), np.full((10, 2), 8.0)]
    assert sorted(stability.isolation_leaf(x)) == list(range(90))
    assert len(stability.isolation_leaf(np.random.default_rng(1).normal(size=(100, 3)))) == 100
    assert stability.short_runs(np.array([0, 0, 0, 0, 0, 1, 0, 0, 1, 0, 0, 0, 0, 0], bool)).tolist() == [False] * 5 + [True] * 4 + [False] * 5


def test_outlines_hold_all_points_of_the_hull(spark):
    from gateloom.operators.models import hull
    from gateloom.operators.surfaces import outlines

    rng = np.random.default_rng(6)
    p = {g: rng.normal(k, 1 + k, (500, 2)) for k, g in enumerate("ab")}
    rows = [(g, *map(float, r)) for g, v in p.items() for r in v] + [("a", None, 1.0), (None, 2.0, 3.0)]
    got = outlines(spark.createDataFrame(rows, "g string, x double, y double").repartition(6), ["g"], "x", "y").toPandas()
    for g, v in p.items():
        shape = set(map(tuple, got[got["g"] == g][["x", "y"]].to_numpy().tolist()))
        assert set(hull(v)) <= shape <= set(map(tuple, v.tolist())) and len(shape) >= len(hull(v))
    assert len(got[got["g"].isna()]) == 1
    whole = outlines(spark.createDataFrame(rows, "g string, x double, y double").filter("g = 'a'"), ["g"], "x", "y", concavity=0).toPandas().sort_values("i")
    assert list(map(tuple, whole[["x", "y"]].to_numpy().tolist())) == hull(p["a"])
