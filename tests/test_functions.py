"""Known numbers and round trips of statistics, transforms, thresholds and fits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gateloom.functions.scalars import Logicle, asinh, asinh_inverse
from gateloom.operators import compensation, histograms, models, statistics


@pytest.fixture(scope="module")
def ten(spark):
    return spark.createDataFrame([("s", float(i)) for i in range(1, 11)], "g string, x double")


def one(df, c):
    return df.agg(c).first()[0]


def test_known_statistics(ten):
    x = F.col("x")
    assert one(ten, statistics.mean(x)) == 5.5 and one(ten, statistics.median(x)) == 5.5
    assert one(ten, statistics.sd(x)) == pytest.approx(math.sqrt(8.25))
    assert one(ten, statistics.cv(x)) == pytest.approx(100 * math.sqrt(8.25) / 5.5)
    assert one(ten, statistics.percentile(x, 15.87)) == pytest.approx(2.4283, abs=1e-4)
    assert one(ten, statistics.percentile(x, 84.13)) == pytest.approx(8.5717, abs=1e-4)
    assert one(ten, statistics.rsd(x)) == pytest.approx((8.5717 - 2.4283) / 2, abs=1e-4)
    assert statistics.mad(ten, ["g"], "x").first()["mad"] == 2.5
    assert statistics.mad(ten, [], "x").first()["mad"] == 2.5


def test_geomean_correlation_and_empties(spark, ten):
    df = spark.createDataFrame([(-1.0,), (1.0,), (4.0,)], "x double")
    assert one(df, statistics.geomean(F.col("x"))) == pytest.approx(2.0)
    assert one(df.where("x < 0"), statistics.geomean(F.col("x"))) == 0
    xy = spark.createDataFrame([(1.0, 2.0, 3.0, 5.0), (2.0, 4.0, 2.0, 5.0), (3.0, 6.0, 1.0, 5.0)], "x double, y double, z double, c double")
    assert [round(one(xy, statistics.correlation(F.col("x"), F.col(k))), 9) for k in "yzc"] == [1, -1, 0]
    empty = ten.where("x > 99")
    for f in (statistics.mean, statistics.median, statistics.sd, statistics.cv, statistics.rcv, statistics.geomean):
        assert one(empty, f(F.col("x"))) == 0


def test_keys(ten):
    assert one(ten, statistics.by_key("count")) == 10 and one(ten, statistics.by_key("mfi:x")) == 5.5
    assert one(ten, statistics.by_key("pct:100:x")) == 10 and one(ten, statistics.by_key("correlation:x:x")) == pytest.approx(1)


def test_mode_and_otsu(spark):
    rng = np.random.default_rng(7)
    bi = np.concatenate([rng.normal(10, 3, 1000), rng.normal(90, 3, 1000)])
    df = spark.createDataFrame([("s", float(v)) for v in bi] + [("c", 5.0)] * 3, "g string, x double")
    assert 15 < histograms.otsu_clamped(df.where("g = 's'"), ["g"], "x").first()["threshold"] < 82
    assert 15 < histograms.otsu_trimmed(df.where("g = 's'"), ["g"], "x").first()["threshold"] < 82
    m = np.concatenate([rng.normal(7, 0.05, 1000), rng.uniform(0, 10, 100)])
    got = {r["g"]: r["mode"] for r in histograms.mode(spark.createDataFrame([("s", float(v)) for v in m] + [("c", 5.0)] * 3, "g string, x double"), ["g"], "x").collect()}
    assert got["s"] == pytest.approx(7.0, abs=0.15) and got["c"] == 5.0


def test_logicle(spark):
    s = Logicle()
    known = {-1000: -0.232115, 0: 0.111111, 100: 0.213181, 1000: 0.454338, 10000: 0.683833, 100000: 0.906928, 262144: 1.0}
    df = spark.createDataFrame([(float(k), v) for k, v in known.items()], "x double, t double")
    for r in df.select("t", "x", s.forward(F.col("x")).alias("f"), s.inverse(F.col("t")).alias("b")).collect():
        assert r["f"] == pytest.approx(r["t"], abs=1e-4)
        assert r["b"] == pytest.approx(r["x"], rel=1e-3, abs=0.5)
    x = np.linspace(-5000, 262144, 500)
    assert (np.diff(s.forward_of(x)) > 0).all() and s.inverse_of(s.forward_of(x)) == pytest.approx(x, rel=1e-3, abs=1e-2)


def test_asinh_round_trip(ten):
    r = ten.select((asinh_inverse(asinh(F.col("x"))) - F.col("x")).alias("d")).agg(F.max(F.abs("d"))).first()[0]
    assert r < 1e-9


def test_compensation(spark):
    rng = np.random.default_rng(3)
    true = rng.uniform(0, 100, (200, 3))
    s = np.array([[1, 0.2, 0.05], [0.1, 1, 0.1], [0, 0.3, 1]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in true @ s], "a double, b double, c double")
    got = np.array([tuple(r) for r in compensation.compensated(df, ["a", "b", "c"], s).collect()])
    assert np.abs(got - true).max() < 1e-9
    assert np.abs(models_nn(compensation, s, true) - true).max() < 1e-6
    assert min(min(r) for r in compensation.compensated_nonnegative(df, ["a", "b", "c"], s).collect()) >= 0
    with pytest.raises(ValueError):
        compensation.inverse([[1, 1], [1, 1]])


def models_nn(compensation, s, true):
    return compensation.nnls(s, true @ s, 2000)


def test_cell_cycle_fractions():
    x = np.linspace(50, 300, 256)
    g = lambda a, m, s: a * np.exp(-0.5 * ((x - m) / s) ** 2)
    y = g(1000, 100, 5) + g(300, 200, 10) + 20 * ((x > 100) & (x < 200))
    for free in (False, True):
        r = models.cell_cycle(x, y, free)
        assert r["mu_g1"] == pytest.approx(100, abs=1) and r["r2"] > 0.99
        a1, a2, s = 1000 * 5, 300 * 10, 20 * 100 / math.sqrt(2 * math.pi)
        assert r["pct_g1"] == pytest.approx(100 * a1 / (a1 + a2 + s), abs=3)


def test_generations():
    x = np.linspace(1, 4, 256)
    y = sum(n * np.exp(-0.5 * ((x - 3.5 + g * math.log10(2)) / 0.05) ** 2) for g, n in enumerate((400, 300, 200)))
    got = models.generations(x, y)
    assert [g for g, _ in got] == [0, 1, 2]
    assert got[1][1] / got[0][1] == pytest.approx(0.75, abs=0.05)


def test_tails():
    assert models.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and models.chi2_sf(18.307, 10) == pytest.approx(0.05, abs=1e-5)
    assert models.normal_sf(1.959964) == pytest.approx(0.025, abs=1e-6)
    assert models.mann_whitney_exact(0, 3, 3) == pytest.approx(0.1) and models.mann_whitney_exact(4.0, 4, 4) == pytest.approx(0.342857, abs=1e-6)
    assert models.wilcoxon(np.array([1, 2, 3, 4, 5, 6.0]), np.array([0, 0, 0, 0, 0, 0.0]))[1] == pytest.approx(0.03125)


def test_thresholds_by_search():
    rng = np.random.default_rng(0)
    y, e = np.histogram(np.concatenate([rng.normal(2, 0.5, 3000), rng.normal(7, 0.7, 2000)]), 256)
    x = (e[1:] + e[:-1]) / 2
    assert 3 < models.li(x, y.astype(float)) < 6 and 2.5 < x[models.yen(y.astype(float))] < 6
    assert 3 < models.valley(e[0], e[-1], y, 0.0) < 6
    m, _, w = models.gmm(rng.permutation(np.concatenate([rng.normal(2, 0.5, 3000), rng.normal(7, 0.7, 2000)])))
    assert m == pytest.approx([2, 7], abs=0.1) and w == pytest.approx([0.6, 0.4], abs=0.03)


def test_clusters_and_hull():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.2, (60, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    truth = np.repeat([0, 1, 2], 60)
    same = lambda lab: all(len(set(lab[truth == k])) == 1 for k in range(3)) and len(set(lab.tolist())) == 3
    codes = models.som(x, 6)
    assert same(models.merged_codes(codes, 3)[models.nearest(x, codes)])
    lab = models.phenograph(x, 15)
    assert all(len({tuple(truth[lab == k])[0]}) == 1 and len(set(truth[lab == k])) == 1 for k in set(lab.tolist()))
    y = models.tsne(x, 20, 150)
    d = ((y[:, None] - y[None]) ** 2).sum(2) + np.eye(180) * 1e9
    assert (truth[d.argmin(1)] == truth).mean() > 0.95
    assert len(models.hull(np.array([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1)]))) == 4


def test_surfaces(spark):
    from gateloom.operators import surfaces
    from gateloom.operators.gates import Gate

    rng = np.random.default_rng(0)
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.concatenate([rng.normal(0, 1, (3000, 2)), [[-10, -10], [10, 10]]])], "x double, y double")
    s = surfaces.surface(df, "x", "y")
    around, across = Gate("rectangle", "x", "y", (-4.0, 4.0), (-4.0, 4.0)), Gate("rectangle", "x", "y", (0.0, 5.0), (-5.0, 5.0))
    assert surfaces.boundary_confidence(s, around) < 0.05 < surfaces.boundary_confidence(s, across)
    assert surfaces.edge_confidence(s, across)[3] == (3, "through") and {v for _, v in surfaces.edge_confidence(s, around)} <= {"good", "flat"}
    assert surfaces.boundary_confidence(s, Gate("interval", "x", None, (0.0, 1.0))) is None
    assert surfaces.blurred(np.ones((8, 8))) == pytest.approx(np.ones((8, 8)))
    assert surfaces.valleys([0, 5, 1, 6, 0]) == [2] and surfaces.valleys([0, 1, 0]) == []


def area(p):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))) / 2


def test_outline_of_a_ring():
    from gateloom.operators.surfaces import outline

    a = np.linspace(math.radians(60), math.radians(300), 60)
    pts = np.concatenate([np.stack([r * np.cos(a), r * np.sin(a)], axis=1) for r in (7, 8.5, 10)])
    assert area(outline(pts, 2.0)) < 0.95 * area(outline(pts, 0.0))
    assert len(outline(np.array([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1)], float))) >= 4


def test_intensity_format_on_ties_and_odd_numbers(spark, tmp_path):
    import shutil

    import duckdb

    from gateloom.plans import registry
    from tests.oracle import TABLES, check

    for t in set(TABLES) - {"customer"}:
        shutil.copyfile(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    odd = "1245, -1245, 1235, 8.765, 12.5, 0.05, -0.05, 0.02, -0.3, -0.5, 0.5, 2.5, 0, -0.0, 1e-9, 1e-7, -0.01, 0.004, 99999.5, 1e5, 123450, 124500, -1e300, 1e-310, null, 'nan', 'inf', '-inf'"
    duckdb.execute(f"copy (select 's' as c_mktsegment, row_number() over () as c_custkey, x::double as c_acctbal from (select unnest([{', '.join(repr(v.strip(chr(39))) if v != 'null' else v for v in odd.split(', '))}]) as x)) to '{tmp_path}/customer.parquet' (format parquet)")
    check(spark, str(tmp_path), registry.QUERIES["intensity_format"], registry.ORACLE_SQL["intensity_format"])


def test_text_of_numbers_rounds_as_c(spark):
    from gateloom.functions.scalars import as_text

    got = spark.createDataFrame([(12.25,), (0.05,), (None,)], "x double").select(as_text(F.col("x"), "%.1f")).collect()
    assert [r[0] for r in got] == ["12.2", "0.1", None]
