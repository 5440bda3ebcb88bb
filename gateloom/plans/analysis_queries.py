"""Queries over compensation, time, groups, clusters, fits and panels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gateloom.core.bind import CUSTOMER_CTE, EVENTS_CTE, LINEITEM_CTE, VECTOR_CTE, customer_events, lineitem_events, stream_events, table, vector_events
from gateloom.operators import analysis, compensation, embedding, histograms, models, statistics
from gateloom.plans.registry import query

LINE, STREAM, VECTOR, CUSTOMER = (f"WITH {c}" for c in (LINEITEM_CTE, EVENTS_CTE, VECTOR_CTE, CUSTOMER_CTE))
CHANS = ["e0", "e1", "e2", "e3"]
SPILL = [[1.0, 0.1, 0.0, 0.02], [0.05, 1.0, 0.2, 0.0], [0.0, 0.03, 1.0, 0.1], [0.01, 0.0, 0.04, 1.0]]


def comp_sql() -> str:
    inv = np.linalg.inv(np.array(SPILL))
    return ", ".join("round(" + " + ".join(f"({inv[i, j]!r})::DOUBLE * {CHANS[i]}" for i in range(4)) + f", 6) AS {CHANS[j]}" for j in range(4)).replace("np.float64(", "").replace("))::", ")::")


# ---- compensation ----


@query("comp_apply", VECTOR + " SELECT row_index, " + comp_sql() + " FROM ev")
def comp_apply(spark, sf_dir):
    ev = compensation.compensated(vector_events(spark, sf_dir, 4), CHANS, SPILL)
    return ev.select("row_index", *[F.round(c, 6).alias(c) for c in CHANS])


@query("comp_preview", VECTOR + " SELECT row_index, e0 AS raw_x, e1 AS raw_y, " + comp_sql().replace("AS e0", "AS comp_x").replace("AS e1", "AS comp_y").split(", round")[0] + ", round" + comp_sql().replace("AS e1", "AS comp_y").split(", round")[1] + " FROM ev")
def comp_preview(spark, sf_dir):
    """One pair of channels before and after."""
    ev = compensation.compensated(vector_events(spark, sf_dir, 4), CHANS, SPILL, "_c")
    return ev.select("row_index", F.col("e0").alias("raw_x"), F.col("e1").alias("raw_y"), F.round("e0_c", 6).alias("comp_x"), F.round("e1_c", 6).alias("comp_y"))


@query("comp_roundtrip", VECTOR + " SELECT row_index, round(e0, 6) AS e0, round(e3, 6) AS e3 FROM ev")
def comp_roundtrip(spark, sf_dir):
    """Compensated and spilled again: the events as they were."""
    ev = compensation.spilled(compensation.compensated(vector_events(spark, sf_dir, 4), CHANS, SPILL), CHANS, SPILL)
    return ev.select("row_index", F.round("e0", 6).alias("e0"), F.round("e3", 6).alias("e3"))


@query("comp_nonnegative")
def comp_nonnegative(spark, sf_dir):
    ev = compensation.compensated_nonnegative(vector_events(spark, sf_dir, 4), CHANS, SPILL)
    return ev.select("row_index", *CHANS)


@query("comp_residual_pairs", VECTOR + ", p AS (SELECT unnest(['e0','e0','e0','e1','e1','e2']) AS a, unnest(['e1','e2','e3','e2','e3','e3']) AS b, unnest([corr(e0,e1),corr(e0,e2),corr(e0,e3),corr(e1,e2),corr(e1,e3),corr(e2,e3)]) AS r FROM ev) SELECT a, b, round(r, 6) AS r, abs(round(r, 6)) > 0.02 AS flagged, CASE WHEN r > 0 THEN 'under' ELSE 'over' END AS direction FROM p ORDER BY abs(r) DESC")
def comp_residual_pairs(spark, sf_dir):
    return compensation.residual_pairs(vector_events(spark, sf_dir, 4), CHANS, 0.02).orderBy(F.abs("r").desc())


CONTROL = VECTOR + ", k AS (SELECT CASE cluster WHEN 0 THEN 'c0' WHEN 1 THEN 'c1' END AS sample, 'e' || cluster AS prim, e0, e1, e2 FROM ev WHERE cluster IN (0, 1)), m AS (SELECT sample, prim, median(CASE WHEN (prim = 'e0' AND e0 >= 0) OR (prim = 'e1' AND e1 >= 0) THEN e0 END) AS e0, median(CASE WHEN (prim = 'e0' AND e0 >= 0) OR (prim = 'e1' AND e1 >= 0) THEN e1 END) AS e1, median(CASE WHEN (prim = 'e0' AND e0 >= 0) OR (prim = 'e1' AND e1 >= 0) THEN e2 END) AS e2 FROM k GROUP BY ALL)"


@query("comp_spillover_rows", CONTROL + ", r AS (SELECT sample, prim, CASE prim WHEN 'e0' THEN e0 + 0.5 ELSE e1 + 0.5 END AS own, unnest(['e0','e1','e2']) AS target, unnest([e0 + 0.5, e1 + 0.5, e2]) AS v FROM m) SELECT sample, target, CASE WHEN target = prim THEN 1.0 WHEN own = 0 THEN 0 ELSE round(v / own, 5) END AS coef FROM r")
def comp_spillover_rows(spark, sf_dir):
    """Rows of the matrix from single-stain controls, over a baseline."""
    k = vector_events(spark, sf_dir, 3).where("cluster in (0, 1)").select(F.concat(F.lit("c"), F.col("cluster").cast("string")).alias("sample"), F.concat(F.lit("e"), F.col("cluster").cast("string")).alias("primary"), "e0", "e1", "e2")
    own = F.when(F.col("primary") == "e0", F.col("e0")).otherwise(F.col("e1"))
    return compensation.spillover_rows(k, ["e0", "e1", "e2"], own >= 0, {"e0": -0.5, "e1": -0.5})


@query("comp_slopes", VECTOR + " SELECT cluster, round(sum(e0 * e1) / sum(e0 * e0), 6) AS e1, round(sum(e0 * e2) / sum(e0 * e0), 6) AS e2 FROM ev GROUP BY cluster")
def comp_slopes(spark, sf_dir):
    s = compensation.slopes(vector_events(spark, sf_dir, 3), ["cluster"], F.col("e0"), {"e1": F.col("e1"), "e2": F.col("e2")})
    return s.select("cluster", F.round("e1", 6).alias("e1"), F.round("e2", 6).alias("e2"))


@query("comp_huber_slopes")
def comp_huber_slopes(spark, sf_dir):
    return compensation.huber_slopes(vector_events(spark, sf_dir, 2), ["cluster"], "e0", "e1")


@query("comp_stain_index", STREAM + ", s AS (SELECT sample, round((median(CASE WHEN fl1_a >= 100 THEN fl1_a END) - median(CASE WHEN fl1_a < 100 THEN fl1_a END)) / (2 * greatest(stddev_pop(CASE WHEN fl1_a < 100 THEN fl1_a END), 1e-9)), 2) AS stain_index FROM ev GROUP BY sample) SELECT *, CASE WHEN stain_index >= 5 THEN 'Good' WHEN stain_index >= 2 THEN 'Moderate' ELSE 'Weak' END AS verdict FROM s")
def comp_stain_index(spark, sf_dir):
    return compensation.stain_index(stream_events(spark, sf_dir), ["sample"], "fl1_a", F.lit(100.0)).orderBy(F.col("stain_index").desc())


@query("comp_brightest_detector", VECTOR + ", m AS (SELECT cluster, median(e0) AS e0, median(e1) AS e1, median(e2) AS e2, median(e3) AS e3 FROM ev GROUP BY cluster) SELECT cluster, CASE greatest(e0, e1, e2, e3) WHEN e0 THEN 'e0' WHEN e1 THEN 'e1' WHEN e2 THEN 'e2' ELSE 'e3' END AS channel FROM m")
def comp_brightest_detector(spark, sf_dir):
    m = vector_events(spark, sf_dir, 4).groupBy("cluster").agg(*[F.median(c).alias(c) for c in CHANS])
    return analysis.long(m, ["cluster"], CHANS).groupBy("cluster").agg(F.max_by("channel", "value").alias("channel"))


@query("comp_first_spill", "SELECT min(p_partkey) AS file, arg_min(p_name, p_partkey) AS spill FROM part WHERE p_size > 10")
def comp_first_spill(spark, sf_dir):
    """The first file, in order, that carries a matrix."""
    return table(spark, sf_dir, "part").where("p_size > 10").agg(F.min("p_partkey").alias("file"), F.min_by("p_name", "p_partkey").alias("spill"))


@query("suggest_transform", "WITH a AS (SELECT 'acctbal' AS channel, 100.0::DOUBLE * count_if(c_acctbal < 0) / count(*) AS pct FROM customer UNION ALL SELECT 'price', 100.0::DOUBLE * count_if(l_extendedprice < 0) / count(*) FROM lineitem) SELECT channel, round(pct, 6) AS pct_negative, CASE WHEN pct > 2 THEN 'logicle' ELSE 'arcsinh' END AS method FROM a")
def suggest_transform(spark, sf_dir):
    def one(name: str, df: DataFrame, c: str) -> DataFrame:
        return df.agg(F.lit(name).alias("channel"), (F.lit(100.0) * F.count_if(F.col(c) < 0) / F.count("*")).alias("pct"))

    a = one("acctbal", table(spark, sf_dir, "customer"), "c_acctbal").unionByName(one("price", table(spark, sf_dir, "lineitem"), "l_extendedprice"))
    return a.select("channel", F.round("pct", 6).alias("pct_negative"), F.when(F.col("pct") > 2, "logicle").otherwise("arcsinh").alias("method"))


# ---- time ----


@query(
    "kinetic_curves",
    STREAM + ", r AS (SELECT min(time) AS lo, max(time) AS hi FROM ev), b AS (SELECT sample, least(49, floor((time - lo) / ((hi - lo) / 50.0::DOUBLE)))::INTEGER AS bin, median(fl1_a) AS m FROM ev, r GROUP BY ALL) SELECT CASE WHEN sample < 'p' THEN 'a' ELSE sample END AS grp, bin, round(avg(m), 5) AS mfi, round(stddev_pop(m), 5) AS sd, round(greatest(0, avg(m) - stddev_pop(m)), 5) AS low FROM b GROUP BY ALL",
)
def kinetic_curves(spark, sf_dir):
    ev = stream_events(spark, sf_dir)
    groups = ev.where("sample < 'p'").select("sample", F.lit("a").alias("grp")).distinct()
    k = analysis.kinetic(ev, "fl1_a", 50, groups)
    return k.select("grp", "bin", *[F.round(c, 5).alias(c) for c in ("mfi", "sd", "low")])


@query("longitudinal_series", "WITH f AS (SELECT o_custkey::VARCHAR AS subject, o_orderpriority AS t, sum(o_totalprice) AS value FROM orders GROUP BY ALL), n AS (SELECT subject, try_cast(substr(t, 1, 1) AS DOUBLE) AS t, value FROM f) SELECT subject, t, round(value, 2) AS value, round(value - lag(value) OVER (PARTITION BY subject ORDER BY t), 2) AS change FROM n WHERE t IS NOT NULL")
def longitudinal_series(spark, sf_dir):
    """Values of a subject in order of time, with the change from the time before."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("subject"), F.col("o_orderpriority").alias("p")).agg(F.sum("o_totalprice").alias("value")).withColumn("sample", F.concat("subject", F.lit("|"), "p"))
    meta = o.select("sample", "subject", F.substring("p", 1, 1).alias("t"))
    s = analysis.longitudinal(o.select("sample", "value"), meta)
    return s.select("subject", "t", F.round("value", 2).alias("value"), F.round("change", 2).alias("change"))


# ---- quadrants, phases, generations ----


@query("apoptosis_quadrants", STREAM + ", q AS (SELECT sample, CASE WHEN fl1_a >= 50 AND fl2_a >= 50 THEN 'late' WHEN fl1_a >= 50 THEN 'early' WHEN fl2_a >= 50 THEN 'necrotic' ELSE 'live' END AS quadrant FROM ev), n AS (SELECT sample, count(*) AS n FROM ev GROUP BY sample) SELECT q.sample, quadrant, count(*) AS count, round(100.0::DOUBLE * count(*) / any_value(n), 6) AS pct FROM q JOIN n USING (sample) GROUP BY q.sample, quadrant")
def apoptosis_quadrants(spark, sf_dir):
    return analysis.quadrant_table(stream_events(spark, sf_dir), "fl1_a", "fl2_a", 50.0, 50.0).where("count > 0")


@query("proliferation_indices", "WITH g AS (SELECT l_linenumber - 1 AS gen, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT gen, n / pow(2.0, gen) AS p FROM g) SELECT round(sum(gen * p) / sum(p), 6) AS division_index, round(sum(gen * p) / sum(CASE WHEN gen >= 1 THEN p END), 6) AS proliferation_index, round(100 * sum(CASE WHEN gen >= 1 THEN p END) / sum(p), 6) AS pct_divided FROM p")
def proliferation_indices(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") - 1).alias("gen")).agg(F.count("*").alias("n"))
    return analysis.proliferation_indices(g).select(*[F.round(c, 6).alias(c) for c in ("division_index", "proliferation_index", "pct_divided")])


DNA = "WITH ev AS (SELECT (l_orderkey % 3)::VARCHAR AS sample, CASE WHEN l_linenumber <= 4 THEN 100 + (l_partkey % 41) / 4.0 + (l_suppkey % 17) / 4.0 WHEN l_linenumber <= 5 THEN 110 + (l_partkey % 90) * 1.0 ELSE 200 + (l_partkey % 41) / 2.0 + (l_suppkey % 17) / 2.0 END AS v FROM lineitem)"


def dna_events(spark, sf_dir):
    """A DNA channel with two peaks, the second at twice the first."""
    li = table(spark, sf_dir, "lineitem")
    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    v = F.when(n <= 4, F.lit(100) + (p % 41) / 4.0 + (s % 17) / 4.0).when(n <= 5, F.lit(110) + (p % 90) * 1.0).otherwise(F.lit(200) + (p % 41) / 2.0 + (s % 17) / 2.0)
    return li.select((F.col("l_orderkey") % 3).cast("string").alias("sample"), v.cast("double").alias("v"))


def dna_histogram(spark, sf_dir):
    ev = dna_events(spark, sf_dir).where("v > 0")
    top = ev.groupBy("sample").agg(F.percentile("v", 0.995).alias("top"), F.count("*").alias("n")).where("n >= 100")
    return histograms.histogram(ev.join(F.broadcast(top), "sample").where("v <= top"), ["sample"], "v", 256)


@query("cell_cycle_histogram", DNA + ", t AS (SELECT sample, quantile_cont(v::DOUBLE, 0.995::DOUBLE) AS top FROM ev GROUP BY sample), k AS (SELECT ev.* FROM ev JOIN t USING (sample) WHERE v <= top), r AS (SELECT sample, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi FROM k GROUP BY sample) SELECT sample, least(255, floor((v::DOUBLE - lo) / ((hi - lo) / 256.0::DOUBLE)))::INTEGER AS bin, count(*) AS n FROM k JOIN r USING (sample) GROUP BY ALL")
def cell_cycle_histogram(spark, sf_dir):
    return dna_histogram(spark, sf_dir).where("n > 0").select("sample", "bin", "n")


@query("cell_cycle_fit")
def cell_cycle_fit(spark, sf_dir):
    """Fractions of the phases by sample: the histogram comes from Spark, 256 numbers a sample are fitted."""

    def fit(pdf):
        import pandas as pd

        pdf = pdf.sort_values("bin")
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        out = models.cell_cycle((lo + (np.arange(256) + 0.5) * (hi - lo) / 256), pdf["n"].to_numpy(float))
        return pd.DataFrame([{"sample": pdf["sample"].iloc[0], **{k: float(out[k]) for k in ("pct_g1", "pct_s", "pct_g2", "mu_g1", "mu_g2", "cv_g1", "cv_g2", "r2", "rmse")}}])

    return dna_histogram(spark, sf_dir).groupBy("sample").applyInPandas(fit, "sample string, pct_g1 double, pct_s double, pct_g2 double, mu_g1 double, mu_g2 double, cv_g1 double, cv_g2 double, r2 double, rmse double")


@query("cell_cycle_bounds", "WITH p AS (SELECT n_nationkey, 60.0::DOUBLE + 4 * n_nationkey AS m1, 3.0::DOUBLE + n_nationkey % 7 * 6 AS s1, 120.0::DOUBLE + 8 * n_nationkey AS m2, 5.0::DOUBLE + n_regionkey * 9 AS s2 FROM nation) SELECT n_nationkey, greatest(20, least(300, CASE WHEN m1 + 1.5 * s1 >= m2 - 1.5 * s2 THEN (m1 + 1.5 * s1 + m2 - 1.5 * s2) / 2 ELSE m1 + 1.5 * s1 END))::DOUBLE AS g1_hi, greatest(20, least(300, CASE WHEN m1 + 1.5 * s1 >= m2 - 1.5 * s2 THEN (m1 + 1.5 * s1 + m2 - 1.5 * s2) / 2 ELSE m2 - 1.5 * s2 END))::DOUBLE AS g2_lo FROM p")
def cell_cycle_bounds(spark, sf_dir):
    """Bounds of phases from peaks and widths, which each nation's numbers give."""
    from gateloom.functions.scalars import phase_bounds

    n, r = F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")
    p = table(spark, sf_dir, "nation").select("n_nationkey", (n * 4 + 60).alias("m1"), (n % 7 * 6 + 3).alias("s1"), (n * 8 + 120).alias("m2"), (r * 9 + 5).alias("s2"))
    a, b = phase_bounds(*[F.col(c) for c in ("m1", "s1", "m2", "s2")], F.lit(20.0), F.lit(300.0))
    return p.select("n_nationkey", a.alias("g1_hi"), b.alias("g2_lo"))


@query("proliferation_fit")
def proliferation_fit(spark, sf_dir):
    """Generations by sample from a log10 dye histogram."""
    li = table(spark, sf_dir, "lineitem")
    dye = li.select((F.col("l_orderkey") % 2).cast("string").alias("sample"), (F.lit(3.5) - (F.col("l_linenumber") % 4) * F.lit(0.30103) + ((F.col("l_partkey") % 61) + (F.col("l_suppkey") % 37) - 48) / 900.0).alias("v"))
    h = histograms.histogram(dye, ["sample"], "v", 256, low=0.5, high=99.7)

    def fit(pdf):
        import pandas as pd

        pdf = pdf.sort_values("bin")
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        g = models.generations(lo + (np.arange(256) + 0.5) * (hi - lo) / 256, pdf["n"].to_numpy(float))
        return pd.DataFrame([{"sample": pdf["sample"].iloc[0], "gen": k, "area": a} for k, a in g])

    return h.groupBy("sample").applyInPandas(fit, "sample string, gen int, area double")


@query("threshold_models")
def threshold_models(spark, sf_dir):
    """Valley, Yen, Li and mixture thresholds by sample, on a histogram of 256 bins."""
    h = histograms.histogram(stream_events(spark, sf_dir), ["sample"], "fl1_a", 256, low=0.5, high=99.5)

    def fit(pdf):
        import pandas as pd

        pdf = pdf.sort_values("bin")
        lo, hi, y = pdf["lo"].iloc[0], pdf["hi"].iloc[0], pdf["n"].to_numpy(float)
        x = lo + (np.arange(256) + 0.5) * (hi - lo) / 256
        m, _, _ = models.gmm(np.repeat(x, y.astype(int)) if y.sum() < 20_000 else np.repeat(x, (y * 20_000 / y.sum()).astype(int)))
        p95 = float(x[np.searchsorted(np.cumsum(y), 0.95 * y.sum())])
        return pd.DataFrame([{"sample": pdf["sample"].iloc[0], "valley": models.valley(lo, hi, y, p95), "yen": float(x[models.yen(y)]), "li": models.li(x, y), "mixture": float(m.mean())}])

    return h.groupBy("sample").applyInPandas(fit, "sample string, valley double, yen double, li double, mixture double")


# ---- group tests ----


@query("test_kruskal", STREAM + ", r AS (SELECT sample, rank() OVER (ORDER BY fl1_a) + (count(*) OVER (PARTITION BY fl1_a) - 1) / 2.0::DOUBLE AS r FROM ev), g AS (SELECT sample, sum(r) AS s, count(*) AS c FROM r GROUP BY sample), t AS (SELECT sum(pow(t, 3) - t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM ev GROUP BY fl1_a)), o AS (SELECT sum(s * s / c) AS q, sum(c)::DOUBLE AS n, count(*) AS k FROM g) SELECT round((12.0::DOUBLE / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (pow(n, 3) - n)), 5) AS h, k AS groups, n::BIGINT AS n FROM o, t")
def test_kruskal(spark, sf_dir):
    return analysis.kruskal_wallis(stream_events(spark, sf_dir), "sample", "fl1_a").withColumn("h", F.round("h", 5))


@query("test_dunn", STREAM + ", r AS (SELECT sample, rank() OVER (ORDER BY fl1_a) + (count(*) OVER (PARTITION BY fl1_a) - 1) / 2.0::DOUBLE AS r FROM ev), g AS (SELECT sample, avg(r) AS m, count(*)::DOUBLE AS c FROM r GROUP BY sample), t AS (SELECT sum(pow(t, 3) - t) AS ties, sum(t) AS n FROM (SELECT count(*)::DOUBLE AS t FROM ev GROUP BY fl1_a)) SELECT a.sample AS a, b.sample AS b, round(abs(a.m - b.m) / sqrt((n * (n + 1) / 12 - ties / (12 * (n - 1))) * (1 / a.c + 1 / b.c)), 5) AS z FROM g a JOIN g b ON a.sample < b.sample, t")
def test_dunn(spark, sf_dir):
    return analysis.dunn(stream_events(spark, sf_dir), "sample", "fl1_a").withColumn("z", F.round("z", 5))


@query("test_mann_whitney", "WITH ev AS (SELECT c_mktsegment AS g, c_acctbal AS x FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')), r AS (SELECT g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS r FROM ev), t AS (SELECT sum(pow(t, 3) - t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM ev GROUP BY x)), o AS (SELECT sum(CASE WHEN g = 'BUILDING' THEN r END) AS r1, count_if(g = 'BUILDING')::DOUBLE AS a, count_if(g <> 'BUILDING')::DOUBLE AS b FROM r) SELECT round(r1 - a * (a + 1) / 2, 4) AS u, round((abs(r1 - a * (a + 1) / 2 - a * b / 2) - 0.5) / sqrt(a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1)))), 5) AS z FROM o, t")
def test_mann_whitney(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    r = analysis.mann_whitney(c.where("c_acctbal is not null"), "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY")
    return r.select(F.round("u", 4).alias("u"), F.round("z", 5).alias("z"))


@query("test_comparison")
def test_comparison(spark, sf_dir):
    """The test that the groups call for, with its p-value and stars; a row for each comparison."""
    ev = stream_events(spark, sf_dir)
    h = analysis.kruskal_wallis(ev, "sample", "fl1_a").first()
    p = models.chi2_sf(h["h"], h["groups"] - 1)
    rows = [("Kruskal-Wallis", "all", p)]
    if p < 0.05:
        d = analysis.dunn(ev, "sample", "fl1_a").collect()  # a row for each pair of groups
        rows += [("Dunn", f"{r['a']} vs {r['b']}", min(1.0, 2 * models.normal_sf(r["z"]) * len(d))) for r in d]
    from gateloom.functions.scalars import stars

    return spark.createDataFrame(rows, "test string, pair string, p double").withColumn("stars", stars(F.col("p")))


# ---- clusters, embeddings, classifiers ----


@query("cluster_table", VECTOR + " SELECT cluster, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM ev), 6) AS pct, round(median(e0), 6) AS e0, round(median(e1), 6) AS e1 FROM ev GROUP BY cluster")
def cluster_table(spark, sf_dir):
    t = analysis.cluster_table(vector_events(spark, sf_dir), ["e0", "e1"])
    return t.select("cluster", "n", *[F.round(c, 6).alias(c) for c in ("pct", "e0", "e1")])


ZS = VECTOR + ", m AS (SELECT cluster, unnest(['e0', 'e1', 'e2']) AS channel, unnest([median(e0), median(e1), median(e2)]) AS value FROM ev GROUP BY cluster)"


def cluster_medians(spark, sf_dir):
    t = analysis.cluster_table(vector_events(spark, sf_dir, 3), ["e0", "e1", "e2"])
    return analysis.long(t, ["cluster"], ["e0", "e1", "e2"])


@query("cluster_z_heatmap", ZS + " SELECT cluster, channel, round((value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w < 1e-9 THEN 1 ELSE stddev_pop(value) OVER w END, 5) AS z FROM m WINDOW w AS (PARTITION BY channel)")
def cluster_z_heatmap(spark, sf_dir):
    return analysis.z_scores(cluster_medians(spark, sf_dir), "channel", "value").select("cluster", "channel", F.round("z", 5).alias("z"))


@query("cluster_calls", ZS + ", z AS (SELECT *, value - avg(value) OVER w AS d, stddev_pop(value) OVER w AS s FROM m WINDOW w AS (PARTITION BY channel)), g AS (SELECT unnest(['e0', 'e1', 'e2']) AS channel, unnest([median(e0), median(e1), median(e2)]) AS cut FROM ev) SELECT cluster, z.channel, s > 0 AND d / s > 0 AS by_z, value > cut AS by_median, value > 0.01 AS by_threshold FROM z JOIN g USING (channel)")
def cluster_calls(spark, sf_dir):
    """Positive or not by cluster and channel: by z, above the median of all events, above a threshold."""
    m = cluster_medians(spark, sf_dir)
    w = Window.partitionBy("channel")
    sd = F.stddev_pop("value").over(w)
    cuts = analysis.long(vector_events(spark, sf_dir, 3).agg(*[F.median(c).alias(c) for c in ("e0", "e1", "e2")]), [], ["e0", "e1", "e2"], value="cut")
    out = m.withColumn("by_z", F.when(sd > 0, (F.col("value") - F.avg("value").over(w)) / sd > 0).otherwise(False)).join(F.broadcast(cuts), "channel")
    return out.select("cluster", "channel", "by_z", (F.col("value") > F.col("cut")).alias("by_median"), (F.col("value") > 0.01).alias("by_threshold"))


@query("cluster_names", ZS + ", c AS (SELECT cluster, max(CASE WHEN channel = 'e0' THEN value END) AS e0, max(CASE WHEN channel = 'e1' THEN value END) AS e1, max(CASE WHEN channel = 'e2' THEN value END) AS e2 FROM m GROUP BY cluster) SELECT cluster, CASE WHEN e0 > 0 AND e1 > 0 THEN 'double' WHEN e0 > 0 OR e1 > 0 OR e2 > 0 THEN concat_ws(' ', CASE WHEN e0 > 0 THEN 'e0+' END, CASE WHEN e1 > 0 THEN 'e1+' END, CASE WHEN e2 > 0 THEN 'e2+' END) ELSE 'Cluster ' || cluster END AS name FROM c")
def cluster_names(spark, sf_dir):
    """The first rule that a cluster meets, else its positive channels, else a number."""
    t = analysis.cluster_table(vector_events(spark, sf_dir, 3), ["e0", "e1", "e2"])
    tags = F.concat_ws(" ", *[F.when(F.col(c) > 0, F.lit(f"{c}+")) for c in ("e0", "e1", "e2")])
    rule = F.when((F.col("e0") > 0) & (F.col("e1") > 0), "double")
    return t.select("cluster", F.coalesce(rule, F.when(tags != "", tags), F.concat(F.lit("Cluster "), F.col("cluster").cast("string"))).alias("name"))


@query("cluster_dense_labels", VECTOR + " SELECT row_index, (dense_rank() OVER (ORDER BY CASE WHEN label < 0 THEN 1 ELSE 0 END, label) - 1)::INTEGER AS dense FROM (SELECT row_index, CASE WHEN cluster = 4 THEN -1 ELSE cluster * 3 END AS label FROM ev)")
def cluster_dense_labels(spark, sf_dir):
    ev = vector_events(spark, sf_dir, 1).withColumn("label", F.when(F.col("cluster") == 4, F.lit(-1)).otherwise(F.col("cluster") * 3))
    return analysis.dense_labels(ev, "label").select("row_index", "dense")


@query("embedding_input", LINE + ", k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY md5('42|' || sample || '|' || row_index)) AS k FROM ev WHERE NOT fl2_a >= 0.07) SELECT sample, row_index, round(asinh(fsc_a / 150.0), 6) AS fsc_a, round(asinh(fl1_a / 150.0), 9) AS fl1_a FROM k WHERE k <= 40")
def embedding_input(spark, sf_dir):
    """The pooled table that an embedding starts from: filtered, as many rows of each sample, transformed."""
    p = embedding.pooled(lineitem_events(spark, sf_dir, with_index=True), ["fsc_a", "fl1_a"], 40, positivity={"fl2_a": 0.07})
    return p.select("sample", "row_index", F.round("fsc_a", 6).alias("fsc_a"), F.round("fl1_a", 9).alias("fl1_a"))


@query("embedding_axis_range", VECTOR + ", r AS (SELECT min(e0) AS a, max(e0) AS b FROM ev) SELECT round(a - 0.04::DOUBLE * (b - a), 6) AS low, round(b + 0.04::DOUBLE * (b - a), 6) AS high FROM r")
def embedding_axis_range(spark, sf_dir):
    r = vector_events(spark, sf_dir, 1).agg(F.min("e0").alias("a"), F.max("e0").alias("b"))
    pad = (F.col("b") - F.col("a")) * 0.04
    return r.select(F.round(F.col("a") - pad, 6).alias("low"), F.round(F.col("b") + pad, 6).alias("high"))


@query("embedding_tsne")
def embedding_tsne(spark, sf_dir):
    return embedding.tsne(vector_events(spark, sf_dir), [f"e{i}" for i in range(8)], "cluster", 30, rounds=150)


@query("embedding_pca")
def embedding_pca(spark, sf_dir):
    return embedding.pca(vector_events(spark, sf_dir), [f"e{i}" for i in range(8)])


@query("cluster_kmeans")
def cluster_kmeans(spark, sf_dir):
    return embedding.kmeans(vector_events(spark, sf_dir), [f"e{i}" for i in range(8)], 5)


@query("cluster_som")
def cluster_som(spark, sf_dir):
    return embedding.som_clusters(vector_events(spark, sf_dir), [f"e{i}" for i in range(8)], 6)


@query("cluster_phenograph")
def cluster_phenograph(spark, sf_dir):
    return embedding.graph_clusters(vector_events(spark, sf_dir), [f"e{i}" for i in range(8)], 15)


@query("cluster_mixture")
def cluster_mixture(spark, sf_dir):
    return embedding.mixture_clusters(vector_events(spark, sf_dir), [f"e{i}" for i in range(4)], 4)


@query("cluster_grid")
def cluster_grid(spark, sf_dir):
    """Few rows for five components, so coarse cells."""
    return embedding.grid_clusters(vector_events(spark, sf_dir), [f"e{i}" for i in range(8)], bins=6, dense=2, core=8)


@query("classifier_features", "WITH f AS (SELECT l_returnflag || l_linestatus AS sample, 'ship' || l_linenumber AS feature, count(*) AS c FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL), t AS (SELECT l_returnflag || l_linestatus AS sample, count(*) AS n FROM lineitem GROUP BY 1) SELECT f.sample, feature, round(100.0::DOUBLE * c / n, 6) AS value, round((100.0::DOUBLE * c / n - avg(100.0::DOUBLE * c / n) OVER w) / stddev_pop(100.0::DOUBLE * c / n) OVER w, 4) AS z FROM f JOIN t USING (sample) WINDOW w AS (PARTITION BY feature)")
def classifier_features(spark, sf_dir):
    """Percent of all events by gate and sample, and its z over samples (population SD)."""
    li = table(spark, sf_dir, "lineitem").withColumn("sample", F.concat("l_returnflag", "l_linestatus"))
    n = li.groupBy("sample").agg(F.count("*").alias("n"))
    f = li.where("l_linenumber <= 3").groupBy("sample", F.concat(F.lit("ship"), F.col("l_linenumber").cast("string")).alias("feature")).agg(F.count("*").alias("c"))
    v = f.join(F.broadcast(n), "sample").withColumn("value", F.lit(100.0) * F.col("c") / F.col("n"))
    return analysis.z_scores(v, "feature", "value", 0.0).select("sample", "feature", F.round("value", 6).alias("value"), F.round("z", 4).alias("z"))


@query("classifier_importance")
def classifier_importance(spark, sf_dir):
    return embedding.forest_importance(vector_events(spark, sf_dir), [f"e{i}" for i in range(8)], "cluster")


# ---- panels ----


PANEL = ["FITC-A", "PE-A", "AF647-A", "APC-A", "GFP-A", "Time"]
FLUORS = {"FITC-A": ("fitc", 519), "PE-A": ("pe", 578), "AF647-A": ("af647", 668), "APC-A": ("apc", 660), "GFP-A": ("gfp", 509)}


@query("spectral_conflicts", "WITH n AS (SELECT min(p_partkey) AS i, ([" + ", ".join(f"'{c}'" for c in PANEL) + "])[p_partkey % 6 + 1] AS channel FROM part GROUP BY 2), p AS (SELECT * FROM n JOIN (VALUES " + ", ".join(f"('{c}', '{f}', {e})" for c, (f, e) in FLUORS.items()) + ") t(channel, fluor, em) USING (channel)) SELECT a.channel AS channel_a, b.channel AS channel_b, a.fluor AS fluor_a, b.fluor AS fluor_b, abs(a.em - b.em) AS gap FROM p a JOIN p b ON a.i < b.i AND abs(a.em - b.em) <= 30")
def spectral_conflicts(spark, sf_dir):
    """Channels of a panel, named by the parts, whose colours lie too near."""
    from gateloom.functions.scalars import emission, fluorochrome

    name = F.element_at(F.array(*map(F.lit, PANEL)), (F.col("p_partkey") % 6 + 1).cast("int"))
    c = table(spark, sf_dir, "part").groupBy(name.alias("channel")).agg(F.min("p_partkey").alias("i"))
    f = fluorochrome(F.col("channel"))
    return analysis.spectral_conflicts(c.select("i", "channel", f.alias("fluor"), emission(f).alias("em")).where("em is not null"))
