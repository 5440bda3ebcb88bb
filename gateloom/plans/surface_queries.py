"""Queries over surfaces, shapes, and what remains of tables and filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from gateloom.core.bind import EVENTS_CTE, LINEITEM_CTE, VECTOR_CTE, lineitem_events, stream_events, table, vector_events
from gateloom.operators import analysis, embedding, histograms, models, statistics, surfaces
from gateloom.operators.gates import Gate, Population, percent, tree_counts
from gateloom.plans.gate_queries import CELLS, CHILD, ELLIPSE, SQL_CELLS, SQL_CHILD
from gateloom.plans.registry import query
from gateloom.sources.workspace import Session, tree_rows

LINE, STREAM, VECTOR = (f"WITH {c}" for c in (LINEITEM_CTE, EVENTS_CTE, VECTOR_CTE))


@query("surface_smooth_density")
def surface_smooth_density(spark, sf_dir):
    """The blurred grid, a row for each cell."""
    s = surfaces.surface(lineitem_events(spark, sf_dir), "fsc_a", "ssc_a")
    return spark.createDataFrame([(i, j, float(v)) for (j, i), v in np.ndenumerate(s.grid)], "px int, py int, density double")


@query("surface_gate_confidence")
def surface_gate_confidence(spark, sf_dir):
    ev = lineitem_events(spark, sf_dir)
    s = surfaces.surface(ev, "fsc_a", "ssc_a")
    return spark.createDataFrame([(n, surfaces.boundary_confidence(s, g)) for n, g in (("Cells", CELLS), ("Ellipse", ELLIPSE), ("Interval", Gate("interval", "fsc_a", None, (2e4, 8e4))))], "gate string, confidence double")


@query("surface_edge_confidence")
def surface_edge_confidence(spark, sf_dir):
    s = surfaces.surface(lineitem_events(spark, sf_dir), "fsc_a", "ssc_a")
    return spark.createDataFrame(surfaces.edge_confidence(s, CELLS), "edge int, verdict string")


@query("surface_valleys")
def surface_valleys(spark, sf_dir):
    """Places between peaks of a channel, where a gate's edge snaps to. The channel is made of order lines: the line's number decides the peak, a hash the scatter about it."""
    noise = F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"), F.lit(1000)) / 1000.0 + F.pmod(F.xxhash64("l_suppkey", "l_orderkey", "l_linenumber"), F.lit(1000)) / 1000.0 - 1
    ev = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("sample"), (F.col("l_linenumber") % 3 * 4 + noise).alias("fl1_a"))
    h = histograms.gaussian_blur(histograms.histogram(ev, ["sample"], "fl1_a", 128), ["sample"], 3, 128)

    def find(pdf):
        import pandas as pd

        y = pdf.sort_values("bin")["blur"].to_numpy()
        return pd.DataFrame([(str(pdf["sample"].iloc[0]), k) for k in surfaces.valleys(y)] or None, columns=["sample", "bin"])

    return h.groupBy("sample").applyInPandas(find, "sample string, bin int")


@query("population_outline")
def population_outline(spark, sf_dir):
    """A concave outline of each cluster in two channels."""
    return surfaces.outlines(vector_events(spark, sf_dir, 2), ["cluster"], "e0", "e1").withColumnRenamed("x", "e0").withColumnRenamed("y", "e1")



@query("filter_debris")
def filter_debris(spark, sf_dir):
    """Events by sample outside the lower of two components of log magnitude; the fit takes at most 5,000 events of a sample by hash."""
    ev = lineitem_events(spark, sf_dir, with_index=True)
    m = F.log1p(F.hypot(F.greatest("fsc_a", F.lit(0.0)), F.greatest("ssc_a", F.lit(0.0))))
    picked = analysis.equal_sample(ev.withColumn("m", m), 5_000).select("sample", "m")

    def fit(pdf):
        import pandas as pd

        x = pdf["m"].dropna().to_numpy()
        if len(x) < 40:
            return pd.DataFrame([(pdf["sample"].iloc[0], *[0.0] * 6)], columns=["sample", "m0", "s0", "w0", "m1", "s1", "w1"])
        c, s, w = models.gmm(x)
        return pd.DataFrame([(pdf["sample"].iloc[0], c[0], s[0], w[0], c[1], s[1], w[1])], columns=["sample", "m0", "s0", "w0", "m1", "s1", "w1"])

    fits = picked.groupBy("sample").applyInPandas(fit, "sample string, m0 double, s0 double, w0 double, m1 double, s1 double, w1 double")
    like = lambda i: F.log(F.col(f"w{i}") / F.col(f"s{i}")) - F.pow((F.col("m") - F.col(f"m{i}")) / F.col(f"s{i}"), F.lit(2.0)) / 2
    kept = lineitem_events(spark, sf_dir).withColumn("m", m).join(F.broadcast(fits), "sample").where(F.when(F.col("w0") > 0, like(1) >= like(0)).otherwise(True))
    return kept.groupBy("sample").agg(F.count("*").alias("n"))


@query("comp_separation_histogram", STREAM + ", t AS (SELECT sample, asinh(fl1_a / 150.0) AS t FROM ev), r AS (SELECT sample, quantile_cont(t, 0.005::DOUBLE) AS lo, quantile_cont(t, 0.995::DOUBLE) AS hi FROM t GROUP BY sample) SELECT sample, least(79, floor((t - lo) / ((hi - lo) / 80.0::DOUBLE)))::INTEGER AS bin, count(*) AS n FROM t JOIN r USING (sample) WHERE t BETWEEN lo AND hi GROUP BY ALL")
def comp_separation_histogram(spark, sf_dir):
    ev = stream_events(spark, sf_dir).withColumn("t", F.asinh(F.col("fl1_a") / F.lit(150.0)))
    return histograms.histogram(ev, ["sample"], "t", 80, low=0.5, high=99.5).where("n > 0").select("sample", "bin", "n")


@query("comp_quartile_spillover", VECTOR + ", t AS (SELECT cluster, quantile_cont(e0, 0.75::DOUBLE) AS t FROM ev GROUP BY cluster), b AS (SELECT median(e0) AS b0, median(e1) AS b1 FROM ev) SELECT ev.cluster, round(CASE WHEN median(e0) - any_value(b0) > 0 THEN greatest(0, (median(e1) - any_value(b1)) / (median(e0) - any_value(b0))) ELSE 0 END, 6) AS e1 FROM ev JOIN t USING (cluster), b WHERE e0 >= t GROUP BY ev.cluster")
def comp_quartile_spillover(spark, sf_dir):
    """The other method: positives are the top quartile of the primary channel, negative coefficients count as 0."""
    ev = vector_events(spark, sf_dir, 2)
    b0, b1 = ev.agg(F.median("e0"), F.median("e1")).first()
    top = ev.groupBy("cluster").agg(F.percentile("e0", 0.75).alias("t"))
    m = ev.join(F.broadcast(top), "cluster").where("e0 >= t").groupBy("cluster").agg((F.median("e0") - F.lit(b0)).alias("own"), (F.median("e1") - F.lit(b1)).alias("other"))
    return m.select("cluster", F.round(F.when(F.col("own") > 0, F.greatest(F.lit(0.0), F.col("other") / F.col("own"))).otherwise(0.0), 6).alias("e1"))


@query("comp_threshold_precedence", STREAM + ", o AS (SELECT 'click' AS sample, 42.0::DOUBLE AS cut), m AS (SELECT sample, median(fl1_a) AS m FROM ev GROUP BY sample) SELECT sample, round(coalesce(cut, m), 6) AS threshold FROM m LEFT JOIN o USING (sample)")
def comp_threshold_precedence(spark, sf_dir):
    """A user's threshold goes before a computed one."""
    own = spark.createDataFrame([("click", 42.0)], "sample string, cut double")
    m = stream_events(spark, sf_dir).groupBy("sample").agg(F.median("fl1_a").alias("m"))
    return m.join(F.broadcast(own), "sample", "left").select("sample", F.round(F.coalesce("cut", "m"), 6).alias("threshold"))


@query("stat_frequency_of", LINE + f" SELECT sample, round(100.0::DOUBLE * count_if({SQL_CELLS} AND {SQL_CHILD} AND fl1_a <= 0.06) / count_if({SQL_CELLS} AND {SQL_CHILD}), 6) AS of_parent, round(100.0::DOUBLE * count_if({SQL_CELLS} AND {SQL_CHILD} AND fl1_a <= 0.06) / count_if({SQL_CELLS}), 6) AS of_grandparent, round(100.0::DOUBLE * count_if({SQL_CELLS} AND {SQL_CHILD} AND fl1_a <= 0.06) / count(*), 6) AS of_total FROM ev GROUP BY sample")
def stat_frequency_of(spark, sf_dir):
    """A population as a share of its parent, of that one's parent, and of all events."""
    tree = [Population("Cells", CELLS, (Population("Child", CHILD, (Population("Dim", Gate("interval", "fl1_a", None, (-1.0, 0.06))),)),))]
    t = tree_counts(lineitem_events(spark, sf_dir), tree)
    flat = t.groupBy("sample").agg(*[F.max(F.when(F.col("population") == p, F.col("count"))).alias(k) for p, k in (("Cells", "g"), ("Cells/Child", "p"), ("Cells/Child/Dim", "c"))], F.max("total").alias("n"))
    return flat.select("sample", percent("c", "p").alias("of_parent"), percent("c", "g").alias("of_grandparent"), percent("c", "n").alias("of_total"))


@query("gate_everywhere", LINE + f", s AS (SELECT DISTINCT sample FROM ev) SELECT sample, 'Cells' AS name, 'rectangle' AS type FROM s")
def gate_everywhere(spark, sf_dir):
    """One gate under the root of every sample, in place of one of its name."""
    names = [r["sample"] for r in lineitem_events(spark, sf_dir).select("sample").distinct().collect()]  # a row for each sample
    s = Session(trees={n: (Population("Cells", ELLIPSE),) for n in names[:1]}).gate_everywhere(Population("Cells", CELLS), names)
    return spark.createDataFrame([(r["sample"], r["name"], r["type"]) for r in tree_rows(s.trees)], "sample string, name string, type string")


@query("cell_cycle_gates", "WITH ev AS (SELECT (l_orderkey % 3)::VARCHAR AS sample, CASE WHEN l_linenumber <= 4 THEN 100 + (l_partkey % 41) / 4.0 + (l_suppkey % 17) / 4.0 WHEN l_linenumber <= 5 THEN 110 + (l_partkey % 90) * 1.0 ELSE 200 + (l_partkey % 41) / 2.0 + (l_suppkey % 17) / 2.0 END AS v FROM lineitem) SELECT sample, CASE WHEN v <= 115 THEN 'G0/G1' WHEN v < 199 THEN 'S' ELSE 'G2/M' END AS phase, count(*) AS n FROM ev GROUP BY ALL")
def cell_cycle_gates(spark, sf_dir):
    """The phases as gates on the channel."""
    from gateloom.operators.gates import first_match
    from gateloom.plans.analysis_queries import dna_events

    ev = dna_events(spark, sf_dir)
    phase = {"G0/G1": (-1e9, 115.0), "S": (115.0, 199.0), "G2/M": (199.0, 1e9)}
    at = first_match([Gate("line", "v", None, r).column(["v"]) for r in (phase["G0/G1"], (199.0, 1e9), phase["S"])])
    return ev.groupBy("sample", F.element_at(F.array(F.lit("G0/G1"), F.lit("G2/M"), F.lit("S")), at + 1).alias("phase")).agg(F.count("*").alias("n"))


@query("join_sample_label", STREAM + ", l AS (SELECT 'click' AS sample, 'x' AS label) SELECT coalesce(label, '?') AS label, count(*) AS n FROM ev LEFT JOIN l USING (sample) GROUP BY 1")
def join_sample_label(spark, sf_dir):
    labels = spark.createDataFrame([("click", "x")], "sample string, label string")
    return stream_events(spark, sf_dir).join(F.broadcast(labels), "sample", "left").groupBy(F.coalesce("label", F.lit("?")).alias("label")).agg(F.count("*").alias("n"))


@query("sample_live_estimate")
def sample_live_estimate(spark, sf_dir):
    """A population's size estimated from a sample with replacement, scaled to all rows."""
    ev = lineitem_events(spark, sf_dir)
    n = ev.count()
    picked = ev.sample(True, min(1.0, 40_000 / max(n, 1)), 42)
    r = picked.agg(F.count("*").alias("s"), F.count_if(CELLS.column(ev.columns)).alias("k"))
    return r.select(F.round(statistics.ratio(F.col("k") * F.lit(float(n)), F.col("s").cast("double")), 0).cast("bigint").alias("estimate"))


@query("embedding_facets", VECTOR + " SELECT CASE WHEN cluster < 5 THEN 'a' ELSE 'b' END AS facet, count(*) AS n, round(min(e0), 6) AS low, round(max(e0), 6) AS high FROM ev WHERE cluster <> 9 GROUP BY 1")
def embedding_facets(spark, sf_dir):
    """A panel for each group; the group to ignore has none."""
    grp = F.when(F.col("cluster") < 5, "a").when(F.col("cluster") < 9, "b").otherwise("Ignore")
    return vector_events(spark, sf_dir, 1).withColumn("facet", grp).where("facet <> 'Ignore'").groupBy("facet").agg(F.count("*").alias("n"), F.round(F.min("e0"), 6).alias("low"), F.round(F.max("e0"), 6).alias("high"))


@query("classifier_loadings")
def classifier_loadings(spark, sf_dir):
    """The features that weigh most on the first component."""
    from pyspark.ml.feature import PCA

    names = [f"e{i}" for i in range(8)]
    v = embedding.vectors(embedding.scaled(vector_events(spark, sf_dir), names), names)
    w = PCA(k=2, inputCol="_v", outputCol="_c").fit(v).pc.toArray()[:, 0]
    top = sorted(zip(names, map(float, np.abs(w))), key=lambda r: (-r[1], r[0]))[:8]
    return spark.createDataFrame(top, "feature string, weight double")


@query("cluster_suggestions", VECTOR + " SELECT cluster, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct, round(median(e0), 6) AS median, median(e0) > 0.02 AS positive FROM ev GROUP BY cluster HAVING count(*) >= 10")
def cluster_suggestions(spark, sf_dir):
    """What a suggested population looks like before it is approved."""
    c = vector_events(spark, sf_dir, 1).groupBy("cluster").agg(F.count("*").alias("n"), F.median("e0").alias("m")).where("n >= 10")
    return c.select("cluster", "n", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("pct"), F.round("m", 6).alias("median"), (F.col("m") > 0.02).alias("positive"))


@query("stat_key_values", STREAM + " SELECT sample, count(*) AS \"count\", round(median(fl1_a), 6) AS mfi, round(quantile_cont(fl1_a, 0.9::DOUBLE), 6) AS p90 FROM ev GROUP BY sample")
def stat_key_values(spark, sf_dir):
    """Statistics named by keys."""
    keys = {"count": "count", "mfi": "mfi:fl1_a", "p90": "pct:90:fl1_a"}
    return stream_events(spark, sf_dir).groupBy("sample").agg(*[(statistics.by_key(k) if n == "count" else F.round(statistics.by_key(k), 6)).alias(n) for n, k in keys.items()])
