"""Queries over aggregates, windows, histograms, sampling and thresholds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gateloom.core.bind import CUSTOMER_CTE, EVENTS_CTE, LINEITEM_CTE, VECTOR_CTE, customer_events, lineitem_events, stream_events, table, vector_events
from gateloom.operators import analysis, histograms, statistics
from gateloom.operators.gates import chain, nodes, percent, population
from gateloom.plans.gate_queries import CELLS, CHILD, SQL_CELLS, SQL_CHILD, TREE
from gateloom.plans.registry import query

LINE, STREAM, VECTOR, CUSTOMER = (f"WITH {c}" for c in (LINEITEM_CTE, EVENTS_CTE, VECTOR_CTE, CUSTOMER_CTE))


def by_sample(source, **aggregates):
    """Aggregates of fl1_a by sample; each is a function of the column, as columns need a session."""
    return lambda spark, sf_dir: source(spark, sf_dir).groupBy("sample").agg(*[F.round(f(F.col("fl1_a")), 6).alias(k) for k, f in aggregates.items()])


def quantiles(spark, sf_dir, names: dict[float, str], digits: int = 6):
    """Exact quantiles of fl1_a by sample."""
    q = statistics.quantiles(stream_events(spark, sf_dir), ["sample"], "fl1_a", names)
    return q.select("sample", *[F.round(n, digits).alias(n) for n in names.values()])


def ratio_sql(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0 ELSE ({a}) / ({b}) END"


RSD = "(quantile_cont(fl1_a, 0.8413::DOUBLE) - quantile_cont(fl1_a, 0.1587::DOUBLE)) / 2"
query("stat_mean_median", STREAM + " SELECT sample, round(avg(fl1_a), 6) AS mean, round(median(fl1_a), 6) AS median FROM ev GROUP BY sample")(
    lambda spark, sf_dir: by_sample(stream_events, mean=statistics.mean)(spark, sf_dir).join(quantiles(spark, sf_dir, {0.5: "median"}), "sample")
)
query("stat_sd_cv", STREAM + " SELECT sample, round(stddev_pop(fl1_a), 6) AS sd, round(100 * stddev_pop(fl1_a) / avg(fl1_a), 6) AS cv FROM ev GROUP BY sample")(by_sample(stream_events, sd=statistics.sd, cv=statistics.cv))
query("stat_rsd_rcv", STREAM + f" SELECT sample, round({RSD}, 6) AS rsd, round(100 * {RSD} / median(fl1_a), 6) AS rcv FROM ev GROUP BY sample")(
    lambda spark, sf_dir: quantiles(spark, sf_dir, {0.1587: "low", 0.5: "mid", 0.8413: "high"}, 15).select("sample", F.round((F.col("high") - F.col("low")) / 2, 6).alias("rsd"), F.round(F.lit(100.0) * statistics.ratio((F.col("high") - F.col("low")) / 2, F.col("mid")), 6).alias("rcv"))
)
query("stat_percentiles", STREAM + " SELECT sample, round(quantile_cont(fl1_a, 0.05::DOUBLE), 6) AS p5, round(quantile_cont(fl1_a, 0.333::DOUBLE), 6) AS p33, round(quantile_cont(fl1_a, 1.0::DOUBLE), 6) AS p100 FROM ev GROUP BY sample")(
    lambda spark, sf_dir: quantiles(spark, sf_dir, {0.05: "p5", 0.333: "p33", 1.0: "p100"})
)
query("stat_min_max", CUSTOMER + " SELECT sample, round(min(fl1_a), 6) AS least, round(max(fl1_a), 6) AS most FROM ev GROUP BY sample")(by_sample(customer_events, least=F.min, most=F.max))
query("stat_geomean", CUSTOMER + " SELECT sample, round(exp(avg(CASE WHEN fl1_a > 0 THEN ln(CASE WHEN fl1_a > 0 THEN fl1_a END) END)), 4) AS geomean, count_if(fl1_a <= 0) AS excluded, count(*) AS total FROM ev GROUP BY sample")(
    lambda spark, sf_dir: customer_events(spark, sf_dir).groupBy("sample").agg(F.round(statistics.geomean(F.col("fl1_a")), 4).alias("geomean"), F.count_if(F.col("fl1_a") <= 0).alias("excluded"), F.count("*").alias("total"))
)
query("stat_correlation", VECTOR + " SELECT cluster, round(CASE WHEN stddev_pop(e0) > 0 AND stddev_pop(e1) > 0 THEN covar_pop(e0, e1) / (stddev_pop(e0) * stddev_pop(e1)) ELSE 0 END, 6) AS r, 0.0 AS constant FROM ev GROUP BY cluster")(
    lambda spark, sf_dir: vector_events(spark, sf_dir).groupBy("cluster").agg(F.round(statistics.correlation(F.col("e0"), F.col("e1")), 6).alias("r"), statistics.correlation(F.col("e0"), F.lit(5.0)).alias("constant"))
)
query("stat_box_plot", STREAM + " SELECT sample, quantile_cont(fl1_a, 0.0::DOUBLE) AS low, quantile_cont(fl1_a, 0.25::DOUBLE) AS q1, quantile_cont(fl1_a, 0.5::DOUBLE) AS mid, quantile_cont(fl1_a, 0.75::DOUBLE) AS q3, quantile_cont(fl1_a, 1.0::DOUBLE) AS high FROM ev GROUP BY sample")(
    lambda spark, sf_dir: quantiles(spark, sf_dir, {0.0: "low", 0.25: "q1", 0.5: "mid", 0.75: "q3", 1.0: "high"}, 15)
)


@query("stat_mad", STREAM + ", m AS (SELECT sample, median(fl1_a) AS m FROM ev GROUP BY sample) SELECT sample, round(median(abs(fl1_a - m)), 6) AS mad FROM ev JOIN m USING (sample) GROUP BY sample")
def stat_mad(spark, sf_dir):
    return statistics.mad(stream_events(spark, sf_dir), ["sample"], "fl1_a").withColumn("mad", F.round("mad", 6))


@query("stat_nearest_rank", STREAM + " SELECT sample, fl1_a AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY fl1_a) - 1 AS r, count(*) OVER (PARTITION BY sample) AS n FROM ev) WHERE r = floor(0.95::DOUBLE * (n - 1) + 0.5)")
def stat_nearest_rank(spark, sf_dir):
    """The reference level of a control: the 95th percentile by nearest rank."""
    return statistics.nearest_rank(stream_events(spark, sf_dir), ["sample"], "fl1_a", 95, "p95")


@query("stat_floor_rank", STREAM + " SELECT sample, fl1_a AS p99 FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY fl1_a) - 1 AS r, count(*) OVER (PARTITION BY sample) AS n FROM ev) WHERE r = floor(0.99::DOUBLE * (n - 1))")
def stat_floor_rank(spark, sf_dir):
    return statistics.floor_rank(stream_events(spark, sf_dir), ["sample"], "fl1_a", 99, "p99")


@query("stat_root_table", LINE + " SELECT sample, 'root' AS population, count(*) AS count, 100.0::DOUBLE AS percent_total, round(median(fl1_a), 6) AS fl1_a, round(median(fl2_a), 6) AS fl2_a FROM ev GROUP BY sample")
def stat_root_table(spark, sf_dir):
    """Counts and medians of all fluorescence channels by sample."""
    ev = lineitem_events(spark, sf_dir)
    return ev.groupBy("sample").agg(F.lit("root").alias("population"), F.count("*").alias("count"), F.lit(100.0).alias("percent_total"), *[F.round(statistics.median(F.col(c)), 6).alias(c) for c in ("fl1_a", "fl2_a")])


POP_SQL = LINE + f", p AS (SELECT *, 'Cells' AS population FROM ev WHERE {SQL_CELLS} UNION ALL SELECT *, 'Cells/Child' FROM ev WHERE {SQL_CELLS} AND {SQL_CHILD} UNION ALL SELECT *, 'Cells/Low' FROM ev WHERE {SQL_CELLS} AND fl1_a BETWEEN 0.0 AND 0.03 UNION ALL SELECT *, 'Big' FROM ev WHERE fsc_a BETWEEN 60000.0 AND 1e9)"


@query("stat_population_channels", POP_SQL + ", c AS (SELECT sample, population, unnest(['fl1_a', 'fl2_a', 'ssc_a']) AS channel, unnest([fl1_a, fl2_a, ssc_a]) AS v FROM p) SELECT sample, population, channel, round(median(v), 2) AS value FROM c GROUP BY ALL")
def stat_population_channels(spark, sf_dir):
    """Sample x population x channel for one statistic, in one pass."""
    ev = lineitem_events(spark, sf_dir)
    found = [(p, chain(g, ev.columns)) for p, _, g in nodes(TREE)]
    chans = ("fl1_a", "fl2_a", "ssc_a")
    flat = ev.groupBy("sample").agg(*[v for i, (_, k) in enumerate(found) for v in (F.count_if(k).alias(f"n{i}"), *[F.round(statistics.median(F.when(k, F.col(c))), 2).alias(f"{c}{i}") for c in chans])])
    rows = F.array(*[F.struct(F.lit(p).alias("population"), F.lit(c).alias("channel"), F.col(f"{c}{i}").alias("value"), F.col(f"n{i}").alias("n")) for i, (p, _) in enumerate(found) for c in chans])
    return flat.select("sample", F.explode(rows).alias("r")).select("sample", "r.*").where("n > 0").drop("n")


@query("stat_export_table", LINE + f", g AS (SELECT sample, count(*) AS total, count_if({SQL_CELLS}) AS n, median(CASE WHEN {SQL_CELLS} THEN fl1_a END) AS mfi, 100 * stddev_pop(CASE WHEN {SQL_CELLS} THEN fl1_a END) / avg(CASE WHEN {SQL_CELLS} THEN fl1_a END) AS cv FROM ev GROUP BY sample) SELECT sample, n AS count, round(100.0::DOUBLE * n / total, 6) AS pct_total, round(mfi, 6) AS mfi, round(cv, 6) AS cv, NULL::DOUBLE AS empty_mfi FROM g")
def stat_export_table(spark, sf_dir):
    """The export's rule: an empty population gives no value, not 0."""
    ev = lineitem_events(spark, sf_dir)
    keep = chain([CELLS], ev.columns)
    x = F.when(keep, F.col("fl1_a"))
    g = ev.groupBy("sample").agg(F.count("*").alias("total"), F.count_if(keep).alias("count"), F.round(F.median(x), 6).alias("mfi"), F.round(F.lit(100.0) * F.stddev_pop(x) / F.avg(x), 6).alias("cv"), F.median(F.when(F.lit(False), F.col("fl1_a"))).alias("empty_mfi"))
    return g.select("sample", "count", percent("count", "total").alias("pct_total"), "mfi", "cv", "empty_mfi")


@query("stat_channel_summary", CUSTOMER + " SELECT sample, round(median(fl1_a), 6) AS median, round(avg(fl1_a), 6) AS mean, round(stddev_samp(fl1_a), 6) AS sd, round(100 * stddev_samp(fl1_a) / abs(avg(fl1_a)), 6) AS cv FROM ev GROUP BY sample")
def stat_channel_summary(spark, sf_dir):
    a = customer_events(spark, sf_dir).groupBy("sample").agg(F.median("fl1_a").alias("median"), F.avg("fl1_a").alias("mean"), F.stddev_samp("fl1_a").alias("sd"))
    return a.select("sample", F.round("median", 6).alias("median"), F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round(F.lit(100.0) * statistics.ratio(F.col("sd"), F.abs("mean")), 6).alias("cv"))


FREQ_SQL = LINE + f", t AS (SELECT sample, count(*) AS n FROM ev GROUP BY sample), f AS (SELECT p.population, p.sample, round(100.0::DOUBLE * p.c / t.n, 6) AS pct FROM (SELECT sample, 'Cells' AS population, count_if({SQL_CELLS}) AS c FROM ev GROUP BY sample UNION ALL SELECT sample, 'Cells/Child', count_if({SQL_CELLS} AND {SQL_CHILD}) FROM ev GROUP BY sample UNION ALL SELECT sample, 'Cells/Low', count_if({SQL_CELLS} AND fl1_a BETWEEN 0.0 AND 0.03) FROM ev GROUP BY sample UNION ALL SELECT sample, 'Big', count_if(fsc_a BETWEEN 60000.0 AND 1e9) FROM ev GROUP BY sample) p JOIN t USING (sample))"


def frequencies(spark, sf_dir):
    from gateloom.operators.gates import tree_counts

    return tree_counts(lineitem_events(spark, sf_dir), TREE)


@query("table_frequency_matrix", FREQ_SQL + ", s AS (SELECT population, round(avg(pct), 5) AS mean, round(stddev_samp(pct), 5) AS sd FROM f GROUP BY population), w AS (SELECT population, max(CASE WHEN sample = 'AF' THEN pct END) AS AF, max(CASE WHEN sample = 'NO' THEN pct END) AS NO FROM f GROUP BY population) SELECT population, AF, NO, mean, sd FROM w JOIN s USING (population)")
def table_frequency_matrix(spark, sf_dir):
    m = analysis.frequency_matrix(frequencies(spark, sf_dir), ["AF", "NO"])
    return m.select("population", "AF", "NO", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"))


@query("table_consistency", FREQ_SQL + " SELECT population, round(avg(pct), 5) AS mean, round(stddev_samp(pct), 5) AS sd, round(100 * stddev_samp(pct) / avg(pct), 4) AS cv, CASE WHEN 100 * stddev_samp(pct) / avg(pct) > 1 THEN 'inconsistent' ELSE 'consistent' END AS verdict FROM f GROUP BY population")
def table_consistency(spark, sf_dir):
    c = analysis.consistency(frequencies(spark, sf_dir), 1.0)
    return c.select("population", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"), F.round("cv", 4).alias("cv"), "verdict")


@query("table_drift", STREAM + ", m AS (SELECT sample, 'fl1_a' AS channel, median(fl1_a) AS median FROM ev GROUP BY sample UNION ALL SELECT sample, 'fl2_a', median(fl2_a) FROM ev GROUP BY sample) SELECT sample, channel, round(median, 6) AS median, round((median - avg(median) OVER w) / stddev_samp(median) OVER w, 5) AS z FROM m WINDOW w AS (PARTITION BY channel)")
def table_drift(spark, sf_dir):
    m = stream_events(spark, sf_dir).groupBy("sample").agg(F.median("fl1_a").alias("fl1_a"), F.median("fl2_a").alias("fl2_a"))
    d = analysis.drift(analysis.long(m, ["sample"], ["fl1_a", "fl2_a"], value="median"))
    return d.select("sample", "channel", F.round("median", 6).alias("median"), F.round("z", 5).alias("z"))


@query("table_radar", FREQ_SQL + " SELECT population, sample, round(pct / max(pct) OVER (PARTITION BY population), 6) AS share FROM f")
def table_radar(spark, sf_dir):
    f = frequencies(spark, sf_dir)
    top = F.max("pct_total").over(Window.partitionBy("population"))
    return f.select("population", "sample", F.round(statistics.ratio(F.col("pct_total"), top), 6).alias("share"))


@query("table_group_frequency", FREQ_SQL + " SELECT substr(sample, 1, 1) AS grp, population, round(avg(pct), 5) AS mean, round(coalesce(stddev_samp(pct), 0), 5) AS sd FROM f GROUP BY ALL")
def table_group_frequency(spark, sf_dir):
    return frequencies(spark, sf_dir).groupBy(F.substring("sample", 1, 1).alias("grp"), "population").agg(F.round(F.avg("pct_total"), 5).alias("mean"), F.round(F.coalesce(F.stddev_samp("pct_total"), F.lit(0.0)), 5).alias("sd"))


@query("table_distinct_names", "SELECT DISTINCT c_mktsegment AS name FROM customer ORDER BY 1")
def table_distinct_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).distinct().orderBy("name")


@query("table_group_summary", STREAM + " SELECT sample, count(*) AS n, round(median(fl1_a), 4) AS median FROM ev GROUP BY sample HAVING count(*) >= 2")
def table_group_summary(spark, sf_dir):
    return stream_events(spark, sf_dir).groupBy("sample").agg(F.count("*").alias("n"), F.round(F.median("fl1_a"), 4).alias("median")).where("n >= 2")


@query("table_event_verdict", "WITH c AS (SELECT c_mktsegment || c_nationkey AS sample, count(*) AS n FROM customer GROUP BY 1), m AS (SELECT (list_sort(list(n)))[(count(*) // 2 + 1)::INTEGER] AS mid FROM c) SELECT sample, n, CASE WHEN abs(n - mid) / greatest(mid, 1) < 0.2 THEN 'PASS' WHEN abs(n - mid) / greatest(mid, 1) < 0.5 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM c, m")
def table_event_verdict(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("sample")).agg(F.count("*").alias("n"))
    return analysis.event_verdict(c)


@query("table_smallest_sample", STREAM + " SELECT min(n) AS n FROM (SELECT count(*) AS n FROM ev GROUP BY sample)")
def table_smallest_sample(spark, sf_dir):
    return stream_events(spark, sf_dir).groupBy("sample").agg(F.count("*").alias("n")).agg(F.min(F.when(F.col("n") > 0, F.col("n"))).alias("n"))


# ---- histograms ----

HIST = STREAM + ", r AS (SELECT sample, min(fl1_a) AS lo, max(fl1_a) AS hi FROM ev GROUP BY sample), b AS (SELECT sample, unnest(range(0, 64))::INTEGER AS bin FROM r), c AS (SELECT sample, least(63, floor((fl1_a - lo) / ((hi - lo) / 64.0::DOUBLE)))::INTEGER AS bin, count(*) AS n FROM ev JOIN r USING (sample) GROUP BY ALL), h AS (SELECT b.sample, b.bin, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (sample, bin))"


def hist64(spark, sf_dir):
    return histograms.histogram(stream_events(spark, sf_dir), ["sample"], "fl1_a", 64)


query("hist_equal", HIST + " SELECT sample, bin, n FROM h")(lambda spark, sf_dir: hist64(spark, sf_dir).select("sample", "bin", "n"))
query("hist_moving_average", HIST + " SELECT sample, bin, round(sum(n) OVER (PARTITION BY sample ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0, 6) AS smooth FROM h")(
    lambda spark, sf_dir: histograms.moving_average(hist64(spark, sf_dir), ["sample"]).select("sample", "bin", F.round("smooth", 6).alias("smooth"))
)
query("hist_box_smooth", HIST + " SELECT sample, bin, round(avg(n) OVER (PARTITION BY sample ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smooth FROM h")(
    lambda spark, sf_dir: histograms.moving_average(hist64(spark, sf_dir), ["sample"], 7, False).select("sample", "bin", F.round("smooth", 6).alias("smooth"))
)
query("hist_cdf", HIST + " SELECT sample, bin, round(sum(n) OVER (PARTITION BY sample ORDER BY bin) / sum(n) OVER (PARTITION BY sample), 6) AS cdf FROM h")(
    lambda spark, sf_dir: histograms.cumulative(hist64(spark, sf_dir), ["sample"]).select("sample", "bin", F.round("cdf", 6).alias("cdf"))
)
query("hist_peaks", HIST + ", k AS (SELECT sample, bin, n, lag(n) OVER w AS a, lead(n) OVER w AS b FROM h WINDOW w AS (PARTITION BY sample ORDER BY bin)) SELECT sample, bin, CASE WHEN n > a AND n >= b THEN 1 WHEN n < a AND n <= b THEN -1 ELSE 0 END AS kind FROM k")(
    lambda spark, sf_dir: histograms.peaks(hist64(spark, sf_dir), ["sample"], "n").select("sample", "bin", "kind")
)
query("hist_gaussian_blur", HIST + ", o AS (SELECT unnest(range(-3, 4)) AS o), k AS (SELECT o, exp(-pow(o, 2) / 18.0::DOUBLE) AS k FROM o) SELECT a.sample, a.bin, round(sum(b.n * k) / sum(k), 5) AS blur FROM h a, k JOIN h b ON true WHERE b.sample = a.sample AND b.bin = greatest(0, least(63, a.bin + o)) GROUP BY ALL")(
    lambda spark, sf_dir: histograms.gaussian_blur(hist64(spark, sf_dir), ["sample"], 3, 64).select("sample", "bin", F.round("blur", 5).alias("blur"))
)

DISPLAY = STREAM + ", r AS (SELECT min(asinh(fl1_a / 150.0)) AS lo, max(asinh(fl1_a / 150.0)) AS hi FROM ev), d AS (SELECT sample, trunc((asinh(fl1_a / 150.0) - lo) / (hi - lo) * 255)::INTEGER AS bin, count(*) AS n FROM ev, r GROUP BY ALL)"


@query("hist_display_overlay", DISPLAY + " SELECT sample, bin, round(n / max(n) OVER (PARTITION BY sample), 6) AS height FROM d")
def hist_display_overlay(spark, sf_dir):
    """Display histograms on one shared axis, each to its own peak."""
    ev = stream_events(spark, sf_dir).withColumn("t", F.asinh(F.col("fl1_a") / F.lit(150.0)))
    lo, hi = ev.agg(F.min("t"), F.max("t")).first()
    h = ev.withColumn("bin", histograms.display_bin(F.col("t"), F.lit(lo), F.lit(hi), 256)).groupBy("sample", "bin").agg(F.count("*").alias("n"))
    return h.select("sample", "bin", F.round(F.col("n") / F.max("n").over(Window.partitionBy("sample")), 6).alias("height"))


GRID = LINE + ", r AS (SELECT sample, min(fsc_a) AS x0, max(fsc_a) AS x1, min(ssc_a) AS y0, max(ssc_a) AS y1 FROM ev GROUP BY sample), g AS (SELECT sample, trunc((fsc_a - x0) / (x1 - x0) * 63)::INTEGER AS px, 63 - trunc((ssc_a - y0) / (y1 - y0) * 63)::INTEGER AS py, count(*) AS n, avg(fl1_a) AS v FROM ev JOIN r USING (sample) GROUP BY ALL)"


def grid64(spark, sf_dir, **extra):
    return histograms.grid(lineitem_events(spark, sf_dir), ["sample"], "fsc_a", "ssc_a", 64, 64, extra)


query("raster_density", GRID + " SELECT sample, px, py, n, floor(ln(n + 1) / ln(max(n) OVER (PARTITION BY sample) + 1) * 255)::INTEGER AS shade FROM g")(lambda spark, sf_dir: histograms.palette(grid64(spark, sf_dir), ["sample"]))
query("raster_color_by_value", GRID + " SELECT sample, px, py, n, round(v, 6) AS v FROM g")(lambda spark, sf_dir: grid64(spark, sf_dir, v=F.round(F.avg("fl1_a"), 6)))
query("raster_contour_levels", GRID + ", s AS (SELECT sample, n, sum(n) OVER (PARTITION BY sample ORDER BY n DESC, py, px ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY sample) AS share FROM g), l AS (SELECT unnest(range(1, 6)) AS k) SELECT sample, k::INTEGER AS level, max(n) AS density FROM s, l WHERE share >= k / 6.0::DOUBLE GROUP BY ALL")(
    lambda spark, sf_dir: histograms.contour_levels(grid64(spark, sf_dir), ["sample"], 5)
)
query("raster_population_colors", GRID.replace("avg(fl1_a) AS v", f"count_if({SQL_CELLS}) AS v") + " SELECT sample, px, py, n, v FROM g")(lambda spark, sf_dir: grid64(spark, sf_dir, v=F.count_if(chain([CELLS], ["fsc_a", "ssc_a"]))))


@query("scatter_3d", VECTOR + ", r AS (SELECT min(e0) AS a0, max(e0) AS a1, min(e1) AS b0, max(e1) AS b1, min(e2) AS c0, max(e2) AS c1 FROM ev) SELECT row_index, round(greatest(0, least(1, (e0 - a0) / (a1 - a0))), 6) AS x, round(greatest(0, least(1, (e1 - b0) / (b1 - b0))), 6) AS y, least(23, floor((e2 - c0) / (c1 - c0) * 24))::INTEGER AS depth FROM ev, r")
def scatter_3d(spark, sf_dir):
    from gateloom.functions.scalars import unit_range

    ev = vector_events(spark, sf_dir)
    r = ev.agg(*[f(c).alias(f"{c}_{f.__name__}") for c in ("e0", "e1", "e2") for f in (F.min, F.max)]).first()
    u = {c: unit_range(F.col(c), F.lit(r[f"{c}_min"]), F.lit(r[f"{c}_max"])) for c in ("e0", "e1", "e2")}
    return ev.select("row_index", F.round(u["e0"], 6).alias("x"), F.round(u["e1"], 6).alias("y"), F.least(F.lit(23), F.floor(u["e2"] * 24)).cast("int").alias("depth"))


# ---- thresholds ----

CLAMP = STREAM + ", r AS (SELECT sample, min(fl1_a) AS lo, max(fl1_a) AS hi FROM ev GROUP BY sample), b AS (SELECT sample, lo, hi, unnest(range(0, 256)) AS bin FROM r), c AS (SELECT sample, greatest(0, least(255, trunc((fl1_a - lo) * (256.0::DOUBLE / (hi - lo))))) AS bin, count(*) AS n FROM ev JOIN r USING (sample) GROUP BY ALL), h AS (SELECT b.sample, lo, hi, b.bin, coalesce(n, 0) AS n FROM b LEFT JOIN c ON b.sample = c.sample AND b.bin = c.bin)"


@query("threshold_otsu_clamped", CLAMP + ", q AS (SELECT sample, bin, lo, hi, sum(n) OVER u AS w, sum(n) OVER (PARTITION BY sample) AS a, sum(n * bin) OVER u AS s, sum(n * bin) OVER (PARTITION BY sample) AS t FROM h WINDOW u AS (PARTITION BY sample ORDER BY bin)), v AS (SELECT *, round(w::DOUBLE * (a - w) * pow(s / w - (t - s) / (a - w), 2), 3) AS v FROM q WHERE w > 0 AND w < a) SELECT sample, round(lo + (bin + 0.5) / (256.0::DOUBLE / (hi - lo)), 6) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY v DESC, bin) AS k FROM v) WHERE k = 1")
def threshold_otsu_clamped(spark, sf_dir):
    return histograms.otsu_clamped(stream_events(spark, sf_dir), ["sample"], "fl1_a").withColumn("threshold", F.round("threshold", 6))


TRIM = STREAM + ", r AS (SELECT sample, quantile_cont(fl1_a, 0.005::DOUBLE) AS lo, quantile_cont(fl1_a, 0.995::DOUBLE) AS hi FROM ev GROUP BY sample), b AS (SELECT sample, lo, hi, unnest(range(0, 256)) AS bin FROM r), c AS (SELECT sample, least(255, floor((fl1_a - lo) / ((hi - lo) / 256.0::DOUBLE))) AS bin, count(*) AS n FROM ev JOIN r USING (sample) WHERE fl1_a BETWEEN lo AND hi GROUP BY ALL), h AS (SELECT b.sample, b.bin, lo + (b.bin + 0.5) * (hi - lo) / 256.0::DOUBLE AS mid, coalesce(n, 0) AS n FROM b LEFT JOIN c ON b.sample = c.sample AND b.bin = c.bin)"
OTSU = ", q AS (SELECT sample, bin, mid, sum(n) OVER u AS w, sum(n) OVER (PARTITION BY sample) AS a, sum(n * mid) OVER u AS s, sum(n * mid) OVER (PARTITION BY sample) AS t FROM h WINDOW u AS (PARTITION BY sample ORDER BY bin)), v AS (SELECT *, round((w / a) * (1 - w / a) * pow(s / greatest(w, 1) - (t - s) / greatest(a - w, 1), 2), 9) AS v FROM q WHERE w > 0 AND w < a), o AS (SELECT sample, mid AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY v DESC, bin) AS k FROM v) WHERE k = 1)"


@query("threshold_otsu_trimmed", TRIM + OTSU + " SELECT sample, round(threshold, 6) AS threshold FROM o")
def threshold_otsu_trimmed(spark, sf_dir):
    return histograms.otsu_trimmed(stream_events(spark, sf_dir), ["sample"], "fl1_a").withColumn("threshold", F.round("threshold", 6))


@query("threshold_positivity", TRIM + OTSU + " SELECT ev.sample, round(any_value(threshold), 6) AS threshold, round(100.0::DOUBLE * count_if(fl1_a >= threshold) / count(*), 6) AS pct_positive FROM ev JOIN o USING (sample) GROUP BY ev.sample")
def threshold_positivity(spark, sf_dir):
    """The threshold by sample, and the share of events at or above it."""
    ev = stream_events(spark, sf_dir)
    t = histograms.otsu_trimmed(ev, ["sample"], "fl1_a")
    return ev.join(F.broadcast(t), "sample").groupBy("sample").agg(F.round(F.first("threshold"), 6).alias("threshold"), F.round(F.lit(100.0) * F.count_if(F.col("fl1_a") >= F.col("threshold")) / F.count("*"), 6).alias("pct_positive"))


EQUAL = CLAMP.replace("greatest(0, least(255, trunc((fl1_a - lo) * (256.0::DOUBLE / (hi - lo)))))", "least(255, floor((fl1_a - lo) / ((hi - lo) / 256.0::DOUBLE)))")


@query("threshold_isodata", EQUAL + ", m AS (SELECT *, lo + (bin + 0.5) * ((hi - lo) / 256.0::DOUBLE) AS mid, (hi - lo) / 256.0::DOUBLE AS step FROM h), q AS (SELECT sample, mid, step, sum(n) OVER u AS w, sum(n) OVER (PARTITION BY sample) AS a, sum(n * mid) OVER u AS s, sum(n * mid) OVER (PARTITION BY sample) AS t FROM m WINDOW u AS (PARTITION BY sample ORDER BY bin)), g AS (SELECT *, (s / w + (t - s) / (a - w)) / 2 - mid AS gap FROM q WHERE w > 0 AND w < a) SELECT sample, round(min(mid), 6) AS threshold FROM g WHERE gap >= 0 AND gap < step GROUP BY sample")
def threshold_isodata(spark, sf_dir):
    return histograms.isodata(stream_events(spark, sf_dir), ["sample"], "fl1_a").withColumn("threshold", F.round("threshold", 6))


@query("threshold_triangle", EQUAL + ", p AS (SELECT sample, arg_min(bin, (-n, bin)) AS pb, max(n) AS pn, min(CASE WHEN n > 0 THEN bin END) AS f, max(CASE WHEN n > 0 THEN bin END) AS l FROM h GROUP BY sample), d AS (SELECT h.*, pn, CASE WHEN pb - f > l - pb THEN pb - bin ELSE bin - pb END AS far, CASE WHEN pb - f > l - pb THEN pb - f ELSE l - pb END AS span FROM h JOIN p USING (sample)), g AS (SELECT *, round(pn - pn * far / span - n, 6) AS gap FROM d WHERE far >= 0 AND far <= span AND span > 0) SELECT sample, round(lo + (bin + 0.5) * (hi - lo) / 256.0::DOUBLE, 6) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY gap DESC, bin) AS k FROM g) WHERE k = 1")
def threshold_triangle(spark, sf_dir):
    return histograms.triangle(stream_events(spark, sf_dir), ["sample"], "fl1_a").withColumn("threshold", F.round("threshold", 6))


@query("stat_mode", CLAMP + ", s1 AS (SELECT *, avg(n) OVER w AS a FROM h WINDOW w AS (PARTITION BY sample ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), s2 AS (SELECT *, avg(a) OVER w AS b FROM s1 WINDOW w AS (PARTITION BY sample ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), s3 AS (SELECT *, round(avg(b) OVER w, 9) AS c FROM s2 WINDOW w AS (PARTITION BY sample ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT sample, round(lo + (bin + 0.5) / (256.0::DOUBLE / (hi - lo)), 6) AS mode FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY c DESC, bin) AS k FROM s3) WHERE k = 1")
def stat_mode(spark, sf_dir):
    return histograms.mode(stream_events(spark, sf_dir), ["sample"], "fl1_a").withColumn("mode", F.round("mode", 6))


# ---- sampling and order ----


@query("sample_equal", LINE + " SELECT sample, row_index, fl1_a FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY md5('42|' || sample || '|' || row_index)) AS k FROM ev) WHERE k <= 50")
def sample_equal(spark, sf_dir):
    return analysis.equal_sample(lineitem_events(spark, sf_dir, with_index=True), 50).select("sample", "row_index", "fl1_a")


@query("sample_subset", STREAM + " SELECT sample, row_index FROM ev ORDER BY md5('12345|' || sample || '|' || row_index) LIMIT 500")
def sample_subset(spark, sf_dir):
    return stream_events(spark, sf_dir).orderBy(analysis.portable_key("sample", "row_index", seed=12345)).limit(500).select("sample", "row_index")


@query("scan_events_ranges", STREAM + " SELECT 'fl1_a' AS channel, min(fl1_a) AS low, max(fl1_a) AS high FROM ev UNION ALL SELECT 'fl2_a', min(fl2_a), max(fl2_a) FROM ev")
def scan_events_ranges(spark, sf_dir):
    r = stream_events(spark, sf_dir).agg(*[f(c).alias(f"{c}_{f.__name__}") for c in ("fl1_a", "fl2_a") for f in (F.min, F.max)])
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"{c}_min").alias("low"), F.col(f"{c}_max").alias("high")) for c in ("fl1_a", "fl2_a")])
    return r.select(F.explode(rows).alias("r")).select("r.*")


@query("rank_average", STREAM + ", r AS (SELECT fl2_a, rank() OVER (ORDER BY fl2_a) + (count(*) OVER (PARTITION BY fl2_a) - 1) / 2.0 AS rank, count(*) OVER (PARTITION BY fl2_a) AS ties FROM ev) SELECT DISTINCT fl2_a, rank::DOUBLE AS rank, ties FROM r")
def rank_average(spark, sf_dir):
    return statistics.average_ranks(stream_events(spark, sf_dir), "fl2_a").select("fl2_a", "rank", "ties").distinct()


@query("row_index", LINE + " SELECT sample, count(*) AS n, min(row_index) AS low, max(row_index) AS high, count(DISTINCT row_index) AS kinds FROM ev GROUP BY sample")
def row_index(spark, sf_dir):
    return lineitem_events(spark, sf_dir, with_index=True).groupBy("sample").agg(F.count("*").alias("n"), F.min("row_index").alias("low"), F.max("row_index").alias("high"), F.count_distinct("row_index").alias("kinds"))
