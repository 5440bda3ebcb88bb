"""Methods on all rows: layouts, mixtures, workspace files, densities, calibration, stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from gateloom.core.bind import EVENTS_CTE, LINEITEM_CTE, lineitem_events, stream_events, table, vector_events
from gateloom.core.order import numbered
from gateloom.functions.scales import Scale
from gateloom.operators import bayes, beads, density, stability, umap
from gateloom.operators.gates import Gate, Population
from gateloom.plans.registry import query
from gateloom.sources import wsp

LINE, STREAM = f"WITH {LINEITEM_CTE}", f"WITH {EVENTS_CTE}"
EIGHT = [f"e{i}" for i in range(8)]


@query("embedding_umap")
def embedding_umap(spark, sf_dir):
    return umap.umap(vector_events(spark, sf_dir), EIGHT)


@query("cluster_process_mixture")
def cluster_process_mixture(spark, sf_dir):
    return bayes.process_clusters(vector_events(spark, sf_dir), EIGHT[:4], 4)


# ---- a workspace file: written, read again, and counted ----

LOG, HALF = Scale("log", (1000.0, 2.0)), Scale("linear", (0.0, 50.0))
SIDES = ([2000.0, 90000.0, 90000.0], [5.0, 5.0, 45.0])
TREE = (
    Population("Cells", Gate("rectangle", "fsc_a", "ssc_a", (1500, 80000), (3, 48)), (
        Population("Wedge", wsp.ScaledGate("polygon", "fsc_a", "ssc_a", *map(tuple, SIDES), x_scale=LOG, y_scale=HALF)),
        Population("Core", wsp.ScaledGate("ellipse", "fsc_a", "ssc_a", (0.6, 0.9), (0.5, 0.5), 0.5, x_scale=LOG, y_scale=HALF)),
        Population("Both", wsp.Made("and", "", paths=("Cells/Wedge", "Cells/Core"))),
        Population("Neither", wsp.Made("not", "", paths=("Cells/Wedge",)), (Population("Cheap", Gate("interval", "fl1_a", None, (0.0, 0.03))),)),
    )),
    Population("High", wsp.Box("box", "fl2_a", sides=(("fl2_a", 0.05, float("inf")),))),
)


def round_trip(samples: list[str]) -> wsp.Workspace:
    trees = wsp.resolved(wsp.portable(TREE))
    return wsp.parsed(wsp.written(wsp.Workspace(tuple(wsp.Sample(s, f"file:/data/{s}.fcs", {"fsc_a": LOG, "ssc_a": HALF}, trees=trees) for s in samples))))


def _crossings() -> str:
    xs, ys = [float(v) for v in LOG.of(SIDES[0])], [float(v) for v in HALF.of(SIDES[1])]
    edges = [((xs[i], ys[i]), (xs[i - 1], ys[i - 1])) for i in range(3) if ys[i] != ys[i - 1]]
    return " + ".join(f"((({b}::DOUBLE > v) <> ({d}::DOUBLE > v)) AND u < {c - a!r}::DOUBLE * (v - {b!r}::DOUBLE) / {d - b!r}::DOUBLE + {a!r}::DOUBLE)::INT" for (a, b), (c, d) in edges)


WORKSPACE_SQL = (
    LINE
    + ", s AS (SELECT *, log10(greatest(fsc_a, 1000.0::DOUBLE) / 100000.0::DOUBLE) / 2.0::DOUBLE + 1.0::DOUBLE AS u, ssc_a / 50.0::DOUBLE AS v FROM ev),"
    + f" m AS (SELECT sample, fsc_a BETWEEN 1500 AND 80000 AND ssc_a BETWEEN 3 AND 48 AS c, ({_crossings()}) % 2 = 1 AS w, sqrt((u - 0.6::DOUBLE) * (u - 0.6::DOUBLE) + (v - 0.5::DOUBLE) * (v - 0.5::DOUBLE)) + sqrt((u - 0.9::DOUBLE) * (u - 0.9::DOUBLE) + (v - 0.5::DOUBLE) * (v - 0.5::DOUBLE)) <= 0.5::DOUBLE AS o, fl1_a <= 0.03 AS k, fl2_a >= 0.05 AS h FROM s),"
    + " p AS (SELECT sample, unnest([{'population': 'Cells', 'i': c}, {'population': 'Cells/Wedge', 'i': c AND w}, {'population': 'Cells/Core', 'i': c AND o}, {'population': 'Cells/Both', 'i': c AND w AND o}, {'population': 'Cells/Neither', 'i': c AND NOT w}, {'population': 'Cells/Neither/Cheap', 'i': c AND NOT w AND k}, {'population': 'High', 'i': h}]) AS r FROM m)"
    + " SELECT sample, r.population AS population, count(*) FILTER (WHERE r.i) AS count FROM p GROUP BY 1, 2"
)


@query("workspace_counts", WORKSPACE_SQL)
def workspace_counts(spark, sf_dir):
    """Trees written to a workspace file and read again: boxes, a polygon and an ellipse on scaled axes, populations made of others."""
    ev = lineitem_events(spark, sf_dir)
    return wsp.sample_counts(ev, round_trip(["AF", "NF", "NO", "RF", "RO", "AO"])).select("sample", "population", "count")


@query("workspace_members", WORKSPACE_SQL.replace("count(*) FILTER (WHERE r.i) AS count", "count(*) AS count, sum(row_index)::BIGINT AS places").replace("FROM p GROUP", "FROM p WHERE r.i GROUP").replace("SELECT sample, unnest", "SELECT sample, row_index, unnest").replace("m AS (SELECT sample,", "m AS (SELECT sample, row_index,"))
def workspace_members(spark, sf_dir):
    """Row numbers of each population, as an import hands them on; summed up here."""
    m = wsp.memberships(lineitem_events(spark, sf_dir, with_index=True), round_trip(["AF", "NF", "NO", "RF", "RO", "AO"]))
    return m.groupBy("sample", "population").agg(F.count("*").alias("count"), F.sum("row_index").alias("places"))


# ---- densities, calibration, stability ----

GRID = 128
BINNED = (
    STREAM
    + ", q AS (SELECT sample, count(*) AS n, min(fl1_a) AS a, max(fl1_a) AS b, stddev_samp(fl1_a) AS sd, (quantile_cont(fl1_a, 0.75::DOUBLE) - quantile_cont(fl1_a, 0.25::DOUBLE)) / 1.34::DOUBLE AS iqr FROM ev GROUP BY sample),"
    + " h AS (SELECT sample, n, a, b, 0.9::DOUBLE * (CASE WHEN iqr > 0 AND sd > 0 THEN least(iqr, sd) WHEN sd > 0 THEN sd ELSE 1 END) * pow(n, -0.2::DOUBLE) AS h FROM q),"
    + f" g AS (SELECT sample, n, h, a - 3 * h AS start, (b + 3 * h - (a - 3 * h)) / {GRID - 1} AS step FROM h),"
    + f" p AS (SELECT sample, (fl1_a - start) / step AS pl, least(floor((fl1_a - start) / step), {GRID - 2})::BIGINT AS i FROM ev JOIN g USING (sample)),"
    + " w AS (SELECT sample, i, i + 1 - pl AS w FROM p UNION ALL SELECT sample, i + 1, pl - i FROM p),"
    + " s AS (SELECT sample, i, sum(w) AS w FROM w GROUP BY ALL HAVING sum(w) > 0)"
)


@query("density_binned", BINNED + " SELECT sample, i, round(w, 4) AS w, round(start + step * i, 4) AS x FROM s JOIN g USING (sample)")
def density_binned(spark, sf_dir):
    """What a density keeps of the data: a grid that values share out their weight on."""
    b = density.binned(stream_events(spark, sf_dir), ["sample"], "fl1_a", GRID)
    return b.select("sample", "i", F.round("w", 4).alias("w"), F.round(F.col("start") + F.col("step") * F.col("i"), 4).alias("x"))


@query("density_curve", BINNED + f", o AS (SELECT unnest(range({GRID}))::BIGINT AS k), d AS (SELECT g.sample, k, sum(CASE WHEN abs(i - k) <= greatest(1, ceil(8 * h / step)) THEN w * exp(-0.5::DOUBLE * pow((i - k) * step / h, 2)) ELSE 0 END) / max(h * sqrt(2 * pi()) * n) AS density FROM g JOIN s USING (sample), o GROUP BY g.sample, k) SELECT sample, k, round(density, 6) AS density FROM d")
def density_curve(spark, sf_dir):
    d = density.density(stream_events(spark, sf_dir), ["sample"], "fl1_a", GRID)
    low = d.groupBy("sample").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    k = F.round((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * (GRID - 1)).cast("bigint")
    return d.join(low, "sample").select("sample", k.alias("k"), F.round("density", 6).alias("density"))


@query("density_nested")
def density_nested(spark, sf_dir):
    """A population and one inside it, as shares of all events of the sample."""
    ev = stream_events(spark, sf_dir)
    return density.nested_density(ev, {"Upper": F.col("fl2_a") > 20, "Upper/Bright": (F.col("fl2_a") > 20) & (F.col("fl1_a") > 50)}, "fl1_a", points=64)


@query("density_surface")
def density_surface(spark, sf_dir):
    return density.density_2d(lineitem_events(spark, sf_dir), ["sample"], "fsc_a", "ssc_a", 32)


@query("bead_calibration")
def bead_calibration(spark, sf_dir):
    """Beads made of the order lines: the line's number decides the population, its price the scatter within; so known values come back."""
    ev = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 5")
    noise = F.exp((F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"), F.lit(2001)) / 1000.0 - 1) * 0.08)
    known = [400.0, 1600.0, 6400.0, 25600.0, 102400.0]
    beads_ = ev.select((F.element_at(F.array(*map(F.lit, known)), F.col("l_linenumber").cast("int")) / 3 * noise).alias("fl1_a"), F.col("l_quantity").cast("double").alias("fl2_a"))
    return beads.calibrated(beads_, {"fl1_a": known, "fl2_a": [1.0, None, 2.0]})


def acquired(spark, sf_dir):
    """Events of a sample, numbered in the order of their time."""
    ev = stream_events(spark, sf_dir).withColumnRenamed("row_index", "event_id")
    return numbered(ev, ["sample"], ["time", "event_id"])


@query("qc_stability_bins")
def qc_stability_bins(spark, sf_dir):
    return stability.bin_verdicts(acquired(spark, sf_dir), ["fl1_a"])


@query("qc_stability_kept")
def qc_stability_kept(spark, sf_dir):
    ev = acquired(spark, sf_dir)
    return stability.stable(ev, stability.bin_verdicts(ev, ["fl1_a"])).groupBy("sample").agg(F.count("*").alias("kept"), F.min("row_index").alias("first"), F.max("row_index").alias("last"))
