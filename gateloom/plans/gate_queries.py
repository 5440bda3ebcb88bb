"""Queries over gates, populations, joins and sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gateloom.core.bind import EVENTS_CTE, LINEITEM_CTE, VECTOR_CTE, lineitem_events, stream_events, table, vector_events
from gateloom.core.order import numbered
from gateloom.operators import analysis, histograms
from gateloom.operators.gates import Gate, Population, chain, first_match, members, nodes, percent, population, quadrants, rule, tree_counts
from gateloom.operators.statistics import median, rcv
from gateloom.plans.registry import query

CELLS = Gate("rectangle", "fsc_a", "ssc_a", (20000.0, 80000.0), (10.0, 40.0))
CHILD = Gate("polygon", "fl1_a", "fl2_a", (0.02, 0.09, 0.09, 0.05, 0.02), (0.01, 0.01, 0.07, 0.075, 0.05))
TREE = (Population("Cells", CELLS, (Population("Child", CHILD), Population("Low", Gate("interval", "fl1_a", None, (0.0, 0.03))))), Population("Big", Gate("interval", "fsc_a", None, (60000.0, 1e9))))
ELLIPSE = Gate("ellipse", "fsc_a", "ssc_a", (20000.0, 80000.0), (10.0, 40.0), angle=0.0)
TURNED = Gate("ellipse", "ssc_a", "ssc_a", (5.0, 45.0), (10.0, 40.0), angle=0.5)
SPIDER = [Gate(f"q{i}", "fl1_a", "fl2_a", (0.05, 0.1, 0.0, 0.06, 0.04), (0.04, 0.05, 0.03, 0.08, 0.0)) for i in (1, 2, 3, 4)]
RULES = [([("e0", True), ("e1", True)], "both"), ([("e0", True)], "first"), ([("e2", False)], "low")]
CUTS = {"e0": 0.0, "e1": 0.05, "e2": 0.1}

SQL_CELLS = "(fsc_a BETWEEN 20000.0 AND 80000.0 AND ssc_a BETWEEN 10.0 AND 40.0)"


def sql_polygon(xs, ys, x: str, y: str) -> str:
    """Even-odd ray casting in SQL."""
    terms = []
    for i in range(len(xs)):
        a, b, c, d = xs[i], ys[i], xs[i - 1], ys[i - 1]
        if b != d:
            terms.append(f"CASE WHEN (({b}::DOUBLE > {y}) <> ({d}::DOUBLE > {y})) AND {x} < {c - a!r}::DOUBLE * ({y} - {b}::DOUBLE) / {d - b!r}::DOUBLE + {a}::DOUBLE THEN 1 ELSE 0 END")
    return f"(({' + '.join(terms)}) % 2 = 1)"


SQL_CHILD = sql_polygon(CHILD.xs, CHILD.ys, "fl1_a", "fl2_a")
SQL_ELLIPSE = "(((fsc_a - 50000.0) / 30000.0) * ((fsc_a - 50000.0) / 30000.0) + ((ssc_a - 25.0) / 15.0) * ((ssc_a - 25.0) / 15.0) <= 1.0)"
COUNT_SQL = "WITH " + LINEITEM_CTE + " SELECT sample, count(*) AS n FROM ev WHERE {} GROUP BY sample"


def counted(gates, source=lineitem_events):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return population(source(spark, sf_dir), gates).groupBy("sample").agg(F.count("*").alias("n"))

    return run


query("gate_rectangle", COUNT_SQL.format(SQL_CELLS))(counted([CELLS]))
query("gate_interval", COUNT_SQL.format("fl1_a BETWEEN 0.02 AND 0.05"))(counted([Gate("interval", "fl1_a", None, (0.02, 0.05))]))
query("gate_ellipse", COUNT_SQL.format(SQL_ELLIPSE))(counted([ELLIPSE]))
query("gate_polygon", COUNT_SQL.format(SQL_CHILD))(counted([CHILD]))
query("gate_not", COUNT_SQL.format(f"NOT {SQL_CELLS}"))(counted([Gate(CELLS.kind, CELLS.x, CELLS.y, CELLS.xs, CELLS.ys, invert=True)]))
query("gate_missing_channel", COUNT_SQL.format("false"))(counted([Gate("interval", "absent", None, (0.0, 1.0), invert=True)]))
query("gate_missing_y", COUNT_SQL.format("fl1_a BETWEEN 0.02 AND 0.08 AND 0.0 BETWEEN -1.0 AND 1.0"))(counted([Gate("rectangle", "fl1_a", "absent", (0.02, 0.08), (-1.0, 1.0))]))
query("gate_chain", COUNT_SQL.format(f"{SQL_CELLS} AND {SQL_CHILD}"))(counted([CELLS, CHILD]))
query("gate_all_samples_strip", COUNT_SQL.format(f"{SQL_ELLIPSE} AND {SQL_CHILD}"))(counted([ELLIPSE, CHILD]))


@query(
    "gate_ellipse_turned",
    "WITH " + LINEITEM_CTE + ", d AS (SELECT sample, ssc_a - 25.0 AS a FROM ev) SELECT sample, count(*) AS n FROM d WHERE ((a * cos(0.5::DOUBLE) + a * sin(0.5::DOUBLE)) / 20.0) * ((a * cos(0.5::DOUBLE) + a * sin(0.5::DOUBLE)) / 20.0) + ((a * cos(0.5::DOUBLE) - a * sin(0.5::DOUBLE)) / 15.0) * ((a * cos(0.5::DOUBLE) - a * sin(0.5::DOUBLE)) / 15.0) <= 1.0 GROUP BY sample",
)
def gate_ellipse_turned(spark, sf_dir):
    return counted([TURNED])(spark, sf_dir)


@query("gate_quadrants", "WITH " + LINEITEM_CTE + " SELECT sample, CASE WHEN fl1_a >= 0.05 AND fl2_a >= 0.04 THEN 'Q1' WHEN fl1_a < 0.05 AND fl2_a >= 0.04 THEN 'Q2' WHEN fl1_a < 0.05 THEN 'Q3' ELSE 'Q4' END AS population, count(*) AS n FROM ev GROUP BY ALL")
def gate_quadrants(spark, sf_dir):
    """The four populations of one drawn cross, all in one pass."""
    ev = lineitem_events(spark, sf_dir)
    counts = tree_counts(ev, quadrants("fl1_a", "fl2_a", 0.05, 0.04))
    return counts.select("sample", "population", F.col("count").alias("n")).where("n > 0")


@query(
    "gate_spider",
    "WITH " + LINEITEM_CTE + ", s AS (SELECT sample, (0.1::DOUBLE - 0.05::DOUBLE) * (fl2_a - 0.04::DOUBLE) - (0.05::DOUBLE - 0.04::DOUBLE) * (fl1_a - 0.05::DOUBLE) > 0 AS a, (0.06::DOUBLE - 0.05::DOUBLE) * (fl2_a - 0.04::DOUBLE) - (0.08::DOUBLE - 0.04::DOUBLE) * (fl1_a - 0.05::DOUBLE) > 0 AS b FROM ev WHERE abs(fl1_a - 0.05) > 0.001 OR abs(fl2_a - 0.04) > 0.001) SELECT sample, CASE WHEN a AND NOT b THEN 0 WHEN a THEN 1 WHEN b THEN 2 ELSE 3 END AS sector, count(*) AS n FROM s GROUP BY ALL",
)
def gate_spider(spark, sf_dir):
    """Sectors between two arms; the centre's own values are left out, as they turn on the last bit."""
    ev = lineitem_events(spark, sf_dir).where("abs(fl1_a - 0.05) > 0.001 or abs(fl2_a - 0.04) > 0.001")
    return ev.groupBy("sample", first_match([g.column(ev.columns) for g in SPIDER]).alias("sector")).agg(F.count("*").alias("n"))


@query("gate_index", "WITH " + LINEITEM_CTE + " SELECT sample, count(*) AS n, sum(row_index)::BIGINT AS rows_sum FROM ev WHERE row_index % 7 = 0 GROUP BY sample")
def gate_index(spark, sf_dir):
    """A population given by row numbers: a semi-join; numbers out of range find nothing."""
    ev = lineitem_events(spark, sf_dir, with_index=True)
    sizes = lineitem_events(spark, sf_dir).groupBy("sample").agg((F.count("*") - 1).alias("m"))
    index = sizes.select("sample", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") + 70, F.lit(7).cast("bigint"))).alias("row_index"))
    return members(ev, index).groupBy("sample").agg(F.count("*").alias("n"), F.sum("row_index").alias("rows_sum"))


@query("subset_rows", "WITH " + LINEITEM_CTE + f" SELECT sample, row_index, fsc_a, ssc_a, fl1_a, fl2_a FROM ev WHERE {SQL_CELLS} AND {SQL_CHILD}")
def subset_rows(spark, sf_dir):
    return population(lineitem_events(spark, sf_dir, with_index=True), [CELLS, CHILD]).drop("time")


@query("gate_backgating", "WITH " + LINEITEM_CTE + f" SELECT sample, count(*) AS n FROM ev WHERE {SQL_CHILD} GROUP BY sample")
def gate_backgating(spark, sf_dir):
    """Only the gates below the node that is looked at."""
    ev = lineitem_events(spark, sf_dir)
    below = next(g for p, _, g in nodes(TREE) if p == "Cells/Child")[1:]
    return population(ev, below).groupBy("sample").agg(F.count("*").alias("n"))


TREE_SQL = (
    "WITH "
    + LINEITEM_CTE
    + f""", c AS (SELECT sample, count(*) AS total, count_if({SQL_CELLS}) AS cells, count_if({SQL_CELLS} AND {SQL_CHILD}) AS child, count_if({SQL_CELLS} AND fl1_a BETWEEN 0.0 AND 0.03) AS low, count_if(fsc_a BETWEEN 60000.0 AND 1e9) AS big FROM ev GROUP BY sample),
r AS (SELECT sample, 'Cells' AS population, 'root' AS parent, cells AS count, total AS parent_count, total FROM c UNION ALL SELECT sample, 'Cells/Child', 'Cells', child, cells, total FROM c
UNION ALL SELECT sample, 'Cells/Low', 'Cells', low, cells, total FROM c UNION ALL SELECT sample, 'Big', 'root', big, total, total FROM c)
SELECT sample, population, parent, count, parent_count, total, CASE WHEN parent_count > 0 THEN round(100.0::DOUBLE * count / parent_count, 6) ELSE 0 END AS pct_parent, CASE WHEN total > 0 THEN round(100.0::DOUBLE * count / total, 6) ELSE 0 END AS pct_total FROM r"""
)


@query("tree_counts", TREE_SQL)
def tree_counts_query(spark, sf_dir):
    return tree_counts(lineitem_events(spark, sf_dir), TREE)


@query(
    "flagship_tree_stats",
    "WITH "
    + LINEITEM_CTE
    + f""", p AS (SELECT *, 'Cells' AS population FROM ev WHERE {SQL_CELLS} UNION ALL SELECT *, 'Cells/Child' FROM ev WHERE {SQL_CELLS} AND {SQL_CHILD}),
n AS (SELECT sample, count(*) AS total, count_if({SQL_CELLS}) AS cells FROM ev GROUP BY sample)
SELECT p.sample, population, count(*) AS count, round(100.0::DOUBLE * count(*) / CASE WHEN population = 'Cells' THEN any_value(total) ELSE any_value(cells) END, 6) AS pct_parent, round(100.0::DOUBLE * count(*) / any_value(total), 6) AS pct_total,
round(median(fl1_a), 6) AS median_fl1, round(CASE WHEN median(fl1_a) = 0 THEN 0 ELSE 100.0 * (quantile_cont(fl1_a, 0.8413::DOUBLE) - quantile_cont(fl1_a, 0.1587::DOUBLE)) / 2 / median(fl1_a) END, 6) AS rcv_fl1 FROM p JOIN n USING (sample) GROUP BY p.sample, population""",
)
def flagship_tree_stats(spark, sf_dir):
    """Counts, frequencies and robust statistics of a two-level tree by sample, in one aggregation."""
    ev = lineitem_events(spark, sf_dir)
    found = [x for x in nodes(TREE) if x[0] in ("Cells", "Cells/Child")]
    keep = {p: chain(g, ev.columns) for p, _, g in found}
    flat = ev.groupBy("sample").agg(F.count("*").alias("total"), *[v.alias(f"{k}{i}") for i, (p, *_) in enumerate(found) for k, v in (("n", F.count_if(keep[p])), ("m", median(F.when(keep[p], F.col("fl1_a")))), ("r", rcv(F.when(keep[p], F.col("fl1_a")))))])
    rows = F.array(*[F.struct(F.lit(p).alias("population"), F.col(f"n{i}").alias("count"), (F.col("n0") if parent else F.col("total")).alias("of"), F.col("total"), F.round(f"m{i}", 6).alias("median_fl1"), F.round(f"r{i}", 6).alias("rcv_fl1")) for i, (p, parent, _) in enumerate(found)])
    out = flat.select("sample", F.explode(rows).alias("r")).select("sample", "r.*").where("count > 0")
    return out.select("sample", "population", "count", percent("count", "of").alias("pct_parent"), percent("count", "total").alias("pct_total"), "median_fl1", "rcv_fl1")


@query("filter_positivity", "WITH " + LINEITEM_CTE + " SELECT sample, count(*) AS n FROM ev WHERE NOT (fl1_a >= 0.07) AND NOT (fl2_a >= 0.06) GROUP BY sample")
def filter_positivity(spark, sf_dir):
    ev = analysis.positivity_filter(lineitem_events(spark, sf_dir), {"fl1_a": 0.07, "fl2_a": 0.06, "absent": 1.0})
    return ev.groupBy("sample").agg(F.count("*").alias("n"))


@query(
    "filter_scatter_box",
    "WITH " + LINEITEM_CTE + ", b AS (SELECT sample, quantile_cont(fsc_a, 0.05::DOUBLE) AS f0, quantile_cont(fsc_a, 0.95::DOUBLE) AS f1, quantile_cont(ssc_a, 0.05::DOUBLE) AS s0, quantile_cont(ssc_a, 0.95::DOUBLE) AS s1 FROM ev GROUP BY sample) SELECT sample, count(*) AS n FROM ev JOIN b USING (sample) WHERE fsc_a BETWEEN f0 AND f1 AND ssc_a BETWEEN s0 AND s1 GROUP BY sample",
)
def filter_scatter_box(spark, sf_dir):
    return analysis.percentile_box(lineitem_events(spark, sf_dir), "sample", ["fsc_a", "ssc_a"]).groupBy("sample").agg(F.count("*").alias("n"))



@query(
    "gate_wizard_box",
    "WITH " + LINEITEM_CTE + ", r AS (SELECT sample, fsc_a, ssc_a, row_number() OVER (PARTITION BY sample ORDER BY fsc_a) - 1 AS a, row_number() OVER (PARTITION BY sample ORDER BY ssc_a) - 1 AS b, count(*) OVER (PARTITION BY sample) AS n FROM ev), e AS (SELECT sample, max(CASE WHEN a = floor(0.02 * (n - 1) + 0.5) THEN fsc_a END) AS f0, max(CASE WHEN a = floor(0.98 * (n - 1) + 0.5) THEN fsc_a END) AS f1, max(CASE WHEN b = floor(0.02 * (n - 1) + 0.5) THEN ssc_a END) AS s0, max(CASE WHEN b = floor(0.98 * (n - 1) + 0.5) THEN ssc_a END) AS s1 FROM r GROUP BY sample) SELECT ev.sample, count(*) AS n FROM ev JOIN e USING (sample) WHERE fsc_a BETWEEN f0 AND f1 AND ssc_a BETWEEN s0 AND s1 GROUP BY ev.sample",
)
def gate_wizard_box(spark, sf_dir):
    """A box between nearest-rank percentiles."""
    from gateloom.operators.statistics import nearest_rank

    ev = lineitem_events(spark, sf_dir)
    edges = reduce(lambda a, b: a.join(b, "sample"), [nearest_rank(ev, ["sample"], c, p, f"{c}{p}") for c in ("fsc_a", "ssc_a") for p in (2, 98)])
    keep = F.col("fsc_a").between(F.col("fsc_a2"), F.col("fsc_a98")) & F.col("ssc_a").between(F.col("ssc_a2"), F.col("ssc_a98"))
    return ev.join(F.broadcast(edges), "sample").where(keep).groupBy("sample").agg(F.count("*").alias("n"))


FLOW_SQL = (
    "WITH "
    + EVENTS_CTE
    + """, e AS (SELECT sample, count(*) AS n, min(time) AS lo, max(time) AS hi, greatest(10, least(100, count(*) // 200)) AS bins FROM ev GROUP BY sample HAVING count(*) >= 200 AND max(time) > min(time)),
c AS (SELECT sample, least(bins - 1, floor((time - lo) / ((hi - lo) / bins)))::INTEGER AS bin, count(*) AS c FROM ev JOIN e USING (sample) GROUP BY ALL),
g AS (SELECT sample, unnest(range(0, bins))::INTEGER AS bin FROM e), f AS (SELECT g.sample, g.bin, coalesce(c, 0) AS c FROM g LEFT JOIN c USING (sample, bin)),
m AS (SELECT sample, median(c) AS m FROM f GROUP BY sample), d AS (SELECT sample, CASE WHEN median(abs(c - m)) = 0 THEN 1 ELSE median(abs(c - m)) END AS mad FROM f JOIN m USING (sample) GROUP BY sample),
bad AS (SELECT f.sample, f.bin, c FROM f JOIN m USING (sample) JOIN d USING (sample) WHERE abs(c - m) > 3 * 1.4826::DOUBLE * mad)"""
)


@query("qc_flow_rate_bins", FLOW_SQL + " SELECT sample, bin, c FROM bad")
def qc_flow_rate_bins(spark, sf_dir):
    return analysis.flow_rate_bad_bins(stream_events(spark, sf_dir))


@query("qc_flow_rate_kept", FLOW_SQL + " SELECT ev.sample, count(*) AS n FROM ev LEFT JOIN e USING (sample) WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.sample = ev.sample AND bad.bin = least(e.bins - 1, floor((ev.time - e.lo) / ((e.hi - e.lo) / e.bins)))) GROUP BY ev.sample")
def qc_flow_rate_kept(spark, sf_dir):
    return analysis.flow_rate_kept(stream_events(spark, sf_dir)).groupBy("sample").agg(F.count("*").alias("n"))


@query("rule_counts", "WITH " + VECTOR_CTE + " SELECT count_if(e0 > 0.0 AND e1 > 0.05) AS both, count_if(e0 > 0.0) AS first, count_if(NOT e2 > 0.1) AS low, 0::BIGINT AS none FROM ev")
def rule_counts(spark, sf_dir):
    """Rules may overlap; one without clauses takes nothing."""
    ev = vector_events(spark, sf_dir)
    return ev.agg(*[F.count_if(rule(c, CUTS, ev.columns)).alias(n) for c, n in [*RULES, ([], "none")]])


@query("rule_labels", "WITH " + VECTOR_CTE + " SELECT CASE WHEN e0 > 0.0 AND e1 > 0.05 THEN 0 WHEN e0 > 0.0 THEN 1 WHEN NOT e2 > 0.1 THEN 2 ELSE -1 END AS label, count(*) AS n FROM ev GROUP BY 1")
def rule_labels(spark, sf_dir):
    ev = vector_events(spark, sf_dir)
    return ev.groupBy(first_match([rule(c, CUTS, ev.columns) for c, _ in RULES]).alias("label")).agg(F.count("*").alias("n"))


@query("population_deepest_label", "WITH " + LINEITEM_CTE + f" SELECT sample, CASE WHEN {SQL_CELLS} AND {SQL_CHILD} THEN 'Child' WHEN {SQL_CELLS} AND fl1_a BETWEEN 0.0 AND 0.03 THEN 'Low' WHEN fsc_a BETWEEN 60000.0 AND 1e9 THEN 'Big' WHEN {SQL_CELLS} THEN 'Cells' END AS population, count(*) AS n FROM ev WHERE {SQL_CELLS} OR fsc_a BETWEEN 60000.0 AND 1e9 GROUP BY ALL")
def population_deepest_label(spark, sf_dir):
    """Of the populations of a row the deepest; ties go to the first by name."""
    ev = lineitem_events(spark, sf_dir)
    found = sorted(nodes(TREE), key=lambda x: (-x[0].count("/"), x[0].split("/")[-1]))
    label = F.lit(None).cast("string")
    for path, _, gates in reversed(found):
        label = F.when(chain(gates, ev.columns), path.split("/")[-1]).otherwise(label)
    return ev.groupBy("sample", label.alias("population")).agg(F.count("*").alias("n")).where("population is not null")


@query("population_from_mask", "WITH " + LINEITEM_CTE + f" SELECT sample, row_index, row_number() OVER (PARTITION BY sample ORDER BY row_index) - 1 AS place FROM ev WHERE {SQL_CELLS} AND {SQL_CHILD} AND fl1_a > 0.06 AND ssc_a > 38")
def population_from_mask(spark, sf_dir):
    """An index population of a mask: its rows, each with its place in the sample's sorted list."""
    ev = population(lineitem_events(spark, sf_dir, with_index=True), [CELLS, CHILD]).where("fl1_a > 0.06 and ssc_a > 38")
    return numbered(ev.select("sample", "row_index"), ["sample"], ["row_index"], "place")


@query("gate_elastic_peak", "WITH " + LINEITEM_CTE + ", r AS (SELECT sample, min(fsc_a) AS x0, max(fsc_a) AS x1, min(ssc_a) AS y0, max(ssc_a) AS y1 FROM ev GROUP BY sample), g AS (SELECT sample, trunc((fsc_a - x0) / (x1 - x0) * 127)::INTEGER AS px, 127 - trunc((ssc_a - y0) / (y1 - y0) * 127)::INTEGER AS py, count(*) AS n FROM ev JOIN r USING (sample) GROUP BY ALL), w AS (SELECT * FROM g WHERE abs(px - 60) <= 21 AND abs(py - 60) <= 21) SELECT sample, px, py, n FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY n DESC, py, px) AS k FROM w) WHERE k = 1")
def gate_elastic_peak(spark, sf_dir):
    """The densest cell of a 128 x 128 grid within 21 cells of a gate's centre: where a pasted gate moves to."""
    g = histograms.grid(lineitem_events(spark, sf_dir), ["sample"], "fsc_a", "ssc_a", 128, 128).where("abs(px - 60) <= 21 and abs(py - 60) <= 21")
    w = Window.partitionBy("sample").orderBy(F.col("n").desc(), "py", "px")
    return g.withColumn("k", F.row_number().over(w)).where("k = 1").select("sample", "px", "py", "n")


@query("hidden_labels", "WITH " + VECTOR_CTE + " SELECT CASE WHEN cluster IN (1, 3) THEN -1 ELSE cluster END AS label, count(*) AS n FROM ev GROUP BY 1")
def hidden_labels(spark, sf_dir):
    return vector_events(spark, sf_dir).groupBy(F.when(F.col("cluster").isin(1, 3), F.lit(-1)).otherwise(F.col("cluster")).alias("label")).agg(F.count("*").alias("n"))


@query("project_columns", "WITH " + LINEITEM_CTE + " SELECT fl1_a, sample FROM ev")
def project_columns(spark, sf_dir):
    """The columns that exist, in the order asked for."""
    ev = lineitem_events(spark, sf_dir)
    return ev.select(*[c for c in ("fl1_a", "absent", "sample") if c in ev.columns])


@query("gate_history_last", "SELECT o_orderpriority AS gate, o_orderkey AS version FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) AS k FROM (SELECT DISTINCT o_orderpriority, o_orderkey FROM orders)) WHERE k <= 50")
def gate_history_last(spark, sf_dir):
    """The last 50 snapshots of each gate."""
    h = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("gate"), F.col("o_orderkey").alias("version")).distinct()
    return h.withColumn("k", F.row_number().over(Window.partitionBy("gate").orderBy(F.col("version").desc()))).where("k <= 50").select("gate", "version")


# ---- joins ----


@query("join_sample_group", "WITH " + EVENTS_CTE + ", g AS (SELECT DISTINCT sample, CASE WHEN sample < 'm' THEN 'early' END AS grp FROM ev WHERE sample < 'm') SELECT coalesce(grp, ev.sample) AS grp, count(*) AS n FROM ev LEFT JOIN g USING (sample) GROUP BY 1")
def join_sample_group(spark, sf_dir):
    """A sample without a group is a group of its own."""
    ev = stream_events(spark, sf_dir)
    groups = ev.where("sample < 'm'").select("sample", F.lit("early").alias("grp")).distinct()
    return ev.join(F.broadcast(groups), "sample", "left").groupBy(F.coalesce("grp", "sample").alias("grp")).agg(F.count("*").alias("n"))


@query("join_embedding_events", "WITH " + LINEITEM_CTE + " SELECT sample, row_index, fsc_a, fl1_a FROM ev WHERE row_index < 100")
def join_embedding_events(spark, sf_dir):
    """Rows of an embedding find their events by sample and row."""
    ev = lineitem_events(spark, sf_dir, with_index=True)
    emb = ev.where("row_index < 100").select("sample", "row_index")
    return emb.join(ev, ["sample", "row_index"]).select("sample", "row_index", "fsc_a", "fl1_a")


@query("join_full_matrix", "WITH " + EVENTS_CTE + ", v AS (SELECT sample, 'u' || (user_id % 40) AS population, count(*) AS n FROM ev WHERE user_id % 3 = 0 GROUP BY ALL), p AS (SELECT DISTINCT population FROM v), s AS (SELECT DISTINCT sample FROM ev) SELECT p.population, s.sample, coalesce(n, 0) AS n FROM p CROSS JOIN s LEFT JOIN v USING (population, sample)")
def join_full_matrix(spark, sf_dir):
    ev = stream_events(spark, sf_dir)
    v = ev.where("user_id % 3 = 0").groupBy("sample", F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("population")).agg(F.count("*").alias("n"))
    return analysis.full_matrix(v.select("population"), ev.select("sample"), v, 0)


@query("join_parent_population", "WITH n AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey >= 5 THEN n_nationkey % 5 END AS parent_id, n_name AS name FROM nation) SELECT c.name, coalesce(p.name, 'root') AS parent FROM n c LEFT JOIN n p ON c.parent_id = p.id")
def join_parent_population(spark, sf_dir):
    """Nations as a tree: the first five are at its root, the others below them."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") >= 5, F.col("n_nationkey") % 5).alias("parent_id"), F.col("n_name").alias("name"))
    return n.alias("c").join(n.alias("p"), F.col("c.parent_id") == F.col("p.id"), "left").select(F.col("c.name"), F.coalesce(F.col("p.name"), F.lit("root")).alias("parent"))


@query("join_marker_alias", "WITH c AS (SELECT DISTINCT p_brand AS channel FROM part), a AS (SELECT 'Brand#1' AS channel, 'CD4' AS marker) SELECT CASE WHEN marker IS NULL THEN c.channel ELSE marker || ' (' || c.channel || ')' END AS label FROM c LEFT JOIN a USING (channel)")
def join_marker_alias(spark, sf_dir):
    c = table(spark, sf_dir, "part").select(F.col("p_brand").alias("channel")).distinct()
    a = spark.createDataFrame([("Brand#1", "CD4")], "channel string, marker string")
    return c.join(F.broadcast(a), "channel", "left").select(F.when(F.col("marker").isNull(), F.col("channel")).otherwise(F.concat("marker", F.lit(" ("), "channel", F.lit(")"))).alias("label"))


# ---- sets ----


@query("set_union_pool", "WITH " + EVENTS_CTE + " SELECT sample, count(*) AS n FROM ev WHERE user_id % 2 = 0 OR user_id % 2 = 1 GROUP BY sample")
def set_union_pool(spark, sf_dir):
    ev = stream_events(spark, sf_dir)
    return ev.where("user_id % 2 = 0").unionByName(ev.where("user_id % 2 = 1")).groupBy("sample").agg(F.count("*").alias("n"))


@query("set_intersect", "WITH " + LINEITEM_CTE + f" SELECT count(*) AS n FROM (SELECT sample, row_index FROM ev WHERE {SQL_CELLS} INTERSECT SELECT sample, row_index FROM ev WHERE {SQL_CHILD})")
def set_intersect(spark, sf_dir):
    """Populations meet as a conjunction, not as a set operation on rows."""
    return population(lineitem_events(spark, sf_dir), [CELLS, CHILD]).agg(F.count("*").alias("n"))


@query("set_except", "WITH " + LINEITEM_CTE + f" SELECT count(*) AS n FROM (SELECT sample, row_index FROM ev WHERE {SQL_CELLS} EXCEPT SELECT sample, row_index FROM ev WHERE {SQL_CHILD})")
def set_except(spark, sf_dir):
    out = Gate(CHILD.kind, CHILD.x, CHILD.y, CHILD.xs, CHILD.ys, invert=True)
    return population(lineitem_events(spark, sf_dir), [CELLS, out]).agg(F.count("*").alias("n"))


@query("set_name_union", "SELECT DISTINCT name FROM (SELECT event_type AS name FROM events UNION SELECT c_mktsegment FROM customer)")
def set_name_union(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).union(table(spark, sf_dir, "customer").select("c_mktsegment")).distinct()


@query("ignore_group", "WITH " + EVENTS_CTE + " SELECT sample, count(*) AS n FROM ev WHERE sample <> 'click' GROUP BY sample")
def ignore_group(spark, sf_dir):
    ev = stream_events(spark, sf_dir).withColumn("grp", F.when(F.col("sample") == "click", "Ignore"))
    return ev.where(F.coalesce("grp", F.lit("")) != "Ignore").groupBy("sample").agg(F.count("*").alias("n"))
