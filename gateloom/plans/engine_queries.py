"""Queries of the headless engine's own semantics: its gate chain, control assignment, and the text on a gating strategy."""

from __future__ import annotations

from pyspark.sql import functions as F

from gateloom.core.bind import EVENTS_CTE, LINEITEM_CTE, VECTOR_CTE, lineitem_events, stream_events, vector_events
from gateloom.operators import compensation
from gateloom.operators.gates import Gate, engine_chain, tree_counts
from gateloom.plans.gate_queries import CHILD, SQL_CHILD, TREE, TREE_SQL
from gateloom.plans.registry import query
from gateloom.sources.workspace import gating_methods, label_of

ENGINE_GATES = (Gate("range", "fl1_a", None, (0.01, 0.5, 0.08)), CHILD, Gate("polygon", "fl1_a", "fl2_a", (0.0, 0.1), (0.0, 0.1)), Gate("polygon", "fl1_a", "absent", (0, 1, 1), (0, 0, 1)), Gate("h_range", "absent", None, (1.0, 2.0)))


@query("gate_engine_chain", f"WITH {LINEITEM_CTE} SELECT sample, count(*) AS n FROM ev WHERE fl1_a >= 0.01 AND fl1_a <= 0.08 AND {SQL_CHILD} GROUP BY sample")
def gate_engine_chain(spark, sf_dir):
    """A chain by the engine's rules: a range is from its first to its last number, and malformed gates let everything pass."""
    ev = lineitem_events(spark, sf_dir)
    return ev.where(engine_chain(ENGINE_GATES, ev.columns)).groupBy("sample").agg(F.count("*").alias("n"))


@query(
    "comp_auto_controls",
    "WITH RECURSIVE "
    + VECTOR_CTE
    + """, m AS (SELECT cluster, unnest(['e0', 'e1', 'e2', 'e3']) AS channel, unnest([median(e0), median(e1), median(e2), median(e3)]) AS med FROM ev WHERE cluster <> 0 GROUP BY cluster),
o AS (SELECT cluster, row_number() OVER (ORDER BY cluster) AS k FROM (SELECT DISTINCT cluster FROM m)),
s AS (SELECT o.k, list({'ch': channel, 'med': med} ORDER BY med DESC, channel) AS best, any_value(o.cluster) AS cluster FROM m JOIN o USING (cluster) GROUP BY o.k),
r AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS used, NULL::VARCHAR AS channel UNION ALL
SELECT s.k, list_append(r.used, list_filter(s.best, lambda x: NOT list_contains(r.used, x.ch))[1].ch), list_filter(s.best, lambda x: NOT list_contains(r.used, x.ch))[1].ch FROM r JOIN s ON s.k = r.k + 1)
SELECT s.cluster AS sample, r.channel FROM r JOIN s USING (k) WHERE r.channel IS NOT NULL""",
)
def comp_auto_controls(spark, sf_dir):
    """Every sample but the unstained one gets the brightest detector that none before it has."""
    ev = vector_events(spark, sf_dir, 4)
    return compensation.auto_controls(ev, "cluster", ["e0", "e1", "e2", "e3"], unstained=0)


@query("comp_threshold_order", f"WITH {EVENTS_CTE}, t AS (SELECT sample, CASE WHEN substr(sample, 1, 1) = 'c' THEN sinh(1.5::DOUBLE) * 150 END AS own, CASE WHEN count(*) % 2 = 0 THEN avg(fl1_a) END AS mixture, median(fl1_a) AS otsu FROM ev GROUP BY sample) SELECT sample, round(coalesce(own, mixture, otsu), 6) AS threshold FROM t")
def comp_threshold_order(spark, sf_dir):
    """The user's threshold, given on the arcsinh scale of cofactor 150, else the mixture's, else Otsu's (here two plain statistics stand for them)."""
    t = stream_events(spark, sf_dir).groupBy("sample").agg(F.count("*").alias("n"), F.avg("fl1_a").alias("a"), F.median("fl1_a").alias("otsu"))
    own = F.when(F.substring("sample", 1, 1) == "c", F.lit(1.5))
    return t.select("sample", F.round(compensation.threshold(own, F.when(F.col("n") % 2 == 0, F.col("a")), F.col("otsu")), 6).alias("threshold"))


@query(
    "gating_methods",
    "WITH t AS (" + TREE_SQL + """), s AS (SELECT population, avg(100.0::DOUBLE * count / parent_count) AS m, coalesce(stddev_samp(100.0::DOUBLE * count / parent_count), 0) AS sd, count(*) AS n FROM t WHERE parent_count > 0 GROUP BY population),
k AS (SELECT * FROM (VALUES (1, 'Cells', 'Cells', 'rectangle', 'Size and ssc_a', 'the sample'), (2, 'Cells/Child', 'Child', 'polygon', 'fl1_a and fl2_a', 'Cells'), (3, 'Cells/Low', 'Low', 'interval', 'fl1_a', 'Cells'), (4, 'Big', 'Big', 'interval', 'Size', 'the sample')) v(i, population, name, kind, axes, parent))
SELECT 'Gates, from the outermost in. ' || string_agg(printf('%s is a %s on %s and held %.1f%% of %s (SD %.1f, samples: %d)', name, kind, axes, coalesce(m, 0), parent, coalesce(sd, 0), coalesce(n, 0)), '. ' ORDER BY i) || '. Each percentage is averaged over the samples in which the enclosing population has events.' AS text FROM k LEFT JOIN s USING (population)""",
)
def gating_methods_query(spark, sf_dir):
    """The paragraph on a tree: each population's gate, axes and its share of its parent over the samples."""
    return gating_methods(tree_counts(lineitem_events(spark, sf_dir), TREE), TREE, {"fsc_a": "Size"})


@query("name_axis_label", "SELECT n_name AS channel, CASE WHEN n_nationkey % 2 = 0 THEN 'marker ' || n_nationkey ELSE n_name END AS label FROM nation")
def name_axis_label(spark, sf_dir):
    """The marker that a detector is mapped to, or its own name."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("channel"), "n_nationkey")
    names = {r["channel"]: f"marker {r['n_nationkey']}" for r in rows.limit(1_000).collect() if r["n_nationkey"] % 2 == 0}  # a setting of the user, not data
    return rows.select("channel", label_of(F.col("channel"), names).alias("label"))
