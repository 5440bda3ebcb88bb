"""Queries over files that are written and read again, and over streams."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateloom.core.bind import EVENTS_CTE, LINEITEM_CTE, lineitem_events, stream_events, table
from gateloom.core.shared import local_form, shared_path
from gateloom.plans.gate_queries import TREE, TREE_SQL
from gateloom.plans.registry import query
from gateloom.sources import fcs, workspace
from gateloom.streaming.binning import binned

CHANNELS = ["fsc_a", "ssc_a", "fl1_a", "fl2_a"]
SINGLE = ", ".join(f"round({c}::FLOAT::DOUBLE, 6) AS {c}" for c in CHANNELS)


def files(spark: SparkSession, sf_dir: str) -> str:
    """The samples as FCS files in a shared folder."""
    folder = shared_path(spark, "fcs")
    os.makedirs(local_form(folder))
    fcs.write_files(lineitem_events(spark, sf_dir, with_index=True), CHANNELS, local_form(folder), by_row=True)
    return folder


@query("source_fcs_events", f"WITH {LINEITEM_CTE} SELECT sample, row_index, {SINGLE} FROM ev")
def source_fcs_events(spark, sf_dir):
    """Written as files of 32-bit floats and read through the data source."""
    spark.dataSource.register(fcs.FcsSource)
    ev = spark.read.format("fcs").load(files(spark, sf_dir))
    return ev.select("sample", "row_index", *[F.round(c, 6).alias(c) for c in CHANNELS])


@query("source_fcs_binary", f"WITH {LINEITEM_CTE} SELECT sample, count(*) AS n, round(sum(ssc_a), 3) AS ssc, max(row_index) AS last FROM ev GROUP BY sample")
def source_fcs_binary(spark, sf_dir):
    """Read through Spark's reader of binary files."""
    ev = fcs.read_events(spark, files(spark, sf_dir), ["ssc_a", "fl1_a"])
    return ev.groupBy("sample").agg(F.count("*").alias("n"), F.round(F.sum("ssc_a"), 3).alias("ssc"), F.max("row_index").alias("last"))


@query("source_fcs_keywords", f"WITH {LINEITEM_CTE} SELECT sample, '$TOT' AS keyword, count(*)::VARCHAR AS value FROM ev GROUP BY sample UNION ALL SELECT DISTINCT sample, '$PAR', '4' FROM ev")
def source_fcs_keywords(spark, sf_dir):
    return fcs.read_keywords(spark, files(spark, sf_dir)).where("keyword in ('$TOT', '$PAR')")


@query("source_fcs_channels", f"WITH {LINEITEM_CTE} SELECT sample, i::INTEGER AS idx, (['fsc_a', 'ssc_a', 'fl1_a', 'fl2_a'])[i] AS channel, '' AS marker, i <= 2 AS scatter FROM (SELECT DISTINCT sample FROM ev), range(1, 5) r(i)")
def source_fcs_channels(spark, sf_dir):
    return fcs.channel_table(fcs.read_keywords(spark, files(spark, sf_dir)))


@query("sink_statistics_csv", TREE_SQL)
def sink_statistics_csv(spark, sf_dir):
    """The statistics table as delimited text, read again."""
    from gateloom.operators.gates import tree_counts

    df = tree_counts(lineitem_events(spark, sf_dir), TREE)
    path = shared_path(spark, "csv")
    workspace.write_table(df, path)
    return spark.read.option("header", True).schema(df.schema).csv(path)


@query("sink_text_tsv", "SELECT n_nationkey, n_name || ',\"' || n_regionkey AS label, CASE WHEN n_regionkey > 2 THEN n_regionkey::DOUBLE END AS region FROM nation")
def sink_text_tsv(spark, sf_dir):
    """Separators and quotes within values, and values that are missing."""
    df = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit(',"'), F.col("n_regionkey").cast("string")).alias("label"), F.when(F.col("n_regionkey") > 2, F.col("n_regionkey").cast("double")).alias("region"))
    path = shared_path(spark, "tsv")
    workspace.write_table(df, path, "\t", quote_all=True)
    return spark.read.option("header", True).option("sep", "\t").option("escape", '"').schema(df.schema).csv(path)


@query("source_sample_summary", f"WITH {EVENTS_CTE} SELECT sample, count(*) AS events, min(row_index) AS first FROM ev GROUP BY sample")
def source_sample_summary(spark, sf_dir):
    return stream_events(spark, sf_dir).groupBy("sample").agg(F.count("*").alias("events"), F.min("row_index").alias("first"))


ROWS = workspace.tree_rows({"s": TREE})
ROWS_SQL = ", ".join(f"({i}, '{r['name']}', '{r['type']}', {str(r['invert']).lower()}, {int(r['parent_id'][1:]) if 'parent_id' in r else 'NULL'})" for i, r in enumerate(ROWS, 1))


@query("source_gate_rows", f"WITH {LINEITEM_CTE}, s AS (SELECT sample, dense_rank() OVER (ORDER BY sample) - 1 AS k FROM (SELECT DISTINCT sample FROM ev)), t AS (SELECT * FROM (VALUES {ROWS_SQL}) t(i, name, type, invert, p)) SELECT sample, 'G' || (k * {len(ROWS)} + i) AS id, 'G' || (k * {len(ROWS)} + p) AS parent_id, name, type, invert FROM s, t")
def source_gate_rows(spark, sf_dir):
    """The tree of every sample in the table as rows, and those as trees and rows again; the driver holds sample names and gates."""
    samples = sorted(r["sample"] for r in lineitem_events(spark, sf_dir).select("sample").distinct().collect())
    rows = workspace.tree_rows(workspace.trees_of(workspace.tree_rows({s: TREE for s in samples})))
    return spark.createDataFrame([(r["sample"], r["id"], r.get("parent_id"), r["name"], r["type"], r["invert"]) for r in rows], "sample string, id string, parent_id string, name string, type string, invert boolean")


@query("source_restore_dedup", "WITH g AS (SELECT o_orderpriority AS parent, o_orderstatus AS name, o_orderkey AS seq FROM orders) SELECT parent, name, min(seq) AS seq FROM g GROUP BY ALL")
def source_restore_dedup(spark, sf_dir):
    """Of siblings of one name the first stays."""
    g = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("parent"), F.col("o_orderstatus").alias("name"), F.col("o_orderkey").alias("seq"))
    return g.groupBy("parent", "name").agg(F.min("seq").alias("seq"))


@query("plugin_per_sample", f"WITH {EVENTS_CTE} SELECT sample, true AS ok, NULL AS error, count(*)::DOUBLE AS n FROM ev WHERE sample <> 'click' GROUP BY sample UNION ALL SELECT 'click', false, 'no clicks', NULL")
def plugin_per_sample(spark, sf_dir):
    """A plugin on each sample; one that fails doesn't stop the others."""

    def f(pdf):
        import pandas as pd

        if pdf["sample"].iloc[0] == "click":
            raise ValueError("no clicks")
        return pd.DataFrame({"n": [float(len(pdf))]})

    return workspace.run_on_samples(stream_events(spark, sf_dir).select("sample", "fl1_a"), f, "n double")


@query("stream_binned", "SELECT event_type AS sample, time_bucket(INTERVAL 10 MINUTE, ts) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def stream_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream operator on a bounded table."""
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("sample"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return binned(ev, "value").select("sample", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 6).alias("mean"))
