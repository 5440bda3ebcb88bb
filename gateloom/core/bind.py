"""Bindings of the supplied tables to event matrices: sample, row_index, channels, time.

Each binding is a DataFrame function and, for the oracle, the same rows as a common table expression in DuckDB's SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateloom.core.order import numbered

CHANNELS = ("fsc_a", "ssc_a", "fl1_a", "fl2_a")
ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_events(spark: SparkSession, sf_dir: str, with_index: bool = False) -> DataFrame:
    """Six samples; row_index (0-based, file order) costs a sort by ranges of each sample, so only where it is asked for."""
    df = table(spark, sf_dir, "lineitem")
    cols = [
        F.concat("l_returnflag", "l_linestatus").alias("sample"),
        F.col("l_extendedprice").cast("double").alias("fsc_a"),
        F.col("l_quantity").cast("double").alias("ssc_a"),
        (F.col("l_discount") + F.lit(0.0)).alias("fl1_a"),  # -0.0 becomes 0.0
        (F.col("l_tax") + F.lit(0.0)).alias("fl2_a"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / F.lit(1e6)).alias("time"),
    ]
    if with_index:
        cols.insert(1, F.col("row_index"))
        df = numbered(df.select(*ORDER, "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", "l_shipdate"), ["l_returnflag", "l_linestatus"], ORDER)
    return df.select(*cols)


LINEITEM_CTE = f"""ev AS (SELECT concat(l_returnflag, l_linestatus) AS sample,
  row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY {", ".join(ORDER)}) - 1 AS row_index,
  l_extendedprice::DOUBLE AS fsc_a, l_quantity::DOUBLE AS ssc_a, l_discount + 0.0 AS fl1_a, l_tax + 0.0 AS fl2_a,
  epoch_us(l_shipdate) / 1e6 AS time FROM lineitem)"""


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by event type, with a real acquisition time."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("sample"),
        F.col("event_id").alias("row_index"),
        F.col("value").cast("double").alias("fl1_a"),
        F.get_json_object("props", "$.k").cast("double").alias("fl2_a"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("time"),
        "user_id",
    )


EVENTS_CTE = """ev AS (SELECT event_type AS sample, event_id AS row_index, value::DOUBLE AS fl1_a,
  json_extract_string(props, '$.k')::DOUBLE AS fl2_a, epoch_us(ts) / 1e6 AS time, user_id FROM events)"""


def vector_events(spark: SparkSession, sf_dir: str, channels: int = 8) -> DataFrame:
    """Signed channels e0.. of the embeddings; sample and cluster are the label."""
    cols = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(channels)]
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster"), F.col("vec_id").alias("row_index"), *cols)


VECTOR_CTE = "ev AS (SELECT label AS cluster, vec_id AS row_index, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(8)) + " FROM embeddings)"


def customer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel with negative values; samples are market segments."""
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("sample"), F.col("c_custkey").alias("row_index"), F.col("c_acctbal").cast("double").alias("fl1_a"))


CUSTOMER_CTE = "ev AS (SELECT c_mktsegment AS sample, c_custkey AS row_index, c_acctbal::DOUBLE AS fl1_a FROM customer)"
