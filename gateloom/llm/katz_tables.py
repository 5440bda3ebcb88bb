"""The Katz model of katz.py as tables that stay: n-gram counts with discounted probabilities and backoff weights, partitioned by bucket.

katz.katz_scores() keeps its tables in the shuffle of one query. Where a model is to be kept and used again, write_tables() stores
it, and scored() evaluates it: each pair of a document meets the pair table, where it fails the context's weight and the
single-token table. Only counts of counts and two totals reach the driver. Both give the same scores.

Cases are those of katz.py.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gateloom.llm.common import stored
from gateloom.llm.katz import FOLDS, HELD, K, discounts

SCHEMAS = {"words": "w string, c bigint, p double, train bigint", "contexts": "h string, over double, alpha double", "pairs": "h string, w string, c bigint, p double"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END, BEGIN = "\n", "\r"


def tokens(text: Column) -> Column:
    """Lower-cased words and then the end."""
    split = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), r"[ \x09-\x0D]+")
    return F.concat(F.filter(split, lambda w: w != ""), F.array(F.lit(END)))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD, F.lit(True))


def pairs(df: DataFrame, *keep: str) -> DataFrame:
    """keep, h, w: each token after the one before it."""
    t = df.select(*keep, tokens(F.col("text")).alias("t"))
    t = t.select(*keep, F.arrays_zip(F.concat(F.array(F.lit(BEGIN)), F.slice("t", F.lit(1), F.size("t") - 1)).alias("h"), F.col("t").alias("w")).alias("z"))
    return t.select(*keep, F.explode("z").alias("z")).select(*keep, "z.h", "z.w")


def write_tables(docs: DataFrame, path: str, buckets: int = 64) -> None:
    """Learns from the documents that aren't held out; writes path/words, path/pairs and path/contexts, each partitioned by bucket."""
    counted = stored(pairs(docs.where(~held_out())).groupBy("h", "w").agg(F.count("*").alias("c")), "pairs")
    words = counted.groupBy("w").agg(F.sum("c").alias("c"))
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    whole = total["n"] + total["v"] + 1
    n = {r["c"]: r["n"] for r in counted.where(F.col("c") <= K + 1).groupBy("c").agg(F.count("*").alias("n")).collect()}
    d = discounts(np.array([n.get(r, 0) for r in range(1, K + 2)]))
    discounted = F.col("c").cast("double")
    for r in range(1, K + 1):
        discounted = F.when(F.col("c") == r, F.lit(float(d[r - 1]) * r)).otherwise(discounted)
    single = words.select("w", "c", ((F.col("c") + 1) / F.lit(float(whole))).alias("p"))
    seen = counted.withColumn("k", discounted).join(single.select("w", F.col("p").alias("s")), "w")
    ctx = seen.groupBy("h").agg(F.sum("c").alias("n"), F.sum("k").alias("k"), F.min("c").alias("least"), F.sum("s").alias("s"))
    over = F.when(F.col("least") > K, F.col("n") + 1).otherwise(F.col("n")).cast("double")
    ctx = ctx.select("h", over.alias("over"), ((1 - F.col("k") / over) / (1 - F.col("s"))).alias("alpha"))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int").alias("bucket")
    single.select("*", F.lit(total["n"]).alias("train"), bucket("w")).write.partitionBy("bucket").parquet(f"{path}/words")
    ctx.select("*", bucket("h")).write.partitionBy("bucket").parquet(f"{path}/contexts")
    counted.withColumn("k", discounted).join(ctx, "h").select("h", "w", "c", (F.col("k") / F.col("over")).alias("p"), bucket("h")).write.partitionBy("bucket").parquet(f"{path}/pairs")


def scored(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, score; rows of one doc_id are scored together, so it should be unique."""
    words, ctx, two = (spark.read.schema(f"{SCHEMAS[n]}, bucket int").parquet(f"{path}/{n}").drop("bucket") for n in SCHEMAS)
    one = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    rare = 1.0 / ((one["n"] or 0) + one["v"] + 1)
    asked = pairs(docs, "doc_id").groupBy("doc_id", "h", "w").agg(F.count("*").alias("times"))
    got = asked.join(two.select("h", "w", F.col("p").alias("p2")), ["h", "w"], "left").join(ctx.select("h", "alpha"), "h", "left").join(words.select("w", F.col("p").alias("p1")), "w", "left")
    p = F.coalesce("p2", F.coalesce("alpha", F.lit(1.0)) * F.coalesce("p1", F.lit(rare)))
    return got.groupBy("doc_id").agg(F.sum("times").alias("n_tokens"), F.sum(F.col("times") * F.log10(p)).alias("score"))
