"""Bottom-k sketches of shingle hashes, with DataFrame functions only.

A sketch is the k least distinct 64-bit hashes of a text's shingles (WORDS words each; a shorter text is one shingle;
a text without words has an empty sketch), ascending. Sketches of parts merge into that of the whole (the k least of
the union), and estimate resemblance, containment and the number of distinct shingles.

A document's successor by doc_id is found without a global sort in one task: doc_id is cut into ranges at quantiles
(as many as there are shuffle partitions), and the first document of each range is also sent to the range before it.

Cases: a null text counts as empty; two empty sketches are alike (1.0), an empty and another are not (0.0); null ids
come first, equal ids in the order of their texts' hashes; the only document is its own successor; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gateloom.llm.common import shards

#: Hashes of a sketch; words of a shingle.
K, WORDS = 128, 5


def bound(value: Column, use) -> Column:
    """use(value), where value is computed once for the row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The bottom-k sketch of a text, an ascending array of bigint."""
    split = F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(split, lambda w: F.xxhash64(w))

    def shingled(h: Column) -> Column:
        n = F.size(h)
        each = F.transform(F.sequence(F.lit(0), n - F.lit(words)), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(words)]))
        short = F.array(F.aggregate(h, n.cast("bigint"), lambda a, x: F.xxhash64(a, x)))
        return F.when(n >= words, each).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))

    return F.slice(F.sort_array(F.array_distinct(bound(hashed, shingled))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard resemblance: the share of the union's sketch that both hold."""
    both = merged(a, b, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    top = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds: resemblance x |a or b| / |a|; 1 if a is empty."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * distinct_count(merged(a, b, k), k) / distinct_count(a, k)))


def encoded(a: Column) -> Column:
    """A sketch as text: 16 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def sketches_by(df: DataFrame, keys: Sequence[str], text: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """keys, sketch: one for all texts of a group; each task keeps a group's k least hashes before it shuffles them."""
    each = df.select(*keys, F.explode(sketch(F.col(text), k, words)).alias("_h")).distinct()
    least = each.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_n") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias("sketch"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text with next_text, that of the next document by doc_id (after the last: the first); also sketch and next_sketch."""
    spark = docs.sparkSession
    n = shards(spark)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []))
    low = F.array(*[F.lit(x) for x in cuts]) if cuts else F.array().cast("array<bigint>")
    part = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.size(F.filter(low, lambda x: x < F.col("doc_id"))))
    firsts = rows.select("doc_id", part.alias("part")).groupBy("part").agg(F.min("doc_id").alias("first")).orderBy("part").collect()  # a row for each range
    parts = [r["part"] for r in firsts]
    before = dict(zip(parts, [parts[-1], *parts[:-1]])) if parts else {}
    first = F.lit(False)
    if known := [r["first"] for r in firsts if r["first"] is not None]:
        first = F.coalesce(F.col("doc_id").isin(known), F.col("part") == -1)
    elif parts:
        first = F.lit(True)
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("guard"))
    at = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("part")] if before else F.lit(None).cast("int")
    dealt = rows.withColumn("part", part).withColumn("_to", F.explode(F.when(first, F.array(own, F.struct(at.alias("part"), F.lit(1).alias("guard")))).otherwise(F.array(own))))
    dealt = dealt.select("doc_id", "text", "_to.part", "_to.guard").repartition(n, "part").withColumn("sketch", sketch(F.col("text")))
    order = Window.partitionBy("part").orderBy("guard", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order)).where("guard = 0").drop("part", "guard")


def edited_fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and estimates, for docs(doc_id, text)."""
    rows = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), "sketch", "next_sketch", edited.alias("_edited"))
    rows = rows.select("*", sketch(F.col("_edited"), k).alias("_sketch"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        encoded(F.col("sketch")).alias("fingerprint"),
        encoded(F.col("_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("sketch"), k).alias("n_shingles"),
        containment(F.col("sketch"), F.col("_sketch"), k).alias("kept_by_edit"),
    )
