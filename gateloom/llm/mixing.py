"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each source has a mean repetition rate: its target share of the output over its size. A document's number of copies is
a Poisson variate of that mean, found by inverting the distribution at a uniform number that a hash of the seed and
doc_id gives, so it depends on nothing else and a lost task finds it again. Copies are dealt out by a hash of doc_id
and copy number and sorted by it: a global shuffle in which no source gathers anywhere.

Sizes are summed with partial aggregation; rates are broadcast only if a count shows few sources.

Cases: a null source is a source of its own; a null or empty text has size 0, and a source of size 0 in all gets rate 1; a
null doc_id hashes as the empty string; repeated rows get the same number of copies each; an empty table gives an
empty table; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateloom.llm.common import join_small, shards

#: Share of a source without a given weight: its size to this power. Size of the output over that of the input. Seed.
POWER, FACTOR, SEED = 0.5, 1.0, "mix-1"
#: A mean beyond this is split into equal parts, whose variates add up to a Poisson variate again.
PART = 200.0


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts, joined by |."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def inverted(u: Column, mean: Column) -> Column:
    """The least n with P(N <= n) > u for a Poisson variate N of the mean."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    state = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.when(u >= F.exp(-mean), 1).otherwise(0).alias("n"))

    def more(a: Column, k: Column) -> Column:
        p = a["p"] * mean / k
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), (a["n"] + F.when(u >= a["c"] + p, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), last), state, more)["n"]


def copies(doc_id: Column, mean: Column, seed: str = SEED) -> Column:
    """The number of copies of a document: its hash-seeded Poisson variate of the mean."""
    parts = F.greatest(F.lit(1), F.ceil(mean / F.lit(PART))).cast("int")
    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, j: n + inverted(uniform(seed, doc_id, j), mean / parts))


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = POWER, factor: float = FACTOR) -> DataFrame:
    """source, _rate: mean repetition rates that give each source its share of factor x the size of docs, in code points."""
    size = docs.groupBy("source").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("double").alias("_size"))
    if weights is None:
        share = F.pow(F.col("_size"), F.lit(float(power)))
    else:
        share = F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in (kv[0], float(kv[1]))])[F.col("source")], F.lit(0.0)) if weights else F.lit(0.0)
    size = size.withColumn("_share", share)
    total = size.agg(F.sum("_size").alias("size"), F.sum("_share").alias("share")).first()  # one row
    rate = F.lit(1.0)
    if total["size"] and total["share"]:
        rate = F.when(F.col("_size") > 0, F.lit(float(factor)) * F.lit(total["size"]) * F.col("_share") / F.lit(total["share"]) / F.col("_size")).otherwise(rate)
    return size.select(F.coalesce(F.col("source"), F.lit("\0")).alias("_source"), rate.alias("_rate"))


def replicated(docs: DataFrame, weights: Mapping[str, float] | None, power: float, factor: float, seed: str) -> DataFrame:
    """row (all columns of docs), copy, rate, shuffle_key; within row no name can clash with those used here."""
    rate = rates(docs.select(F.col("text").cast("string").alias("text"), "source"), weights, power, factor)
    rows = join_small(docs.select(F.struct("*").alias("row"), F.coalesce(F.col("source"), F.lit("\0")).alias("_source")), rate, ["_source"])
    rows = rows.withColumn("n", copies(F.col("row.doc_id"), F.col("_rate"), seed)).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("shuffle"), F.lit(seed), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.col("copy").cast("string")).cast("binary")), 1, 15), 16, 10).cast("bigint")
    rows = rows.select("row", "copy", F.round("_rate", 6).alias("rate"), key.alias("shuffle_key"))
    return rows.repartition(shards(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")


def mixed_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = POWER, factor: float = FACTOR, seed: str = SEED) -> DataFrame:
    """The rows of docs(doc_id, text, source, ...) repeated to the target weights and shuffled, with columns copy, rate, shuffle_key (with _ if docs has one of the name)."""
    taken = {c.lower() for c in docs.columns}
    return replicated(docs, weights, power, factor, seed).select("row.*", *[F.col(c).alias(c + "_" * (c in taken)) for c in ("copy", "rate", "shuffle_key")])


def mixed_rows(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = POWER, factor: float = FACTOR, seed: str = SEED) -> DataFrame:
    """The same with the columns of docs only."""
    return replicated(docs, weights, power, factor, seed).select("row.*")


#: The same rows in DuckDB's SQL.
ORACLE = f"""
WITH size AS (SELECT source, CAST(coalesce(sum(length(text)), 0) AS DOUBLE) AS size FROM documents GROUP BY source),
tot AS (SELECT sum(size) AS all_, sum(pow(size, {POWER})) AS shares FROM size),
rate AS (SELECT source, CASE WHEN size > 0 AND shares > 0 THEN {FACTOR} * all_ * pow(size, {POWER}) / shares / size ELSE 1.0 END AS rate FROM size, tot),
pmf AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM rate, range(0, 400) r(k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
u AS (SELECT doc_id, text, lang, source, n_chars, CAST(('0x' || substr(md5('{SEED}|' || doc_id || '|1'), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT u.doc_id, any_value(text) AS text, any_value(lang) AS lang, any_value(u.source) AS source, any_value(n_chars) AS n_chars, count(*) AS n FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND u.u >= cdf.c GROUP BY u.doc_id)
SELECT doc_id, text, lang, n.source, n_chars, CAST(copy AS INTEGER) AS copy, round(rate, 6) AS rate,
       CAST(('0x' || substr(md5('shuffle|{SEED}|' || doc_id || '|' || copy), 1, 15)) AS BIGINT) AS shuffle_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM n) n JOIN rate ON n.source IS NOT DISTINCT FROM rate.source
"""
