"""Tables over samples, groups, clusters and time: frequencies, drift, kinetics, group tests, quality control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gateloom.core.order import FEW, joined
from gateloom.operators.histograms import equal_bin
from gateloom.operators.statistics import average_ranks, ratio, upper_median


# ---- frequencies ----


def frequency_matrix(counts: DataFrame, samples: Sequence[str]) -> DataFrame:
    """population, a column of pct_total for each sample, mean and sample SD over the samples that have one."""
    wide = counts.groupBy("population").pivot("sample", list(samples)).agg(F.first("pct_total"))
    stats = counts.groupBy("population").agg(F.avg("pct_total").alias("mean"), F.stddev_samp("pct_total").alias("sd"))
    return wide.join(stats, "population")


def consistency(counts: DataFrame, limit: float = 50.0) -> DataFrame:
    """population, mean, sd, cv, verdict over samples; cv is 0 where the mean is."""
    s = counts.groupBy("population").agg(F.avg("pct_total").alias("mean"), F.coalesce(F.stddev_samp("pct_total"), F.lit(0.0)).alias("sd"))
    s = s.withColumn("cv", F.when(F.col("mean") > 1e-9, F.lit(100.0) * F.col("sd") / F.col("mean")).otherwise(0.0))
    return s.withColumn("verdict", F.when(F.col("cv") > limit, "inconsistent").otherwise("consistent"))


def drift(medians: DataFrame, by: str = "channel", value: str = "median") -> DataFrame:
    """medians with z: the distance from the mean over samples in sample SDs; 0 if they don't vary."""
    w = Window.partitionBy(by)
    sd = F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0))
    return medians.withColumn("z", F.when(sd > 1e-12, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0))


def full_matrix(names: DataFrame, samples: DataFrame, values: DataFrame, fill: float | None = None) -> DataFrame:
    """A row for each name and sample; what values lacks is null or fill. Both sides are lists of names, broadcast."""
    grid = samples.agg(F.collect_set("sample").alias("s")).join(F.broadcast(names.agg(F.collect_set("population").alias("p"))), F.lit(True))
    grid = grid.select(F.explode("p").alias("population"), "s").select("population", F.explode("s").alias("sample"))
    out = grid.join(F.broadcast(values), ["population", "sample"], "left")
    return out if fill is None else out.fillna(fill)


def event_verdict(counts: DataFrame) -> DataFrame:
    """counts(sample, n) with verdict by the distance from the upper median: PASS below 20 %, WARN below 50 %, else FAIL."""
    mid = counts.agg(upper_median(F.col("n")).alias("mid"))  # a row
    far = F.abs(F.col("n") - F.col("mid")) / F.greatest(F.col("mid"), F.lit(1))
    return counts.join(F.broadcast(mid), F.lit(True)).withColumn("verdict", F.when(far < 0.2, "PASS").when(far < 0.5, "WARN").otherwise("FAIL")).drop("mid")


# ---- quality control ----


def flow_rate_bad_bins(events: DataFrame, by: str = "sample", time: str = "time") -> DataFrame:
    """by, bin: time bins whose counts lie beyond 3 x 1.4826 x MAD of their median; none for fewer than 200 events or a constant time."""
    edges = events.groupBy(by).agg(F.count("*").alias("n"), F.min(time).alias("lo"), F.max(time).alias("hi")).where("n >= 200 and hi > lo")
    edges = edges.withColumn("bins", F.greatest(F.lit(10), F.least(F.lit(100), F.floor(F.col("n") / 200).cast("int"))))
    binned = events.join(F.broadcast(edges), by).withColumn("bin", F.least(F.col("bins") - 1, F.floor((F.col(time) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.col("bins"))).cast("int")))
    counted = binned.groupBy(by, "bin").agg(F.count("*").alias("c"))
    grid = edges.select(by, F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin")).join(counted, [by, "bin"], "left").fillna(0, ["c"])
    mid = grid.groupBy(by).agg(F.median("c").alias("m"))
    grid = grid.join(mid, by)
    spread = grid.groupBy(by).agg(F.median(F.abs(F.col("c") - F.col("m"))).alias("mad"))
    grid = grid.join(spread, by).withColumn("mad", F.when(F.col("mad") == 0, 1.0).otherwise(F.col("mad")))
    return grid.where(F.abs(F.col("c") - F.col("m")) > F.lit(3 * 1.4826) * F.col("mad")).select(by, "bin", "c")


def flow_rate_kept(events: DataFrame, by: str = "sample", time: str = "time") -> DataFrame:
    """The events outside the bad bins."""
    edges = events.groupBy(by).agg(F.count("*").alias("_n"), F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    bins = F.greatest(F.lit(10), F.least(F.lit(100), F.floor(F.col("_n") / 200).cast("int")))
    at = F.when((F.col("_n") >= 200) & (F.col("_hi") > F.col("_lo")), F.least(bins - 1, F.floor((F.col(time) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)).cast("int"))).otherwise(-1)
    marked = events.join(F.broadcast(edges), by).withColumn("bin", at)
    return marked.join(F.broadcast(flow_rate_bad_bins(events, by, time).select(by, "bin")), [by, "bin"], "left_anti").select(*events.columns)


def percentile_box(events: DataFrame, by: str, channels: Sequence[str], low: float = 5.0, high: float = 95.0) -> DataFrame:
    """The events within the percentiles of all channels of their sample, ends included."""
    edges = events.groupBy(by).agg(*[F.percentile(c, [low / 100, high / 100]).alias(f"_{c}") for c in channels])
    keep = F.lit(True)
    for c in channels:
        keep = keep & F.col(c).between(F.col(f"_{c}")[0], F.col(f"_{c}")[1])
    return events.join(F.broadcast(edges), by).where(keep).select(*events.columns)


def positivity_filter(events: DataFrame, thresholds: dict[str, float], drop_positive: bool = True) -> DataFrame:
    """The events that are below (or else at or above) all thresholds; unknown channels are skipped."""
    for c, t in thresholds.items():
        if c in events.columns:
            events = events.where(~(F.col(c) >= t)) if drop_positive else events.where(~(F.col(c) < t))
    return events


# ---- sampling ----


def portable_key(*cols: str, seed: int = 42) -> Column:
    """A pseudo-random sort key that other engines can compute too."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]).cast("binary"))


def equal_sample(events: DataFrame, n: int, by: str = "sample", row: str = "row_index", seed: int = 42) -> DataFrame:
    """At most n rows of each sample, those of least key. Keys are counted by their first four digits, and only rows up to those that hold the n-th of a sample are shuffled."""
    keyed = events.withColumn("_k", portable_key(by, row, seed=seed)).withColumn("_p", F.substring("_k", 1, 4))
    counts = keyed.groupBy(by, "_p").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    last = counts.withColumn("_e", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).where(F.col("_e") < n).groupBy(by).agg(F.max("_p").alias("_last"))
    found = last.limit(FEW + 1).collect()  # a row for each sample; many samples are joined by a shuffle
    if len(found) <= FEW:
        last = F.broadcast(events.sparkSession.createDataFrame(found, last.schema))
    few = joined(keyed, last, [by]).where(F.col("_p") <= F.col("_last"))
    ranked = few.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("_k")))
    return ranked.where(F.col("_r") <= n).select(*events.columns)


# ---- kinetics ----


def kinetic(events: DataFrame, channel: str, bins: int, groups: DataFrame | None = None, by: str = "sample", time: str = "time") -> DataFrame:
    """grp, bin, time, mfi, sd, low, high: medians by sample and equal time bin over the range of all samples, then mean and population SD by group."""
    lo, hi = events.agg(F.min(time), F.max(time)).first()
    if lo is None or hi <= lo:
        return events.sparkSession.createDataFrame([], "grp string, bin int, time double, mfi double, sd double, low double, high double")
    med = events.withColumn("bin", equal_bin(F.col(time), F.lit(lo), F.lit(hi), bins)).groupBy(by, "bin").agg(F.median(channel).alias("m"))
    if groups is not None:
        med = med.join(F.broadcast(groups.select(by, "grp")), by, "left").withColumn("grp", F.coalesce("grp", by))
    else:
        med = med.withColumn("grp", F.col(by))
    out = med.groupBy("grp", "bin").agg(F.avg("m").alias("mfi"), F.stddev_pop("m").alias("sd"))
    width = (hi - lo) / bins
    return out.select("grp", "bin", (F.lit(lo) + (F.col("bin") + 0.5) * F.lit(width)).alias("time"), "mfi", "sd", F.greatest(F.lit(0.0), F.col("mfi") - F.col("sd")).alias("low"), (F.col("mfi") + F.col("sd")).alias("high"))


# ---- quadrants ----


def quadrant_table(events: DataFrame, x: str, y: str, tx: float, ty: float, by: str = "sample") -> DataFrame:
    """by, quadrant, count, pct: live, early, late, necrotic; at or above a threshold is positive."""
    px, py = F.col(x) >= tx, F.col(y) >= ty
    names = {"live": ~px & ~py, "early": px & ~py, "late": px & py, "necrotic": ~px & py}
    flat = events.groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(v).alias(k) for k, v in names.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("quadrant"), F.col(k).alias("count")) for k in names])
    return flat.select(by, "n", F.explode(rows).alias("r")).select(by, "r.*", F.round(F.lit(100.0) * ratio(F.col("r.count"), F.col("n").cast("double")), 6).alias("pct"))


# ---- proliferation ----


def proliferation_indices(generations: DataFrame) -> DataFrame:
    """division_index, proliferation_index, pct_divided from generations(gen, n): precursors are n / 2^gen."""
    p = F.col("n") / F.pow(F.lit(2.0), F.col("gen"))
    s = generations.agg(F.sum(p).alias("all"), F.sum(F.when(F.col("gen") >= 1, p)).alias("divided"), F.sum(p * F.col("gen")).alias("weighted"))
    return s.select(ratio(F.col("weighted"), F.col("all")).alias("division_index"), ratio(F.col("weighted"), F.col("divided")).alias("proliferation_index"), (F.lit(100.0) * ratio(F.coalesce("divided", F.lit(0.0)), F.col("all"))).alias("pct_divided"))


# ---- group tests ----


def kruskal_wallis(df: DataFrame, group: str, x: str) -> DataFrame:
    """h, groups, n: tie-corrected; p-values are in models.chi2_sf."""
    r = average_ranks(df, x)
    sums = r.groupBy(group).agg(F.sum("rank").alias("s"), F.count("*").alias("c"))
    ties = df.groupBy(x).agg(F.count("*").alias("t")).agg(F.sum(F.pow(F.col("t").cast("double"), F.lit(3.0)) - F.col("t")).alias("ties"))
    one = sums.agg(F.sum(F.col("s") * F.col("s") / F.col("c")).alias("q"), F.sum("c").cast("double").alias("n"), F.count("*").alias("groups")).join(F.broadcast(ties), F.lit(True))
    h = F.lit(12.0) / (F.col("n") * (F.col("n") + 1)) * F.col("q") - 3 * (F.col("n") + 1)
    return one.select((h / (1 - F.col("ties") / (F.pow("n", F.lit(3.0)) - F.col("n")))).alias("h"), "groups", F.col("n").cast("bigint").alias("n"))


def mann_whitney(df: DataFrame, group: str, x: str, first: str, second: str) -> DataFrame:
    """u, z: of the first group, tie-corrected, with continuity correction."""
    two = df.where(F.col(group).isin(first, second))
    r = average_ranks(two, x)
    s = r.agg(F.sum(F.when(F.col(group) == first, F.col("rank"))).alias("r1"), F.count_if(F.col(group) == first).cast("double").alias("n1"), F.count_if(F.col(group) == second).cast("double").alias("n2"), F.sum(F.col("ties").cast("double") * F.col("ties") - 1).alias("ties"))
    u, n = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return s.select(u.alias("u"), F.when(sd > 0, (F.abs(u - F.col("n1") * F.col("n2") / 2) - 0.5) / sd).otherwise(0.0).alias("z"))


def dunn(df: DataFrame, group: str, x: str) -> DataFrame:
    """a, b, z for all pairs of groups: difference of mean ranks over its tie-corrected error."""
    r = average_ranks(df, x)
    mean = r.groupBy(group).agg(F.avg("rank").alias("m"), F.count("*").cast("double").alias("c"))
    one = df.groupBy(x).agg(F.count("*").cast("double").alias("t")).agg(F.sum("t").alias("n"), F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    a, b = mean.select(F.col(group).alias("a"), F.col("m").alias("ma"), F.col("c").alias("ca")), mean.select(F.col(group).alias("b"), F.col("m").alias("mb"), F.col("c").alias("cb"))
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b")).join(F.broadcast(one), F.lit(True))  # a row for each group
    sigma = F.sqrt((F.col("n") * (F.col("n") + 1) / 12 - F.col("ties") / (12 * (F.col("n") - 1))) * (1 / F.col("ca") + 1 / F.col("cb")))
    return pairs.select("a", "b", F.when(sigma > 0, F.abs(F.col("ma") - F.col("mb")) / sigma).otherwise(0.0).alias("z"))


# ---- clusters ----


def cluster_table(events: DataFrame, channels: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """cluster, n, pct and the median of each channel."""
    out = events.groupBy(cluster).agg(F.count("*").alias("n"), *[F.median(c).alias(c) for c in channels])
    return out.withColumn("pct", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row for each cluster


def long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "channel", value: str = "value") -> DataFrame:
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])).alias("_r")).select(*keys, "_r.*")


def z_scores(table: DataFrame, by: str, value: str, least_sd: float = 1e-9) -> DataFrame:
    """table with z over each group of rows; population SD, one below least_sd counts as 1."""
    w = Window.partitionBy(by)
    sd = F.stddev_pop(value).over(w)
    return table.withColumn("z", (F.col(value) - F.avg(value).over(w)) / F.when(sd < least_sd, 1.0).otherwise(sd))


def dense_labels(df: DataFrame, label: str) -> DataFrame:
    """df with labels 0.. in sorted order; -1 becomes a bucket of its own after the greatest. Labels are few, so they are joined back."""
    kinds = df.select(label).distinct()
    w = Window.orderBy(F.when(F.col(label) < 0, 1).otherwise(0), label)
    return df.join(F.broadcast(kinds.withColumn("dense", (F.dense_rank().over(w) - 1).cast("int"))), label)


def deepest(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, population: of a row's populations the deepest, ties to the first by name."""
    w = Window.partitionBy(*keys).orderBy(F.col("depth").desc(), "population")
    return labels.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, "population")


# ---- panels ----


def spectral_conflicts(channels: DataFrame, nm: int = 30) -> DataFrame:
    """Pairs of channels(i, channel, fluor, em) whose emissions lie within nm, nearest first. A panel is short."""
    a, b = channels.select(*[F.col(c).alias(f"{c}_a") for c in channels.columns]), channels.select(*[F.col(c).alias(f"{c}_b") for c in channels.columns])
    gap = F.abs(F.col("em_a") - F.col("em_b"))
    return a.join(F.broadcast(b), (F.col("i_a") < F.col("i_b")) & (gap <= nm)).select("channel_a", "channel_b", "fluor_a", "fluor_b", gap.alias("gap")).orderBy("gap", "channel_a", "channel_b")


def longitudinal(freq: DataFrame, meta: DataFrame) -> DataFrame:
    """subject, t, value, change: series of each subject in order of a numeric time; blanks and other text are dropped."""
    joined = freq.join(F.broadcast(meta.withColumn("t", F.expr("try_cast(t as double)")).where("t is not null and trim(subject) <> ''")), "sample")
    return joined.select("subject", "t", "value", (F.col("value") - F.lag("value").over(Window.partitionBy("subject").orderBy("t"))).alias("change"))
