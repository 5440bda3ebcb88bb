"""Embeddings, clustering and classification of all rows; only t-SNE, which is exact, runs on a stated, bounded sample."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateloom.core.order import running
from gateloom.core.shared import Stages
from gateloom.functions.scalars import asinh
from gateloom.operators import graphs, maps, models
from gateloom.operators.analysis import equal_sample, percentile_box, positivity_filter
from gateloom.operators.neighbours import neighbour_graph

#: Rows that t-SNE is fitted on, at most; umap.py lays out all.
FIT_ROWS = 5_000


def pooled(events: DataFrame, features: Sequence[str], n: int, by: str = "sample", row: str = "row_index", box: Sequence[str] = (), positivity: dict[str, float] | None = None, transform=asinh, seed: int = 42) -> DataFrame:
    """by, row and transformed features: filtered events, n of each sample by hash."""
    if box:
        events = percentile_box(events, by, box)
    if positivity:
        events = positivity_filter(events, positivity)
    return equal_sample(events, n, by, row, seed).select(by, row, *[transform(F.col(c)).alias(c) for c in features])


def scaled(events: DataFrame, features: Sequence[str], how: str = "zscore") -> DataFrame:
    """events with features by z-score, min-max or not scaled; the moments are a row that comes to the driver."""
    if how == "none":
        return events
    pick = (F.avg, F.stddev_pop) if how == "zscore" else (F.min, F.max)
    m = events.agg(*[f(c).alias(f"{c}_{i}") for c in features for i, f in enumerate(pick)]).first()
    low = {c: m[f"{c}_0"] or 0.0 for c in features}
    span = {c: ((m[f"{c}_1"] or 0.0) if how == "zscore" else (m[f"{c}_1"] or 0.0) - low[c]) or 1.0 for c in features}
    return events.withColumns({c: (F.col(c) - F.lit(low[c])) / F.lit(span[c]) for c in features})


def vectors(events: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="skip").transform(events)


def kmeans(events: DataFrame, features: Sequence[str], k: int, row: str = "row_index", seed: int = 42) -> DataFrame:
    """row, label."""
    v = vectors(scaled(events, features), features)
    return KMeans(featuresCol="_v", predictionCol="label", k=k, seed=seed).fit(v).transform(v).select(row, "label")


def mixture_clusters(events: DataFrame, features: Sequence[str], k: int, row: str = "row_index", seed: int = 42) -> DataFrame:
    """row, label, confidence."""
    v = vectors(scaled(events, features), features)
    out = GaussianMixture(featuresCol="_v", predictionCol="label", probabilityCol="_p", k=k, seed=seed).fit(v).transform(v)
    return out.select(row, "label", F.array_max(vector_to_array("_p")).alias("confidence"))


def assigned(events: DataFrame, features: Sequence[str], codes: np.ndarray, label: np.ndarray, row: str) -> DataFrame:
    """row, label of the nearest code for every row; the codes go along, a bounded number."""
    names = list(features)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1).astype(float)
            yield pa.RecordBatch.from_arrays([b.column(row), pa.array(label[models.nearest(x, codes)].astype(np.int32))], names=[row, "label"])

    return events.select(row, *names).mapInArrow(run, f"{row} {events.schema[row].dataType.simpleString()}, label int")


def som_clusters(events: DataFrame, features: Sequence[str], k: int, row: str = "row_index", side: int = 10, seed: int = 42) -> DataFrame:
    """row, label: a self-organising map of all rows, its codes merged to k, each row with its code's label."""
    stages = Stages(events.sparkSession)
    s = stages.store(scaled(complete(events, features, row), features), "map-rows")
    if not s.take(1):
        return s.select(row, F.lit(0).alias("label"))
    codes = maps.map_codes(s, features, side, seed=seed)
    return assigned(s, features, codes, models.merged_codes(codes, k), row)


def complete(events: DataFrame, features: Sequence[str], row: str) -> DataFrame:
    """row and features as doubles, of rows that have all of them."""
    rows = events.select(row, *[F.col(c).cast("double").alias(c) for c in features])
    return rows.filter(F.forall(F.array(*features), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))))


def graph_clusters(events: DataFrame, features: Sequence[str], neighbours: int = 30, row: str = "row_index", seed: int = 0, local: int = graphs.LOCAL_EDGES) -> DataFrame:
    """row, label: communities of the neighbour graph of all rows, edges weighted by the share of neighbours that their ends have in common. label is the least row id of the community, in the stored order."""
    stages = Stages(events.sparkSession)
    rows = stages.store(scaled(complete(events, features, row), features).select(F.monotonically_increasing_id().alias("id"), row, F.array(*[F.col(c).cast("float") for c in features]).alias("v")), "graph-rows")
    if len(rows.take(2)) < 2:
        return rows.select(row, F.lit(0).alias("label"))
    graph = neighbour_graph(rows.select("id", "v"), neighbours, stages, seed=seed)
    near = graph.select("id", F.transform("nb", lambda e: e["b"]).alias("near"))
    pairs = near.select(F.col("id").alias("a"), F.col("near").alias("na"), F.explode("near").alias("b")).join(near.toDF("b", "nb"), "b")
    common = F.size(F.array_intersect("na", "nb"))
    edges = pairs.select("a", "b", (common / F.greatest(F.size("na") + F.size("nb") - common, F.lit(1))).alias("w")).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("w").alias("w"))
    found = graphs.communities(rows.select("id"), edges, stages, local=local, seed=seed)
    order = running(found.groupBy("community").agg(F.count("*").alias("_n")), [], ["community"], F.lit(1).cast("bigint"), "label")
    out = stages.store(rows.select("id", row).join(found, "id").join(order.select("community", F.col("label").cast("int").alias("label")), "community").select(row, "label"), "graph-clusters")
    stages.close("graph-clusters")
    return out


def grid_clusters(events: DataFrame, features: Sequence[str], bins: int = 20, dense: int = 3, core: int = 40, row: str = "row_index", components: int = 5, eps: float | None = None) -> DataFrame:
    """row, label: occupied cells of a grid over principal components, joined where a cell with `core` rows in and around it touches; -1 elsewhere.

    Cells count if they have `dense` rows. Neighbours are cells that touch, at a corner too; with eps only those whose middles are at most eps cells apart. Cells find their neighbours by a join and their cluster by connected components, so the
    grid may have bins ** components cells.
    """
    names = [f"c{i}" for i in range(min(components, len(features)))]
    stages = Stages(events.sparkSession)
    p = pca(events, features, len(names), row)
    m = p.agg(*[f(c).alias(f"{c}_{f.__name__}") for c in names for f in (F.min, F.max)]).first()
    if m[0] is None:
        return p.select(row, F.lit(-1).alias("label"))
    cell = {c: F.least(F.lit(bins - 1), F.floor((F.col(c) - F.lit(m[f"{c}_min"])) / F.lit(max(1e-12, m[f"{c}_max"] - m[f"{c}_min"])) * bins)).cast("int") for c in names}
    number = sum((cell[c].cast("bigint") * F.lit(bins ** i) for i, c in enumerate(names)), F.lit(0))
    rows = stages.store(p.select(row, number.alias("cell")), "grid-rows")
    cells = stages.store(rows.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") >= dense), "cells")
    steps = [d for d in itertools.product((-1, 0, 1), repeat=len(names)) if any(d) and (eps is None or sum(v * v for v in d) <= eps * eps)]
    digit = [F.floor(F.col("cell") / bins**i) % bins for i in range(len(names))]
    inside = lambda d: F.array(*[x + F.lit(v) for x, v in zip(digit, d)])
    to = F.array(*[F.when(F.forall(inside(d), lambda x: x.between(0, bins - 1)), F.col("cell") + F.lit(sum(v * bins**i for i, v in enumerate(d)))) for d in steps])
    near = stages.store(cells.select(F.col("cell").alias("a"), F.explode(F.array_compact(to)).alias("b")).join(cells.select(F.col("cell").alias("b"), "n"), "b"), "touching")
    around = cells.join(near.groupBy(F.col("a").alias("cell")).agg(F.sum("n").alias("near")), "cell", "left")
    cores = stages.store(around.filter(F.col("n") + F.coalesce("near", F.lit(0)) >= core).select("cell"), "cores")
    links = near.join(cores.withColumnRenamed("cell", "a"), "a").join(cores.withColumnRenamed("cell", "b"), "b").select("a", "b")
    joined_ = graphs.components(cores.select(F.col("cell").alias("id")), links, stages).select(F.col("id").alias("cell"), "component")
    edge = near.join(joined_.withColumnRenamed("cell", "b"), "b").groupBy(F.col("a").alias("cell")).agg(F.min("component").alias("reached"))  # a cell at the rim goes to the least cluster that it touches
    found = cells.select("cell").join(joined_, "cell", "left").join(edge, "cell", "left").select("cell", F.coalesce("component", "reached").alias("component")).filter("component IS NOT NULL")
    order = running(found.select("component").distinct(), [], ["component"], F.lit(1).cast("bigint"), "label")
    labels = found.join(order, "component").select("cell", F.col("label").cast("int").alias("label"))
    out = stages.store(rows.join(labels, "cell", "left").select(row, F.coalesce("label", F.lit(-1)).alias("label")), "grid-clusters")
    stages.close("grid-clusters")
    return out


def pca(events: DataFrame, features: Sequence[str], k: int = 2, row: str = "row_index") -> DataFrame:
    """row and k principal components; fewer than two rows have none, so zeros."""
    v = vectors(scaled(events, features), features)
    if len(v.take(2)) < 2:
        return v.select(row, *[F.lit(0.0).alias(f"c{i}") for i in range(k)])
    out = PCA(k=k, inputCol="_v", outputCol="_c").fit(v).transform(v)
    return out.select(row, *[vector_to_array("_c")[i].alias(f"c{i}") for i in range(k)])


def tsne(events: DataFrame, features: Sequence[str], by: str, n: int, row: str = "row_index", perplexity: float = 30.0, rounds: int = 500, seed: int = 42) -> DataFrame:
    """by, row, d1, d2: t-SNE of n rows of each sample, pooled; exact, so n is FIT_ROWS / samples at most, the same for all."""
    n = max(1, min(n, FIT_ROWS // max(1, events.select(by).distinct().count())))
    rows = equal_sample(events, n, by, row, seed).select(by, row, *features).orderBy(by, row).toPandas()
    if not len(rows):
        return events.sparkSession.createDataFrame([], f"{by} {events.schema[by].dataType.simpleString()}, {row} bigint, d1 double, d2 double")
    x = rows[list(features)].to_numpy(float)
    y = models.tsne((x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0)), perplexity, rounds, seed)
    out = rows[[by, row]].assign(d1=y[:, 0], d2=y[:, 1])
    return events.sparkSession.createDataFrame(out)


def forest_importance(events: DataFrame, features: Sequence[str], label: str, top: int = 10, trees: int = 200, seed: int = 42) -> DataFrame:
    """feature, importance: the top features of a random forest."""
    v = vectors(events.where(F.col(label).isNotNull()).withColumn("_y", F.col(label).cast("double")), features)
    model = RandomForestClassifier(featuresCol="_v", labelCol="_y", numTrees=trees, seed=seed).fit(v)
    rows = sorted(zip(features, map(float, model.featureImportances.toArray())), key=lambda r: (-r[1], r[0]))[:top]
    return events.sparkSession.createDataFrame(rows, "feature string, importance double")
