"""UMAP over all rows: neighbour graph, fuzzy union, layout by attraction along edges and negative sampling in partitions.

The neighbour graph is that of neighbours.py. Each row's distances become weights (a local connectivity of 1, and a width by bisection); the two directions of an edge are joined as
a + b - ab by one aggregation. The layout starts from two principal components. Rows are dealt to parts along the first; a round moves the rows of each part, whose own
rows' places are live while those of rows elsewhere are as the last round left them; repulsion is from a sample of all rows (NEGATIVES, by hash, another each round), as the
method's own negative sampling is a sample. So a round is a join of edges with places and one map; rounds are written to the shared folder, and none is kept but the last two.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateloom.core.shared import Stages
from gateloom.operators import models
from gateloom.operators.neighbours import neighbour_graph

#: Places that rows are pushed away from in a round, and how many of them each sampled edge meets.
NEGATIVES, PUSHES = 4096, 5
#: Rows of a part of the layout, about, and partitions for each part, so that few tasks get two.
PART, SPREAD = 50_000, 8


def weights(d: np.ndarray, k: int) -> np.ndarray:
    """Weights of each row's neighbours by their distances, sorted ascending: they sum to log2(k) where the bisection can reach it."""
    n, m = d.shape
    target = math.log2(k)
    positive = np.where(d > 0, d, np.inf)
    rho = positive.min(axis=1, initial=np.inf)
    rho = np.where(np.isfinite(rho), rho, 0)[:, None]
    low, high, sigma = np.zeros(n), np.full(n, np.inf), np.ones(n)
    over = np.maximum(d - rho, 0)
    for _ in range(64):
        total = np.where(over > 0, np.exp(-over / sigma[:, None]), 1.0).sum(axis=1)
        big = total > target
        high, low = np.where(big, sigma, high), np.where(big, low, sigma)
        sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
    mean = np.where(rho[:, 0] > 0, d.mean(axis=1) if m else 0, float(d.mean()) if d.size else 0)
    sigma = np.maximum(sigma, 1e-3 * mean)
    return np.where(over > 0, np.exp(-over / np.maximum(sigma, 1e-300)[:, None]), 1.0)


def fuzzy_union(graph: DataFrame, k: int) -> DataFrame:
    """a, b, w with a < b: the edges of a neighbour graph, both directions joined."""

    def weighed(batches):
        for b in batches:
            size = b.column("nb").value_lengths().to_numpy()
            flat = b.column("nb").flatten()
            d, to = flat.field(0).to_numpy().astype(float), flat.field(2).to_numpy()
            w = np.zeros(len(d))
            starts = np.cumsum(size) - size
            for m in np.unique(size[size > 0]).tolist():  # rows of one length at a time
                at = starts[size == m][:, None] + np.arange(m)
                w[at] = weights(d[at], k)
            ids = np.repeat(b.column("id").to_numpy(), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids, to)), pa.array(np.maximum(ids, to)), pa.array(w)], names=["a", "b", "w"])

    s, q = F.sum("w"), F.sum(F.col("w") * F.col("w"))
    return graph.mapInArrow(weighed, "a bigint, b bigint, w double").groupBy("a", "b").agg((s - (s * s - q) / 2).alias("w"))


def curve(spread: float, min_dist: float) -> tuple[float, float]:
    """a, b of 1 / (1 + a x^2b), fitted to a flat top of min_dist and an exponential fall."""
    x = np.linspace(0, spread * 3, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a, b = models.fitted(lambda p: 1 / (1 + p[0] * x ** (2 * p[1])), [1.0, 1.0], [1e-3, 0.1], [100.0, 5.0], y)
    return float(a), float(b)


def moved(y: np.ndarray, head: np.ndarray, tail: np.ndarray, at: np.ndarray, w: np.ndarray, pool: np.ndarray, a: float, b: float, rates: Sequence[float], rng: np.random.Generator) -> np.ndarray:
    """Places after some epochs. Edge i pulls row head[i] to row tail[i], or, where that is -1, to the place at[i]."""
    n = len(y)
    for rate in rates:
        picked = rng.permutation(np.nonzero(rng.random(len(w)) < w)[0])
        for i in range(0, len(picked), max(64, n // 2)):
            e = picked[i : i + max(64, n // 2)]
            h = head[e]
            to = np.where((tail[e] >= 0)[:, None], y[tail[e]], at[e])
            diff = y[h] - to
            d2 = (diff * diff).sum(1)
            pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-300) ** (b - 1) / (1 + a * d2**b), 0)
            step = np.clip(pull[:, None] * diff, -4, 4)
            for _ in range(PUSHES if len(pool) else 0):
                diff = y[h] - pool[rng.integers(len(pool), size=len(h))]
                d2 = (diff * diff).sum(1)
                push = np.where(d2 > 0, 2 * b / ((1e-3 + d2) * (1 + a * d2**b)), 0)
                step += np.clip(push[:, None] * diff, -4, 4)
            y = y + rate * np.stack([np.bincount(h, step[:, c], n) for c in (0, 1)], axis=1)
    return y


def layout(start: DataFrame, edges: DataFrame, stages: Stages, rounds: int = 12, epochs: int = 25, spread: float = 1.0, min_dist: float = 0.1, seed: int = 42) -> DataFrame:
    """id, part, y1, y2 after all rounds, from start (the same columns) along undirected edges a, b, w."""
    a, b = curve(spread, min_dist)
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).toDF("head", "tail", "w")
    both = stages.store(both.join(start.select(F.col("id").alias("head"), "part"), "head"), "edges")
    parts = (start.agg(F.max("part")).first()[0] or 0) + 1
    places = start
    for r in range(rounds):
        pool = np.array([[p["y1"], p["y2"]] for p in places.orderBy(F.xxhash64("id", F.lit(r)), "id").limit(NEGATIVES).select("y1", "y2").collect()]).reshape(-1, 2)
        rates = [1 - (r * epochs + e) / (rounds * epochs) for e in range(epochs)]

        def run(batches, pool=pool, rates=rates, r=r):
            t = pa.Table.from_batches(list(batches), pa.schema([("part", pa.int32()), ("head", pa.int64()), ("tail", pa.int64()), ("w", pa.float64()), ("y1", pa.float64()), ("y2", pa.float64())]))
            for part in np.unique(t.column("part").to_numpy()).tolist():
                own = t.filter(pa.array(t.column("part").to_numpy() == part))
                is_row = own.column("tail").is_null().to_numpy()
                order = lambda m, *keys: np.nonzero(m)[0][np.lexsort([own.column(k).to_numpy()[m] for k in keys])]
                rows, edge = order(is_row, "head"), order(~is_row, "tail", "head")
                ids, xy = own.column("head").to_numpy()[rows], np.stack([own.column(c).to_numpy() for c in ("y1", "y2")], axis=1)
                head = np.searchsorted(ids, own.column("head").to_numpy()[edge])
                to = own.column("tail").fill_null(-1).to_numpy()[edge].astype(np.int64)
                tail = np.minimum(np.searchsorted(ids, to), max(len(ids) - 1, 0))
                tail = np.where(ids[tail] == to, tail, -1) if len(ids) else tail
                y = moved(xy[rows], head, tail, xy[edge], own.column("w").fill_null(0).to_numpy()[edge], pool, a, b, rates, np.random.default_rng([seed, r, part]))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), part, np.int32)), pa.array(y[:, 0]), pa.array(y[:, 1])], names=["id", "part", "y1", "y2"])

        met = both.join(places.select(F.col("id").alias("tail"), "y1", "y2"), "tail").select("part", "head", "tail", "w", "y1", "y2")
        own = places.select("part", F.col("id").alias("head"), F.lit(None).cast("bigint").alias("tail"), F.lit(None).cast("double").alias("w"), "y1", "y2")
        places = stages.store(met.unionAll(own).repartition(SPREAD * parts if parts > 1 else 1, "part").mapInArrow(run, "id bigint, part int, y1 double, y2 double"), "places")
    return places


def start_places(points: DataFrame, names: Sequence[str], part_rows: int = PART, seed: int = 42) -> DataFrame:
    """id, part, y1, y2: two principal components scaled to 10, parts of about equal size along the first."""
    if len(points.take(2)) < 2:
        return points.select("id", F.lit(0).alias("part"), F.lit(0.0).alias("y1"), F.lit(0.0).alias("y2"))
    k = min(2, len(names))
    v = VectorAssembler(inputCols=list(names), outputCol="_v").transform(points.select("id", *[F.get("v", i).cast("double").alias(c) for i, c in enumerate(names)]))
    c = PCA(k=k, inputCol="_v", outputCol="_c").fit(v).transform(v).select("id", vector_to_array("_c").alias("c"))
    n, most = c.agg(F.count("*"), F.max(F.array_max(F.transform("c", F.abs)))).first()
    scale = 10 / most if most else 0.0
    noise = lambda s: (F.pmod(F.xxhash64("id", F.lit(seed + s)), F.lit(20_001)) / 10_000 - 1) * 1e-3
    c = c.select("id", (F.get("c", 0) * scale + noise(1)).alias("y1"), (F.coalesce(F.get("c", 1), F.lit(0.0)) * scale + noise(2)).alias("y2"))
    parts = math.ceil(n / part_rows)
    cuts = c.approxQuantile("y1", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    part = sum((F.when(F.col("y1") > cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    return c.select("id", part.cast("int").alias("part"), "y1", "y2")


def umap(events: DataFrame, features: Sequence[str], keys: Sequence[str] = ("row_index",), neighbours: int = 15, min_dist: float = 0.1, spread: float = 1.0, rounds: int = 12, epochs: int = 25, part_rows: int = PART, seed: int = 42) -> DataFrame:
    """keys, d1, d2 of every row whose features are all there (others have no place). neighbours counts the row itself, as is usual.

    Few rows: a single one stays at its start; features without variance give rows scattered about one place.
    """
    stages = Stages(events.sparkSession)
    rows = events.select(*keys, F.array(*[F.col(c).cast("float") for c in features]).alias("v"))
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))))
    points = stages.store(rows.withColumn("id", F.monotonically_increasing_id()), "points")
    try:
        if not points.take(1):
            return points.select(*keys, F.lit(0.0).alias("d1"), F.lit(0.0).alias("d2"))
        graph = neighbour_graph(points.select("id", "v"), neighbours - 1, stages, seed=seed)
        start = stages.store(start_places(points, [f"f{i}" for i in range(len(features))], part_rows, seed), "start")
        places = layout(start, stages.store(fuzzy_union(graph, neighbours), "union"), stages, rounds, epochs, spread, min_dist, seed)
        return stages.store(points.join(places, "id").select(*keys, F.col("y1").alias("d1"), F.col("y2").alias("d2")), "umap")
    finally:
        stages.close("umap", "points")
