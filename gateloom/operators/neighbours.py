"""An approximate neighbour graph over all rows: lists from random orders, then neighbours of neighbours join until nothing improves.

Points are rows (id bigint, v array<float>). First the rows are put in order of the sides of random planes on which they lie; runs of consecutive rows compare each
with each, which costs rows times the length of a run. Then, round by round, the rows that stand in one row's list, or have it in theirs, are compared with each other: what is near to the same
row is near to each other. A round joins lists with vectors; no task holds more than the lists of a batch of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gateloom.core.shared import Stages

#: Rows of a run that are compared each with each.
RUN = 512
#: Rows whose lists are merged at once.
MERGED = 2_000
#: Planes of an order.
PLANES = 24
LIST = "array<struct<d: float, h: int, b: bigint>>"


def tie(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair that decides between equal distances, so that alike rows don't all name the same neighbours."""
    with np.errstate(over="ignore"):
        x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(33)).astype(np.int32)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :], 0)


def nearest_in(ids: np.ndarray, x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the places of its k nearest others (all, if fewer), and their distances."""
    m = len(x)
    k = min(k, m - 1)
    d = squares(x, x)
    d += rng.random(d.shape) * (1e-9 * float(d.max(initial=0)) + 1e-30)  # ties fall at random
    np.fill_diagonal(d, np.inf)
    at = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.zeros((m, 0), int)
    return at, np.sqrt(((x[:, None, :] - x[at]) ** 2).sum(-1))


def lists_of(owner: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.Array:
    """Sorted lists (d, h, b) of equal length, a row of b and d each."""
    h = tie(np.repeat(owner[:, None], b.shape[1], 1), b)
    order = np.lexsort((h, d), axis=1)
    take = lambda z: np.take_along_axis(z, order, 1).reshape(-1)
    entries = pa.StructArray.from_arrays([pa.array(take(d).astype(np.float32)), pa.array(take(h)), pa.array(take(b))], names=["d", "h", "b"])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(owner) + 1, dtype=np.int32) * b.shape[1]), entries)


def vectors_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def best_of(owner: np.ndarray, d: np.ndarray, h: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k least entries (d, h, b) of each owner, each once, by owner."""
    order = np.lexsort((b, h, d, owner))
    owner, d, h, b = owner[order], d[order], h[order], b[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (b[1:] != b[:-1]) | (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    owner, d, h, b = owner[new], d[new], h[new], b[new]
    starts = np.nonzero(np.r_[True, owner[1:] != owner[:-1]][: len(owner)])[0]
    keep = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)])) < k
    return owner[keep], d[keep], h[keep], b[keep]


def merged(lists: DataFrame, k: int) -> DataFrame:
    """id, nb: the k best of all lists of an id, each neighbour once."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, MERGED):
                batch = whole.slice(at, MERGED)
                size = batch.column("nb").value_lengths().to_numpy()
                flat = batch.column("nb").flatten()
                owner, d, h, b = best_of(np.repeat(np.arange(len(size)), size), *[flat.field(i).to_numpy() for i in range(3)], k)
                entries = pa.StructArray.from_arrays([pa.array(d), pa.array(h), pa.array(b)], names=["d", "h", "b"])
                ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(size)))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), entries)], names=["id", "nb"])

    return lists.groupBy("id").agg(F.flatten(F.collect_list("nb")).alias("nb")).mapInArrow(run, f"id bigint, nb {LIST}")


def run_lists(points: DataFrame, k: int, orders: int, run: int, seed: int) -> DataFrame:
    """id, nb: lists found within runs of several random orders."""
    spark = points.sparkSession
    dims = len((points.select("v").first() or [[]])[0])
    planes = np.random.default_rng(seed).normal(size=(orders, dims, PLANES))

    def coded(batches):
        for b in batches:
            x = vectors_of(b.column("v"))
            for o in range(orders):
                code = ((x @ planes[o] > 0) @ (1 << np.arange(PLANES - 1, -1, -1))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), o, np.int32)), pa.array(code), b.column("id"), b.column("v")], names=["o", "code", "id", "v"])

    def compared(batches):
        held: list[pa.Table] = []

        def out(t: pa.Table):
            for o in np.unique(t.column("o").to_numpy()).tolist():
                own = t.filter(pa.array(t.column("o").to_numpy() == o))
                ids, x = own.column("id").to_numpy(), vectors_of(own.column("v").combine_chunks())
                cuts = np.linspace(0, len(ids), max(1, math.ceil(len(ids) / run)) + 1).astype(int)
                for a, b in zip(cuts[:-1], cuts[1:]):
                    at, d = nearest_in(ids[a:b], x[a:b], k, np.random.default_rng(seed))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:b]), lists_of(ids[a:b], ids[a:b][at], d)], names=["id", "nb"])

        rows = 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows >= 16 * run:
                yield from out(pa.concat_tables(held))
                held, rows = [], 0
        if held:
            yield from out(pa.concat_tables(held))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = points.mapInArrow(coded, "o int, code bigint, id bigint, v array<float>").repartitionByRange(parts, "o", "code", "id").sortWithinPartitions("o", "code", "id")
    return merged(ordered.mapInArrow(compared, f"id bigint, nb {LIST}"), k)


def joined_round(points: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """The graph after each row's neighbours, and those that name it (k at most), were compared with each other."""
    forward = graph.select(F.col("id").alias("u"), F.explode("nb").alias("e")).select("u", F.col("e.b").alias("x"), F.col("e.h").alias("h"))
    few = Window.partitionBy("x").orderBy("h", "u")
    back = forward.withColumn("r", F.row_number().over(few)).filter(F.col("r") <= k).select(F.col("x").alias("u"), F.col("u").alias("x"))
    worst = F.when(F.size("nb") < k, F.lit(math.inf)).otherwise(F.element_at("nb", -1)["d"]).cast("float")
    about = points.join(graph.select("id", worst.alias("worst")), "id").withColumnRenamed("id", "x")
    members = forward.select("u", "x").unionAll(back).distinct().join(about, "x")
    rows = members.groupBy("u").agg(F.collect_list(F.struct("x", "worst", "v")).alias("m"))

    def compared(batches):
        for b in batches:
            owner, near, dist = [], [], []
            for m in b.column("m"):
                m = m.values
                ids, worst, x = m.field(0).to_numpy(), m.field(1).to_numpy(), vectors_of(m.field(2))
                d = np.sqrt(squares(x, x))
                i, j = np.nonzero((d < worst[:, None] * (1 - 1e-6)) & (ids[:, None] != ids[None, :]))
                owner.append(ids[i])
                near.append(ids[j])
                dist.append(np.sqrt(((x[i] - x[j]) ** 2).sum(-1)))
            if not owner:
                continue
            owner, near, dist = np.concatenate(owner), np.concatenate(near), np.concatenate(dist)
            h = tie(owner, near)
            order = np.lexsort((near, h, dist, owner))
            owner, near, dist, h = owner[order], near[order], dist[order], h[order]
            new = np.r_[True, (owner[1:] != owner[:-1]) | (near[1:] != near[:-1])][: len(owner)]
            owner, near, dist, h = owner[new], near[new], dist[new], h[new]
            starts = np.nonzero(np.r_[True, owner[1:] != owner[:-1]][: len(owner)])[0]
            rank = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
            keep = rank < k
            owner, near, dist, h = owner[keep], near[keep], dist[keep], h[keep]
            starts = np.nonzero(np.r_[True, owner[1:] != owner[:-1]][: len(owner)])[0]
            entries = pa.StructArray.from_arrays([pa.array(dist.astype(np.float32)), pa.array(h), pa.array(near)], names=["d", "h", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(owner[starts]), pa.ListArray.from_arrays(pa.array(np.r_[starts, len(owner)].astype(np.int32)), entries)], names=["id", "nb"])

    return merged(graph.unionAll(rows.mapInArrow(compared, f"id bigint, nb {LIST}")), k)


def neighbour_graph(points: DataFrame, k: int, stages: Stages, orders: int = 4, run: int = RUN, rounds: int = 6, least: float = 0.002, seed: int = 42) -> DataFrame:
    """id, nb: of each point about its k nearest others with their distances, nearest first. With no more points than a run holds the lists are exact.

    Rounds go on until the mean distance to the farthest neighbour falls by less than least of itself.
    """
    graph = stages.store(run_lists(points, k, orders, run, seed), "graph")
    n, before = graph.filter(F.size("nb") > 0).agg(F.count("*"), F.avg(F.element_at("nb", -1)["d"].cast("double"))).first()
    if n <= run:
        return graph
    for _ in range(rounds):
        graph = stages.store(joined_round(points, graph, k), "graph")
        after = graph.filter(F.size("nb") > 0).agg(F.avg(F.element_at("nb", -1)["d"].cast("double"))).first()[0]
        if after >= before * (1 - least):
            break
        before = after
    return graph
