"""Graphs as tables of edges: connected components and communities by rounds of joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateloom.core.shared import Stages
from gateloom.operators import models

#: A contracted graph of no more edges is finished by the driver.
LOCAL_EDGES = 200_000


def components(nodes: DataFrame, edges: DataFrame, stages: Stages, rounds: int = 100) -> DataFrame:
    """id, component: the least id that a node reaches. nodes: id; edges: a, b, undirected, of known nodes.

    Each round takes the least label among neighbours and then that label's own label, so long chains shorten by half.
    """
    both = stages.store(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "component-edges")
    label = stages.store(nodes.select("id", F.col("id").alias("component")), "components")
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        least = label.join(near, "id", "left").select("id", F.col("component").alias("before"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = label.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = stages.store(least.join(jump, "component").select("id", "before", F.least("component", "further").alias("component")), "components")
        changed = new.filter("component <> before").limit(1).count()
        label = new.select("id", "component")
        if not changed:
            break
    return label


def moved(both: DataFrame, state: DataFrame, total: float, turn: int) -> DataFrame:
    """id, k, com, changed after one round of local moves: nodes whose turn it is go to the neighbouring community with the largest gain in modularity."""
    mass = state.groupBy("com").agg(F.sum("k").alias("mass"))
    links = both.join(state.select(F.col("id").alias("b"), "com"), "b").groupBy(F.col("a").alias("id"), "com").agg(F.sum("w").alias("w"))
    options = links.unionByName(state.select("id", "com", F.lit(0.0).alias("w"))).groupBy("id", "com").agg(F.sum("w").alias("w"))
    own = state.select("id", "k", F.col("com").alias("old"))
    judged = options.join(own, "id").join(mass, "com").withColumn("gain", F.col("w") - (F.col("mass") - F.when(F.col("com") == F.col("old"), F.col("k")).otherwise(0.0)) * F.col("k") / F.lit(total))
    best = judged.groupBy("id").agg(F.max(F.struct("gain", (-F.col("com")).alias("c"))).alias("best"), F.max(F.when(F.col("com") == F.col("old"), F.col("gain"))).alias("stay"), F.first("k").alias("k"), F.first("old").alias("old"))
    goes = (F.col("best.gain") > F.col("stay") + 1e-12) & (F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0)
    return best.select("id", "k", F.when(goes, -F.col("best.c")).otherwise(F.col("old")).alias("com"), goes.alias("changed"))


def communities(nodes: DataFrame, edges: DataFrame, stages: Stages, levels: int = 10, turns: int = 12, local: int = LOCAL_EDGES, seed: int = 0) -> DataFrame:
    """id, community by Louvain's method: rounds of local moves, then contraction, until nothing moves. nodes: id; edges: a, b, w, undirected.

    Half of the nodes, another half each round, move at a time, as neighbours that move at once would swap. A level ends when fewer than one node in 500 moved. Once a contracted graph has
    few edges (local, a bound that is checked), the driver finishes it.
    """
    home = stages.store(nodes.select("id", F.col("id").alias("community")), "communities")
    graph = stages.store(edges.filter("w > 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("w").cast("double").alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w")), "community-graph")
    for level in range(levels):
        if graph.count() > local:
            total = 2 * (graph.agg(F.sum("w")).first()[0] or 0.0)
            if not total:
                break
            both = stages.store(graph.filter("a <> b").unionAll(graph.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "community-links")
            ends = both.select(F.col("a").alias("id"), "w").unionAll(graph.filter("a = b").select("a", F.col("w") * 2))
            state = stages.store(ends.groupBy("id").agg(F.sum("w").alias("k")).withColumn("com", F.col("id")), "community-state")
            n, any_moved = state.count(), 0
            for turn in range(turns):
                new = stages.store(moved(both, state, total, level * turns + turn), "community-state")
                changed = new.filter("changed").count()
                state, any_moved = new.select("id", "k", "com"), any_moved + changed
                if changed * 500 < n and turn % 2:
                    break
            if not any_moved:
                break
            to = state.select("id", "com")
            home = stages.store(home.join(to.withColumnRenamed("id", "community"), "community", "left").select("id", F.coalesce("com", "community").alias("community")), "communities")
            ends_at = graph.join(to.toDF("a", "ca"), "a").join(to.toDF("b", "cb"), "b").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "w")
            graph = stages.store(ends_at.groupBy("a", "b").agg(F.sum("w").alias("w")), "community-graph")
        else:
            rows = graph.orderBy("a", "b").toPandas()  # local edges at most
            ids, at = np.unique(rows[["a", "b"]].to_numpy(), return_inverse=True)
            found = models.louvain(len(ids), at.reshape(-1, 2), rows["w"].to_numpy(), seed=seed) if len(ids) else np.zeros(0, int)
            least = {c: int(ids[found == c].min()) for c in np.unique(found)}
            to = nodes.sparkSession.createDataFrame([(int(i), least[c]) for i, c in zip(ids, found)], "community bigint, com bigint")
            return stages.store(home.join(to, "community", "left").select("id", F.coalesce("com", "community").alias("community")), "communities")
    return home
