"""Clusters of all rows: planted ones are found, rare ones too, and graphs agree with a walk over them."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gateloom.core.shared import Stages
from gateloom.operators import embedding, graphs, maps


def frame(spark, x):
    return spark.createDataFrame(pd.DataFrame(x, columns=[f"f{i}" for i in range(x.shape[1])]).assign(row_index=range(len(x)))).repartition(4, "row_index")


def blobs(sizes, dims=3, apart=12.0, seed=0):
    rng = np.random.default_rng(seed)
    label = np.repeat(np.arange(len(sizes)), sizes)
    return rng.normal(size=(len(sizes), dims))[label] * apart + rng.normal(size=(len(label), dims)), label


def agreement(found, label):
    """The share of rows whose cluster's largest part is of their label."""
    t = pd.crosstab(found["label"], label[found["row_index"]])
    return t.max(axis=1).sum() / len(label)


def walked(n, edges):
    home = list(range(n))

    def top(i):
        while home[i] != i:
            home[i] = home[home[i]]
            i = home[i]
        return i

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        home[b] = a
    return {i: top(i) for i in range(n)}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(random.Random(4).randrange(60), random.Random(i).randrange(60)) for i in range(45)], []])
def test_components(spark, edges):
    nodes = spark.range(60)
    got = graphs.components(nodes, spark.createDataFrame(edges, "a bigint, b bigint"), Stages(spark))
    assert {r["id"]: r["component"] for r in got.collect()} == walked(60, edges)


def planted(groups=4, size=12, seed=1):
    rng = random.Random(seed)
    n = groups * size
    return n, [(a, b, 1.0) for a in range(n) for b in range(a + 1, n) if rng.random() < (0.7 if a // size == b // size else 0.02)]


@pytest.mark.parametrize("local", [0, 10_000])
def test_communities(spark, local):
    n, edges = planted()
    nodes = spark.range(n + 1)  # the last has no edge
    got = {r["id"]: r["community"] for r in graphs.communities(nodes, spark.createDataFrame(edges, "a bigint, b bigint, w double"), Stages(spark), local=local, turns=6).collect()}
    assert len(got) == n + 1 and got[n] == n
    sets = {frozenset(i for i in range(n) if got[i] == c) for c in {got[i] for i in range(n)}}
    assert sets == {frozenset(range(g * 12, g * 12 + 12)) for g in range(4)}


@pytest.mark.parametrize("local", [0, 100_000])
def test_graph_clusters_are_of_all_rows(spark, local):
    x, label = blobs([60, 50, 40])
    x[7, 1] = np.nan
    got = embedding.graph_clusters(frame(spark, x), ["f0", "f1", "f2"], 12, local=local).toPandas()
    assert sorted(got["row_index"]) == [i for i in range(150) if i != 7] and agreement(got, np.delete(label, 7)[np.searchsorted(np.delete(np.arange(150), 7), np.arange(150).clip(0, 149)).clip(0, 148)]) > 0.98
    assert sorted(got["label"].unique()) == list(range(got["label"].nunique())) and got["label"].nunique() >= 3
    assert embedding.graph_clusters(frame(spark, x).limit(0), ["f0"]).count() == 0


def test_rare_population_keeps_its_code(spark):
    """One row in some thousand, far from all others, next to three large populations."""
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 1, (9_000, 3)), rng.normal(0, 1, (6_000, 3)) + [9, 0, 0], rng.normal(0, 0.2, (4, 3)) + [0, 25, 25]]
    df = frame(spark, x)
    codes = maps.map_codes(df, ["f0", "f1", "f2"], 5, rounds=4, settle=1)
    assert np.isfinite(codes).all() and ((codes - [0, 25, 25]) ** 2).sum(1).min() < 1
    got = embedding.som_clusters(df, ["f0", "f1", "f2"], 3, side=5).toPandas()
    rare = got[got["row_index"] >= 15_000]["label"].unique()
    assert len(rare) == 1 and (got["label"] == rare[0]).sum() == 4 and len(got) == 15_004


def test_sums_of_a_round(spark):
    x, _ = blobs([30, 20, 10])
    codes = x[[0, 35, 55]]
    n, sums, square, most, far = maps.summed(frame(spark, x), ["f0", "f1", "f2"], codes)
    d = ((x[:, None] - codes[None]) ** 2).sum(2)
    near = d.argmin(1)
    for c in range(3):
        own = near == c
        assert n[c] == own.sum() and np.allclose(sums[c], x[own].sum(0)) and square[c] == pytest.approx(d[own, c].sum())
        assert most[c] == pytest.approx(d[own, c].max()) and np.allclose(far[c], x[own][d[own, c].argmax()])


def test_grid_of_five_components(spark):
    """20 ** 5 cells, seven of them occupied, one too thinly to count as a core."""
    places = np.random.default_rng(5).normal(size=(7, 5))
    label = np.repeat(np.arange(7), [50, 60, 70, 45, 80, 55, 5])
    got = embedding.grid_clusters(frame(spark, places[label]), [f"f{i}" for i in range(5)]).toPandas()
    table = pd.crosstab(got["label"], label[got["row_index"]])
    assert len(got) == 365 and sorted(table.index) == [-1, 0, 1, 2, 3, 4, 5] and (table.gt(0).sum(axis=1) == 1).all() and table.loc[-1, 6] == 5


def test_grid_joins_cells_that_touch(spark):
    x, label = blobs([500, 400], dims=5, apart=9.0, seed=2)
    got = embedding.grid_clusters(frame(spark, x), [f"f{i}" for i in range(5)], bins=6, core=30).toPandas()
    inside = got[got["label"] >= 0]
    assert len(inside) > 350 and pd.crosstab(inside["label"], label[inside["row_index"]]).gt(0).sum(axis=1).max() == 1
    big = inside["label"].value_counts()
    assert big.iloc[:2].sum() > 0.95 * len(inside)
    assert embedding.grid_clusters(frame(spark, x).filter(F.lit(False)), ["f0", "f1"]).count() == 0
