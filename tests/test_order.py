"""Ranks, running sums and order statistics against sorted lists."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gateloom.core import order
from gateloom.operators import statistics

SCHEMA = "g string, x double, y double, i bigint"


def rows(n=400, seed=3):
    rng = random.Random(seed)
    out = [(rng.choice(["a", "a", "b", None]), rng.choice([rng.gauss(0, 1), 7.0, 7.0, 1e6 * rng.random(), -0.0]), rng.choice([None, float("nan"), float(rng.randrange(5))]), i) for i in range(n)]
    return [*out, ("lone", 2.5, None, n), ("same", 4.0, 1.0, n + 1), ("same", 4.0, 2.0, n + 2), ("same", 4.0, 2.0, n + 3)]


def numbers(data, g, c):
    return sorted(v for r in data if r[0] == g and (v := r[c]) is not None and not math.isnan(v))


@pytest.mark.parametrize(("bins", "few"), [(3, 2), (16, 40), (4096, 50_000)])
def test_order_statistics(spark, bins, few):
    data = rows()
    fractions = [0.0, 0.1587, 0.5, 0.95, 1.0]
    df = spark.createDataFrame(data, SCHEMA)
    for how in ("linear", "nearest", "floor"):
        got = {(r["g"], r["channel"], r["fraction"]): (r["n"], r["value"]) for r in order.order_statistics(df, ["g"], ["x", "y"], fractions, how, bins, few).collect()}
        want = {}
        for g in ("a", "b", None, "lone", "same"):
            for c, name in ((1, "x"), (2, "y")):
                v = numbers(data, g, c)
                for f in fractions if v else []:
                    at = f * (len(v) - 1)
                    want[g, name, f] = len(v), {"linear": np.percentile(v, f * 100), "nearest": v[math.floor(at + 0.5)], "floor": v[math.floor(at)]}[how]
        assert set(got) == set(want)
        assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], rel=1e-12, abs=1e-12) for k in want)


def test_order_statistics_of_nothing(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert order.order_statistics(df.limit(0), ["g"], ["x"], [0.5]).count() == 0
    assert order.order_statistics(df, [], ["x"], [0.5]).first()["value"] == pytest.approx(np.median([r[1] for r in rows()]))
    assert {r["g"]: r["mad"] for r in statistics.mad(df, ["g"], "y").collect()}["lone"] == 0


def test_mad(spark):
    data = rows()
    got = {r["g"]: r["mad"] for r in statistics.mad(spark.createDataFrame(data, SCHEMA), ["g"], "x").collect()}
    for g in ("a", "b", None, "same"):
        v = np.array(numbers(data, g, 1))
        assert got[g] == pytest.approx(np.median(np.abs(v - np.median(v))))


@pytest.mark.parametrize("n", [1, 7, 64])
def test_numbered(spark, n):
    data = rows()
    got = order.numbered(spark.createDataFrame(data, SCHEMA).repartition(5), ["g"], ["x", "i"], "k", n).collect()
    for g in {r[0] for r in data}:
        want = sorted(((r[1], r[3]) for r in data if r[0] == g))
        assert [(r["x"], r["i"]) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["k"])] == want
        assert sorted(r["k"] for r in got if r["g"] == g) == list(range(len(want)))


def test_numbers_of_a_group_are_dealt_to_many_tasks(spark):
    """A third of the rows in one group: no window holds a whole group."""
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"))
    plan = order.numbered(df, ["g"], ["x"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan.split("Window")[-1] or "_range" in plan
    cut = df.withColumn("r", order.ranges(df, "x", 20)).groupBy("g", "r").count().collect()
    assert max(r["count"] for r in cut) < 80 and sum(r["count"] for r in cut) == 3000


def test_average_ranks(spark):
    data = [(v,) for v in [3.0, 1.0, 3.0, 2.0, 3.0, 1.0]]
    got = sorted((r["x"], r["rank"], r["ties"]) for r in statistics.average_ranks(spark.createDataFrame(data, "x double"), "x").collect())
    assert got == [(1.0, 1.5, 2)] * 2 + [(2.0, 3.0, 1)] + [(3.0, 5.0, 3)] * 3


def test_huber_slopes_are_those_of_each_group(spark):
    from gateloom.operators.compensation import huber_slope, huber_slopes

    rng = np.random.default_rng(8)
    x, g = rng.uniform(1, 10, 300), np.array(["a", "b", "zero"])[np.arange(300) % 3]
    y = np.where(g == "a", 2.0, -0.5) * x + rng.normal(0, 0.3, 300) + np.where(rng.random(300) < 0.1, 60, 0)
    x = np.where(g == "zero", 0.0, x)
    rows = [(str(k), float(a), float(b)) for k, a, b in zip(g, x, y)] + [("a", None, 1.0), ("none", None, 1.0)]
    got = {r["g"]: r["slope"] for r in huber_slopes(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    assert got["zero"] == got["none"] == 0
    for k, true in (("a", 2.0), ("b", -0.5)):
        assert got[k] == pytest.approx(huber_slope(x[g == k], y[g == k]), abs=1e-4) and got[k] == pytest.approx(true, abs=0.15)


def test_numbering_of_many_rows_takes_more_tasks(spark, monkeypatch):
    """What a task sorts doesn't grow with the rows; the numbers stay."""
    monkeypatch.setattr(order, "TASK_ROWS", 100, raising=False)
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"))
    out = order.numbered(df, ["g"], ["x"])
    assert out.filter(F.col("row_index") != F.floor(F.col("x") / 3)).count() == 0
    assert "RepartitionByExpression" in out._jdf.queryExecution().optimizedPlan().toString()


def test_equal_sample_ranks_few_rows(spark):
    """The rows of least key of each sample, null included, though only some of them are ranked; also where a sample has fewer."""
    from gateloom.operators import analysis

    df = spark.range(60_000).select(F.when(F.col("id") < 50, "few").when(F.col("id") % 2 == 0, "even").alias("sample"), F.col("id").alias("row_index"))
    got = analysis.equal_sample(df, 2_000)
    keyed = [(r["sample"], r["_k"], r["row_index"]) for r in df.withColumn("_k", analysis.portable_key("sample", "row_index")).collect()]
    for s, n in (("few", 50), ("even", 2_000), (None, 2_000)):
        assert {r["row_index"] for r in got.collect() if r["sample"] == s} == {i for _, i in sorted((k, i) for own, k, i in keyed if own == s)[:n]}
    assert "_last" in got._jdf.queryExecution().optimizedPlan().toString()
