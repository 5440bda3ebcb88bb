"""Gates against plain Python, and their invariants."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gateloom.operators.gates import Edits, Gate, Population, chain, copy_name, first_match, quadrants, rule, tree_counts


def inside(g, x, y):
    if g.kind in ("interval", "line"):
        r = min(g.xs) <= x <= max(g.xs)
    elif g.kind == "rectangle":
        r = min(g.xs) <= x <= max(g.xs) and min(g.ys) <= y <= max(g.ys)
    elif g.kind == "ellipse":
        rx, ry = (max(g.xs) - min(g.xs)) / 2, (max(g.ys) - min(g.ys)) / 2
        dx, dy = x - (max(g.xs) + min(g.xs)) / 2, y - (max(g.ys) + min(g.ys)) / 2
        u, v = dx * math.cos(g.angle) + dy * math.sin(g.angle), dy * math.cos(g.angle) - dx * math.sin(g.angle)
        r = rx > 0 and ry > 0 and (u / rx) ** 2 + (v / ry) ** 2 <= 1
    elif g.kind == "polygon":
        r = False
        for i in range(len(g.xs)):
            (x0, y0), (x1, y1) = (g.xs[i], g.ys[i]), (g.xs[i - 1], g.ys[i - 1])
            if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
                r = not r
    return r != g.invert


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 10, (400, 2)).round(1))]
    return rows, spark.createDataFrame(rows, "i int, x double, y double").cache()


@pytest.mark.parametrize(
    "gate",
    [
        Gate("rectangle", "x", "y", (2.0, 7.0), (3.0, 8.0)),
        Gate("rectangle", "x", "y", (2.0, 7.0), (3.0, 8.0), invert=True),
        Gate("interval", "x", None, (5.0, 1.0)),
        Gate("ellipse", "x", "y", (1.0, 9.0), (4.0, 6.0), angle=0.7),
        Gate("polygon", "x", "y", (1.0, 9.0, 5.0, 8.0, 2.0), (1.0, 1.0, 5.0, 9.0, 9.0)),
        Gate("polygon", "x", "y", (1.0, 9.0, 9.0, 1.0), (1.0, 9.0, 1.0, 9.0)),
    ],
)
def test_against_python(points, gate):
    rows, df = points
    got = {r[0] for r in df.where(gate.column(df.columns)).collect()}
    assert got == {i for i, x, y in rows if inside(gate, x, y)}


def test_missing_and_nan(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (1.0, float("nan")), (None, 1.0), (1.0, 1.0)], "x double, y double")
    assert df.where(Gate("rectangle", "x", "y", (0.0, 2.0), (0.0, 2.0)).column(df.columns)).count() == 1
    assert df.where(Gate("interval", "absent", None, (0.0, 2.0), invert=True).column(df.columns)).count() == 0
    assert df.where(Gate("rectangle", "x", "absent", (0.0, 2.0), (-1.0, 1.0)).column(df.columns)).count() == 2


def test_quadrants_part_the_plane(points):
    _, df = points
    counts = tree_counts(df.withColumn("sample", F.lit("s")), quadrants("x", "y", 5.0, 5.0, "P")).collect()
    assert sum(r["count"] for r in counts) == 400
    assert [r["population"] for r in counts] == ["P Q1", "P Q2", "P Q3", "P Q4"]


def test_complement_and_subset(points):
    _, df = points
    g = Gate("polygon", "x", "y", (1.0, 9.0, 5.0), (1.0, 2.0, 9.0))
    inv = Gate(g.kind, g.x, g.y, g.xs, g.ys, invert=True)
    n = df.where(g.column(df.columns)).count()
    assert n + df.where(inv.column(df.columns)).count() == 400
    assert df.where(chain([g, Gate("interval", "x", None, (0.0, 4.0))], df.columns)).count() <= n


def test_empty_tree_denominators(spark):
    df = spark.createDataFrame([("a", 1.0)], "sample string, x double")
    tree = (Population("none", Gate("interval", "x", None, (5.0, 6.0)), (Population("below", Gate("interval", "x", None, (0.0, 9.0))),)),)
    r = {x["population"]: x for x in tree_counts(df, tree).collect()}
    assert r["none/below"]["count"] == 0 and r["none/below"]["pct_parent"] == 0.0


def test_rules(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, -1.0), (-1.0, -1.0)], "a double, b double")
    cuts = {"a": 0.0, "b": 0.0}
    both, one, none = rule([("a", True), ("b", True)], cuts, df.columns), rule([("a", True)], cuts, df.columns), rule([], cuts, df.columns)
    assert [r[0] for r in df.select(first_match([both, one])).collect()] == [0, 1, -1]
    assert df.select(F.count_if(both), F.count_if(one), F.count_if(none)).first()[:] == (1, 2, 0)
    assert df.where(rule([("c", True)], cuts, df.columns)).count() == 0


def test_trees_are_values():
    t = Population("a", Gate("interval", "x"), (Population("b", Gate("interval", "x")),))
    assert t.toggled("b").children[0].gate.invert and not t.children[0].gate.invert
    assert t.without("b").children == () and t.renamed("b", "c").children[0].name == "c"
    e = Edits((t,))
    e.set((t.without("b"),))
    e.undo()
    assert e.now == (t,)
    e.redo()
    assert e.now == (t.without("b"),)
    assert copy_name("g", ["g copy", "g copy 2"]) == "g copy 3"


@given(st.lists(st.tuples(st.floats(-5, 5), st.floats(-5, 5)), min_size=3, max_size=6, unique=True))
@settings(max_examples=25, deadline=None)
def test_new_vertex_changes_no_membership(pts):
    g = Gate("polygon", "x", "y", tuple(p[0] for p in pts), tuple(p[1] for p in pts))
    assert len(g.with_vertex().xs) == len(pts) + 1


def test_outline():
    assert len(Gate("ellipse", "x", "y", (0.0, 2.0), (0.0, 2.0)).outline()) == 32
    assert Gate("rectangle", "x", "y", (0.0, 2.0), (1.0, 3.0)).as_polygon().xs == (0.0, 2.0, 2.0, 0.0)
    assert Gate("interval", "x", None, (1.0, 2.0)).moved(1, 0).xs == (2.0, 3.0)
