"""Exact top-k, whitening and the pair of co-bucketed tables against brute force."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gateloom.llm import copair, topk, whiten

VECTORS = "vec_id bigint, embedding array<float>, key bigint, lane int, x string, id string"
ODD = [None, [], [None] * 4, [1.0, float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0], [0.5, -0.5]]


def vectors(n, dims=4, seed=1, wide=1.0):
    rng = random.Random(seed)
    return [(i, [rng.choice([rng.gauss(0, wide), 0.25, 0.0, -0.0]) for _ in range(dims)]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", "y") for i, v in rows], VECTORS)


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def whole(v, scale):
    return [math.floor(scale * np.float64(np.float32(c))) for c in v]


def all_pairs(rows, every, k, scale=1024):
    out, asked = [], set()
    rows = [(i, whole(v, scale)) for i, v in rows if usable(v)]
    for q, a in rows:
        if q is None or q % every or (q, tuple(a)) in asked:
            continue
        asked.add((q, tuple(a)))
        best = sorted((-sum(x * y for x, y in zip(a, b)), i is None, i or 0) for i, b in rows if i is None or i != q)[:k]
        out += [(q, r + 1, None if null else i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, null, i) in enumerate(best)]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def test_top_scores(spark):
    rows = vectors(70) + [(100 + i, v) for i, v in enumerate(ODD)] + [(None, [0.25] * 4), (7, [0.25] * 4), (7, [0.25] * 4), (20, [1.0] * 4), (10, vectors(70)[10][1])]
    assert found(topk.top_scores(frame(spark, rows), every=10, k=5, rows=16)) == all_pairs(rows, 10, 5)
    assert found(topk.top_scores(frame(spark, rows), every=1, k=200)) == all_pairs(rows, 1, 200)


def test_top_scores_beyond_doubles(spark):
    rows = vectors(12, wide=1e30) + [(20, [1e-3] * 4)]
    assert found(topk.top_scores(frame(spark, rows), every=4, k=6, rows=5)) == all_pairs(rows, 4, 6)


def test_top_scores_of_few(spark):
    assert found(topk.top_scores(frame(spark, []))) == [] and found(topk.top_scores(frame(spark, [(0, [1.0])]))) == []
    assert found(topk.top_scores(frame(spark, [(None, None)]))) == [] and found(topk.top_scores(frame(spark, [(0, [1.0]), (1, [2.0])]))) == [(0, 1, 1, 1024 * 2048)]


@given(st.integers(1, 60), st.integers(1, 6), st.integers(1, 5), st.integers(0, 10**6))
@settings(max_examples=150, deadline=None)
def test_no_outsider_qualifies(n, dims, k, seed):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-9, 10, (n, dims)).astype(float), rng.integers(-9, 10, (5, dims)).astype(float)
    own = rng.random((n, 5)) < 0.1
    for few in (0, 0.5):
        for j, (rows, scores) in enumerate(topk.best_of_block(x, np.argsort(x, axis=0).T, q, own, k, few)):
            assert (scores == x[rows] @ q[j]).all() and not own[rows, j].any()
            want = sorted(-(x[i] @ q[j]) for i in range(n) if not own[i, j])[:k]
            assert sorted(-scores)[:k] == want


def test_reading_stops_early():
    """A query along one axis needs no more than the head of that list, and the rest is never resolved."""
    x = np.zeros((4096, 3))
    x[:, 0] = np.arange(4096)
    (rows, _), = topk.best_of_block(x, np.argsort(x, axis=0, kind="stable").T, np.array([[1.0, 0, 0]]), np.zeros((4096, 1), bool), 10)
    assert len(rows) <= 128 and set(range(4086, 4096)) <= set(rows.tolist())


def exact_covariance(fit):
    n, dims = len(fit), len(fit[0])
    sums = [sum(v[d] for v in fit) for d in range(dims)]
    y = [[n * v[d] - sums[d] for d in range(dims)] for v in fit]
    return sums, [[Fraction(sum(r[a] * r[b] for r in y), n**3) for b in range(dims)] for a in range(dims)]


@pytest.mark.parametrize("wide", [1.0, 1e9, 1e14])
def test_whitening(spark, wide):
    rows = vectors(300, wide=wide) + [(None, [0.5 * wide] * 4), (3, vectors(300, wide=wide)[3][1])] + list(enumerate(ODD, 900))
    got = whiten.whitened(frame(spark, rows)).collect()
    used = [(i, (w := whole(v, 256)) + [0] * (4 - len(w))) for i, v in rows if usable(v)]
    fit = sorted({tuple(v) for _, v in used})
    sums, covariance = exact_covariance(fit)
    n, v = len(fit), np.array([[float(c) for c in r] for r in covariance])
    values = np.linalg.eigvalsh(v)[::-1]
    assert len(got) == 4 * len(used) and {r["n"] for r in got} == {n}
    deviation = Counter((i, str(sum((n * c - s) ** 2 for c, s in zip(x, sums)))) for i, x in used)
    assert Counter((r["vec_id"], r["deviation_digits"]) for r in got if r["component"] == 1) == deviation
    assert all(r["deviation"] == (int(r["deviation_digits"]) if int(r["deviation_digits"]) < 2**63 else None) for r in got)
    assert all(abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-9 and r["identity_error"] < 1e-9 for r in got)
    z = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    by_vector = {x: np.array([z[i, c] for c in range(1, 5)]) for i, x in ((i, tuple(x)) for i, x in used)}
    assert np.abs(np.cov(np.array([by_vector[x] for x in fit]).T, bias=True) - np.eye(4)).max() < 1e-9


@given(st.lists(st.lists(st.integers(-(2**70), 2**70), min_size=3, max_size=3), min_size=1, max_size=20), st.integers(3, 20))
@settings(max_examples=100, deadline=None)
def test_digit_slices_multiply_exactly(rows, bits):
    y = np.array(rows, object)
    assert (whiten.product(y, bits) == y.T.dot(y)).all()
    assert all(sum(d << (32 * i) for i, d in enumerate(whiten.digits(v))) == v for r in rows for v in r)


def test_full_chunk_is_exact():
    y = np.full((whiten.CHUNK, 2), (1 << 40) - 1, np.int64)
    assert whiten.product(y)[0, 1] == whiten.CHUNK * ((1 << 40) - 1) ** 2


def test_whitening_without_variance(spark):
    assert whiten.whitened(frame(spark, [])).count() == 0 and whiten.whitened(frame(spark, [(1, []), (2, None)])).count() == 0
    one = whiten.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in one)
    line = whiten.whitened(frame(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)])).collect()
    assert {r["component"] for r in line if r["whitened"] is not None} == {1} and all(r["identity_error"] < 1e-9 for r in line)


SALES = "sale_id bigint, status string, total double, bucket int"
LINES = "sale_id bigint, line_no int, item_id bigint, file string, is_orphan int"


def pair_rows(n, seed):
    rng = random.Random(seed)
    sales = [(None if rng.random() < 0.05 else rng.randrange(n), rng.choice(["a", None, "é", "ab"]), rng.choice([1.5, None]), 1) for _ in range(n)]
    lines = [(rng.choice([None, 7, 7, rng.randrange(n), rng.randrange(2 * n)]), rng.choice([1, None]), rng.choice([None, 5, rng.randrange(40)]), rng.choice(["x", None]), 0) for _ in range(4 * n)]
    return sales, lines + lines[:5]


def expected(sales, lines, buckets):
    ids = Counter(r[0] for r in sales if r[0] is not None)
    bucket = lambda i: buckets + 1 if i is None else zlib.crc32(b"s%d" % i) % buckets
    of_line = lambda i: buckets if i is not None and i not in ids else bucket(i)
    joined = Counter()
    for r in lines:
        joined[of_line(r[0])] += ids.get(r[0], 0)
    out = {}
    for name, rows, to, of in (("sales", sales, bucket, lambda r: bucket(r[0]) - (bucket(r[0]) % 4 == 1)), ("sale_lines", lines, of_line, lambda r: 0 if r[2] is None else zlib.crc32(b"%d" % r[2]) % buckets)):
        start, final = Counter(map(of, rows)), defaultdict(list)
        for r in rows:
            final[to(r[0])].append(r)
        for b, found in final.items():
            found.sort(key=lambda r: ((r[0] is not None, -(r[0] or 0)), *((c is not None, c.encode() if isinstance(c, str) else c or 0) for c in r[1:])))
            lineage = sorted(Counter(map(of, found)).items())
            sha = lambda x: hashlib.sha256(",".join(x).encode()).hexdigest()
            out[name, b] = len(found), joined[b], sha("" if r[0] is None else str(r[0]) for r in found), sha(f"{s}:{n}" for s, n in lineage), not (len(lineage) == 1 and start[lineage[0][0]] == len(found)), found
    return out


@pytest.mark.parametrize(("n", "buckets", "page"), [(60, 20, 3), (200, 6, 1000), (9, 600, 10)])
def test_pair(spark, n, buckets, page):
    sales, lines = pair_rows(n, n)
    got = copair.co_bucketed(spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES), buckets=buckets, page=page).collect()
    want = expected(sales, lines, buckets)
    assert {(r["table_name"], r["bucket"]): (r["n_rows"], r["n_joined"], r["ids_sha256"], r["lineage_sha256"], r["rewritten"]) for r in got} == {k: v[:5] for k, v in want.items()}
    for r in got:
        file = pq.ParquetFile(r["path"].removeprefix("file:")).read()
        assert ",".join(file.column_names) == r["columns"] and [tuple(x.values()) for x in file.to_pylist()] == want[r["table_name"], r["bucket"]][5]
    top = os.path.commonpath([r["path"] for r in got])
    assert {os.path.join(d, f) for d, _, names in os.walk(top) for f in names} == {r["path"] for r in got}
    assert {r["rewritten"] for r in got} == {True, False}


def test_pair_of_empty_tables(spark):
    sales, lines = pair_rows(9, 1)
    assert copair.co_bucketed(spark.createDataFrame([], SALES), spark.createDataFrame([], LINES)).count() == 0
    only = copair.co_bucketed(spark.createDataFrame([], SALES), spark.createDataFrame(lines, LINES), buckets=5).collect()
    assert {r["bucket"] for r in only} == {5, 6} and sum(r["n_rows"] for r in only) == len(lines)
    assert sum(r["n_rows"] for r in copair.co_bucketed(spark.createDataFrame(sales, SALES), spark.createDataFrame([], LINES)).collect()) == len(sales)
