"""A self-organising map of all rows: batch rounds, each one aggregation by code.

A round finds each row's nearest code in its task and sums rows by code; the sums, a few numbers a code, are spread over neighbouring codes on the driver. The neighbourhood shrinks; at last codes are plain means of
their rows. As means follow the many, codes are then given to rows that lie far from all: the farthest row takes the code that the map can best spare, until no row lies farther than `far` times the
root mean square distance; so a rare population keeps a code of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateloom.operators import models


def summed(rows: DataFrame, names: Sequence[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code: rows, their sums, their squared distances, the largest of these and its row. Codes without rows have zeros."""
    names, d, k = list(names), len(names), len(codes)

    def part(batches):
        n, sums, square, most, far = np.zeros(k, np.int64), np.zeros((k, d)), np.zeros(k), np.full(k, -1.0), np.zeros((k, d))
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1).astype(float)
            near = models.nearest(x, codes)
            off = ((x - codes[near]) ** 2).sum(1)
            n += np.bincount(near, minlength=k)
            square += np.bincount(near, off, k)
            for j in range(d):
                sums[:, j] += np.bincount(near, x[:, j], k)
            order = np.argsort(off, kind="stable")  # of a code's rows the farthest is written last
            best = np.full(k, -1)
            best[near[order]] = order
            new = (best >= 0) & (np.where(best >= 0, off[np.maximum(best, 0)] if len(off) else 0, -1) > most)
            most[new], far[new] = off[best[new]], x[best[new]]
        has = np.nonzero(n)[0]
        lists = lambda m: pa.array(m[has].tolist(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(n[has]), pa.array(square[has]), pa.array(most[has]), lists(sums), lists(far)], names=["code", "n", "square", "most", "sums", "far"])

    found = rows.select(*names).mapInArrow(part, "code int, n bigint, square double, most double, sums array<double>, far array<double>")
    each = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(d)]
    out = found.groupBy("code").agg(F.sum("n").alias("n"), F.sum("square").alias("square"), F.max(F.struct("most", "far")).alias("m"), *each).collect()  # a row for each code
    n, sums, square, most, far = np.zeros(k), np.zeros((k, d)), np.zeros(k), np.full(k, -1.0), np.zeros((k, d))
    for r in out:
        c = r["code"]
        n[c], square[c], most[c], far[c], sums[c] = r["n"], r["square"], r["m"]["most"], r["m"]["far"], [r[f"s{i}"] for i in range(d)]
    return n, sums, square, most, far


def start(rows: DataFrame, names: Sequence[str], side: int, seed: int) -> np.ndarray:
    """Codes from k-means' parallel seeds on all rows, laid on the grid along their two main directions."""
    v = VectorAssembler(inputCols=list(names), outputCol="_v").transform(rows)
    c = np.array(KMeans(featuresCol="_v", k=side * side, maxIter=1, seed=seed).fit(v).clusterCenters())
    c = c[np.arange(side * side) % len(c)]
    axes = np.linalg.svd(c - c.mean(0), full_matrices=False)[2]
    place = (c - c.mean(0)) @ axes[:2].T
    if place.shape[1] < 2:
        place = np.c_[place, np.zeros(len(place))]
    order = np.argsort(place[:, 0], kind="stable").reshape(side, side)
    return c[np.concatenate([r[np.argsort(place[r, 1], kind="stable")] for r in order])]


def map_codes(rows: DataFrame, names: Sequence[str], side: int = 10, rounds: int = 10, settle: int = 3, repairs: int = 10, far: float = 4.0, seed: int = 42) -> np.ndarray:
    """The codes of a map of side by side; rows without nulls among names, one at least."""
    codes = start(rows, names, side, seed)
    at = np.stack(np.divmod(np.arange(side * side), side), axis=1)
    apart = ((at[:, None] - at[None]) ** 2).sum(2)
    for r in range(rounds + settle):
        n, sums, *_ = summed(rows, names, codes)
        width = max(0.5, side / 2 * (1 - r / rounds))
        k = np.exp(-apart / (2 * width**2)) if r < rounds else np.eye(len(codes))
        mass = k @ n
        codes = np.where(mass[:, None] > 1e-9, (k @ sums) / np.maximum(mass, 1e-12)[:, None], codes)
    for _ in range(repairs):
        n, sums, square, most, place = summed(rows, names, codes)
        codes = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], codes)
        limit = far**2 * square.sum() / max(n.sum(), 1)
        needy = [c for c in np.argsort(-most) if most[c] > limit]
        if not needy:
            break
        d = ((codes[:, None] - codes[None]) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        spare = [c for c in np.argsort(n * d.min(1)) if c not in needy]  # what its rows would lose by going to the next code
        taken: list[np.ndarray] = []
        for c, free in zip(needy, spare[: max(1, side)]):
            if all(((place[c] - t) ** 2).sum() > limit for t in taken):
                codes[free] = place[c]
                taken.append(place[c])
    return codes
