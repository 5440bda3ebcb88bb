"""Exact top-k search by inner product over sorted lists, read in order only.

Each block of vectors has one list a dimension, its rows sorted by that component. A query with a positive component reads
the list from its upper end, one with a negative component from its lower end, all lists to the same depth. What a row has
not been met in yet lies between the list's far end and the next entry; so each row has a lower and an upper bound of its
score. Reading stops for a query when few rows are left whose upper bound reaches the k-th best lower bound: no outsider can
qualify, whatever is unread. The scores of those rows are then resolved from their vectors.

Blocks have at most BLOCK rows and are cut from the table as it lies, without a shuffle of vectors. Queries are all rows whose id
is divisible by a number; they travel in groups, a copy to each lane of blocks. Each pair of a block and a group gives at most k rows a query,
and the best k of all blocks are kept. Every task holds one block and one group at a time.

Results in the odd cases. Vectors that are null or hold null or non-finite components (or such that only scaling makes infinite) take no part. Vectors of
unlike lengths are multiplied over the components that both have (an empty vector scores 0). A null id is no query, is a candidate, and comes last among equal scores.
Rows with the query's id aren't its candidates; other repeated rows are candidates each. Queries of equal id and vector answer once. Scores are exact at any size; one beyond a
bigint is ranked exactly and shown as the nearest bigint. An empty table gives no rows. Columns besides the two named don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gateloom.llm.common import shards, slots

#: Rows of a block, queries of a group at most, and queries that read a block's lists together: so many that their bounds stay in the processor's cache.
BLOCK, GROUP, TOGETHER = 4096, 256, 64
#: A query stops reading a block when so small a share of its rows (or 4 k rows) can still be among the best.
FEW = 1 / 32
#: A double is exact for whole numbers up to this.
EXACT = 2**53

#: The query's rows in DuckDB's SQL.
ORACLE = """WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum([p[1] * p[2] for p in list_zip(q.x, c.x)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10"""


def whole_vectors(table: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """id bigint, v array<double>: each component times scale, rounded down; rows that take no part are left out."""
    v = F.transform(F.col(vector_column).cast("array<double>"), lambda x: x * F.lit(float(scale)))
    fits = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))), F.lit(False))
    return table.select(F.col(id_column).cast("bigint").alias("id"), v.alias("v")).filter(fits)


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of doubles as rows of whole doubles, filled with zeros to the longest."""
    flat, ends = np.floor(column.flatten().to_numpy(zero_copy_only=False)), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    length = np.diff(ends)
    out = np.zeros((len(length), int(length.max(initial=0))))
    out[np.arange(out.shape[1]) < length[:, None]] = flat
    return out


def packed(x: np.ndarray) -> tuple[str, bytes]:
    """Whole doubles in the narrowest type that holds them."""
    most = float(np.abs(x).max(initial=0))
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    return kind, np.ascontiguousarray(x, kind).tobytes()


def batches_of(batches: Iterable[pa.RecordBatch], rows: int) -> Iterable[pa.Table]:
    """The task's rows in tables of so many rows; the last may be smaller."""
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            take = b.slice(0, rows - n)
            held.append(take)
            n, b = n + take.num_rows, b.slice(take.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def sorted_lists(vectors: DataFrame, lanes: int, rows: int) -> DataFrame:
    """lane, dims, ids, known, kind, x, order: the index, a row for each block; order has the block's rows by each component, ascending."""
    names = slots(lanes)

    def pack(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() * 7919
        for i, t in enumerate(batches_of(batches, rows)):
            ids, x = t.column("id").combine_chunks(), matrix(t.column("v").combine_chunks())
            order = np.argsort(x, axis=0, kind="stable").T
            kind, data = packed(x)
            yield pa.RecordBatch.from_pydict({
                "lane": pa.array([int(names[(at + i) % lanes])], pa.int32()), "dims": pa.array([x.shape[1]], pa.int32()),
                "ids": [ids.fill_null(0).to_numpy().astype("<i8").tobytes()], "known": [ids.is_valid().to_numpy(zero_copy_only=False).astype("u1").tobytes()],
                "kind": [kind], "x": [data], "order": [np.ascontiguousarray(order, "<u2").tobytes()],
            })

    return vectors.mapInArrow(pack, "lane int, dims int, ids binary, known binary, kind string, x binary, order binary").repartition(lanes, "lane")


def query_groups(queries: DataFrame, lanes: int) -> DataFrame:
    """lane, q_dims, q_ids, q_keys, q_kind, q: up to GROUP queries a row, a copy for each lane."""
    names = slots(lanes)

    def pack(batches):
        for t in batches_of(batches, GROUP):
            x = matrix(t.column("v").combine_chunks())
            kind, data = packed(x)
            row = {"q_dims": x.shape[1], "q_ids": t.column("id").to_numpy().astype("<i8").tobytes(), "q_keys": t.column("key").to_numpy().astype("<i8").tobytes(), "q_kind": kind, "q": data}
            for lane in names.tolist():
                yield pa.RecordBatch.from_pylist([{"lane": lane} | row], pa.schema([("lane", pa.int32()), ("q_dims", pa.int32()), ("q_ids", pa.binary()), ("q_keys", pa.binary()), ("q_kind", pa.string()), ("q", pa.binary())]))

    return queries.mapInArrow(pack, "lane int, q_dims int, q_ids binary, q_keys binary, q_kind string, q binary").repartition(lanes, "lane")


def depths(n: int) -> list[int]:
    """How far lists of n entries are read, one round after the other."""
    return sorted({math.ceil(n * x) for x in (1 / 16, 1 / 8, 3 / 16, 1 / 4, 3 / 8, 1 / 2, 3 / 4, 1)} - {0})


def best_of_block(x: np.ndarray, order: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, few: float = FEW) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (a row of q): the rows of x that may be among its k best, and their scores; at least all k best are there.

    own[i, j]: row i is query j's own. x and q hold whole numbers, as doubles if no score reaches EXACT, else as Python's.
    """
    n, dims = x.shape
    out: list = [None] * len(q)
    least = -math.inf if x.dtype == np.float64 else -(10**400)
    one = np.ones((n, dims), x.dtype) if x.dtype == np.float64 else np.full((n, dims), 1, object)
    lists = x[order, np.arange(dims)[:, None]] if n else np.zeros((dims, 0), x.dtype)
    low, high = lists[:, 0], lists[:, -1]
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    bottom = up @ low + down @ high
    lower = np.repeat(bottom[None, :], n, axis=0)
    lower[own] = least
    unread_up, unread_down = one, one.copy()  # 1 where a row has not been met in a list read from that end
    who, done = np.arange(len(q)), 0
    for depth in depths(n):
        for d in range(dims):
            for weight, entries, far, unread in ((up[:, d], slice(n - depth, n - done), low[d], unread_up), (down[:, d], slice(done, depth), high[d], unread_down)):
                rows = order[d, entries]
                unread[rows, d] = 0
                if weight.any():
                    lower[rows] += np.outer(lists[d, entries] - far, weight)
        done = depth
        if depth < n:  # the next entry of each list bounds what is unread
            upper = lower + unread_up @ (up * (lists[:, n - depth - 1] - low)).T + unread_down @ (down * (lists[:, depth] - high)).T
        else:
            upper = lower
        if n > k:
            kth = np.partition(np.ascontiguousarray(lower.T), n - k, axis=1)[:, n - k] if x.dtype == np.float64 else np.sort(lower, axis=0)[n - k]
            left = upper >= kth
        else:
            left = np.ones(lower.shape, bool)
        ready = (left.sum(axis=0) <= max(4 * k, few * n)) | (depth == n)
        for j in np.nonzero(ready)[0].tolist():
            rows = np.nonzero(left[:, j] & ~own[:, j])[0]
            out[who[j]] = rows, x[rows] @ q[j]
        if ready.all():
            break
        rest = np.nonzero(~ready)[0]
        q, up, down, who, own, lower = q[rest], up[rest], down[rest], who[rest], own.take(rest, axis=1), lower.take(rest, axis=1)
    return out


def searched(rows: Iterable[pa.RecordBatch], k: int):
    """query_id, key, vec_id, score: the k best of each pair of a block and a group of queries."""
    for b in rows:
        for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
            ids, known = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["known"], "u1").astype(bool)
            q_ids, keys = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["q_keys"], "<i8")
            dims = min(r["dims"], r["q_dims"])
            x = np.frombuffer(r["x"], r["kind"]).reshape(len(ids), -1)[:, :dims].astype(float) if r["dims"] else np.zeros((len(ids), 0))
            q = np.frombuffer(r["q"], r["q_kind"]).reshape(len(q_ids), -1)[:, :dims].astype(float) if r["q_dims"] else np.zeros((len(q_ids), 0))
            order = np.frombuffer(r["order"], "<u2").reshape(-1, len(ids))[:dims].astype(np.int64)
            if 4 * max(dims, 1) * np.abs(x).max(initial=0) * np.abs(q).max(initial=0) >= EXACT:
                x, q = (np.array([[int(c) for c in v] for v in m.tolist()], object).reshape(m.shape) for m in (x, q))
            own = (ids[:, None] == q_ids[None, :]) & known[:, None]
            found: dict[str, list] = {"query_id": [], "key": [], "vec_id": [], "score": []}
            best = (r for i in range(0, len(q), TOGETHER) for r in best_of_block(x, order, q[i : i + TOGETHER], own[:, i : i + TOGETHER], k))
            for qid, key, (at, score) in zip(q_ids.tolist(), keys.tolist(), best):
                ranked = sorted((-int(s), not known[i], int(ids[i])) for i, s in zip(at.tolist(), score.tolist()))[:k]
                found["query_id"] += [qid] * len(ranked)
                found["key"] += [key] * len(ranked)
                found["vec_id"] += [None if null else i for _, null, i in ranked]
                found["score"] += [str(-s) for s, _, _ in ranked]
            yield pa.RecordBatch.from_pydict(found, pa.schema([("query_id", pa.int64()), ("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.string())]))


def top_scores(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = 1024, every: int = 100, k: int = 10, rows: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose id is divisible by every, the k rows with the highest inner products of the scaled vectors."""
    vectors = whole_vectors(table, id_column, vector_column, scale)
    n = vectors.count()
    lanes = max(1, min(math.ceil(n / rows), 4 * shards(table.sparkSession)))
    queries = vectors.filter(F.col("id") % every == 0).distinct().withColumn("key", F.xxhash64("v"))
    pairs = sorted_lists(vectors, lanes, min(rows, 1 << 16)).join(query_groups(queries.repartition(max(1, math.ceil(n / every / GROUP)), "id"), lanes), "lane")
    found = pairs.mapInArrow(lambda b: searched(b, k), "query_id bigint, key bigint, vec_id bigint, score string")
    # scores beyond 38 digits compare by sign, length and digits
    minus, digits = F.col("score").startswith("-"), F.regexp_replace("score", "^-", "")
    size = F.when(minus, -F.length(digits)).otherwise(F.length(digits))
    mirrored = F.when(minus, F.translate(digits, "0123456789", "9876543210")).otherwise(digits)
    best = Window.partitionBy("query_id", "key").orderBy(size.desc(), mirrored.desc(), F.col("vec_id").asc_nulls_last())
    near = F.coalesce(F.expr("try_cast(score AS bigint)"), F.when(minus, F.lit(-(1 << 63))).otherwise(F.lit((1 << 63) - 1)))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", near.alias("score"))
