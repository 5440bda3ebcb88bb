"""Helpers that the corpus operators share: storage between stages, hashing of words, sizes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of more rows than this is never broadcast.
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or, where it is unset and all run in one process, one made here."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir isn't set: the executors need a folder that all of them and the driver see")
        found = tempfile.mkdtemp(prefix="gateloom-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str = "stage", compression: str | None = None) -> DataFrame:
    """Writes df as Parquet (in the session's compression, unless given) into the shared folder and returns the table read again; this cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gateloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def shards(spark: SparkSession) -> int:
    """The number of partitions that the session uses for a shuffle."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Joins on keys; small is broadcast only if a count shows BROADCAST_ROWS rows at most, else Spark shuffles and AQE splits hot keys."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return big.join(small, keys, how)


class WordHashes(dict):
    """64-bit hashes of words, remembered; it forgets all when it holds too many, so its memory is bounded."""

    def __init__(self, seed: int = 0, most: int = 400_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ascii_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between ASCII white space (0x20, 0x09 to 0x0D) as UTF-8; null has none. lower: A-Z become a-z, nothing else."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def texts_of(column) -> Iterable[str]:
    """An Arrow string column as Python strings; null becomes empty."""
    return ["" if x is None else x for x in column.to_pylist()]


_MEMORY: dict[str, object] = {}


def memory(key: str, make):
    """What a Python worker remembers from task to task under key; it drops what it remembered under other keys."""
    if key not in _MEMORY:
        _MEMORY.clear()
        _MEMORY[key] = make()
    return _MEMORY[key]


def forget() -> None:
    """Drops all that memory() holds."""
    _MEMORY.clear()


def bites(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterable[pa.RecordBatch]:
    """The batches in slices of so many rows, so that few texts are Python objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def lean(least: int = 1 << 18) -> None:
    """Makes this process give arrays of `least` bytes or more back to the system as soon as they are freed (glibc only; elsewhere nothing).

    Each such array is made of fresh pages, which takes longer than to fill it: where many are made, `least` should be above their size.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, least)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 4 * least if least > 1 << 18 else 1 << 17)  # M_TRIM_THRESHOLD, by default 128 KB
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        pass


def blocked(docs: DataFrame, *columns: str) -> DataFrame:
    """block, data: docs dealt by block, a hash of doc_id and text, as many blocks as shuffle partitions.

    data is a compressed Arrow table of some rows: id (doc_id as bigint, null as the least bigint), text (null: empty) and
    the columns asked for. opened() reads it. Stages of one plan that read both columns share the shuffle.
    """
    n = shards(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *columns)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int"))

    def split(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            table = pa.Table.from_batches([b])
            block = table.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            table, block = table.drop_columns(["block"]).take(pa.array(order)), block[order]
            edge = np.nonzero(np.r_[True, block[1:] != block[:-1]])[0] if len(block) else np.zeros(0, np.int64)
            names, data = [], []
            for x, y in zip(edge.tolist(), [*edge[1:].tolist(), len(block)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as to:
                    to.write_table(table.slice(x, y - x).combine_chunks())
                names.append(int(block[x]))
                data.append(squeeze.compress(sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(data, pa.binary())], names=["block", "data"])

    return rows.mapInArrow(split, "block int, data binary").repartition(n, "block")


def slots(n: int) -> np.ndarray:
    """An int for each of n partitions that Spark's hash partitioning of an int column sends to it."""
    out, left, a = np.full(n, -1, np.int32), n, 0
    while left:
        v = np.arange(a, a + 4 * n, dtype=np.uint32)
        rotated = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
        with np.errstate(over="ignore"):
            h = rotated(v * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593) ^ np.uint32(42)
            h = (rotated(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
            h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
            h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        part = (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % n
        first, at = np.unique(part, return_index=True)
        new = out[first] < 0
        out[first[new]] = v[at[new]].astype(np.int32)
        left, a = int((out < 0).sum()), a + 4 * n
    return out


def dealt(part: np.ndarray, columns: dict[str, np.ndarray], names: np.ndarray) -> pa.RecordBatch:
    """part, data: the rows of equal-length columns, packed for each part (a number below len(names)); gathered() unpacks them."""
    squeeze = zstandard.ZstdCompressor(level=3)
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns.values()]
    edge = np.nonzero(np.r_[True, part[1:] != part[:-1]])[0] if len(part) else np.zeros(0, np.int64)
    data = [squeeze.compress(b"".join(np.ascontiguousarray(c[x:y]).view(np.uint8).reshape(y - x, -1).T.tobytes() for c in columns)) for x, y in zip(edge.tolist(), [*edge[1:].tolist(), len(part)])]
    return pa.RecordBatch.from_arrays([pa.array(names[part[edge]], pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])


def gathered(batches: Iterable[pa.RecordBatch], types: dict[str, np.dtype]) -> dict[str, np.ndarray]:
    """All rows of a task's dealt() batches, by column."""
    grow, width = zstandard.ZstdDecompressor(), sum(np.dtype(t).itemsize for t in types.values())
    found: dict[str, list[np.ndarray]] = {c: [np.zeros(0, t)] for c, t in types.items()}
    for b in batches:
        for packed in b.column("data").to_pylist():
            raw, at = np.frombuffer(grow.decompress(packed), np.uint8), 0
            n = len(raw) // width
            for c, t in types.items():
                k = np.dtype(t).itemsize
                found[c].append(np.ascontiguousarray(raw[at : at + n * k].reshape(k, n).T).view(t).reshape(-1))
                at += n * k
    return {c: np.concatenate(found.pop(c)) for c in types}


def opened(data: Iterable[bytes]) -> pa.Table | None:
    """The rows of a block; None if there are none."""
    grow = zstandard.ZstdDecompressor()
    parts = [pa.ipc.open_stream(grow.decompress(x)).read_all() for x in data]
    return pa.concat_tables(parts) if parts else None


def blocks_of(batches) -> Iterable[tuple[int, pa.Table]]:
    """(block, rows) for each block in batches of a blocked() table."""
    held: dict[int, list[bytes]] = {}
    for b in batches:
        for block, data in zip(b.column("block").to_pylist(), b.column("data").to_pylist()):
            held.setdefault(block, []).append(data)
    for block in list(held):
        yield block, opened(held.pop(block))
