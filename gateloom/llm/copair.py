"""Two tables stored in buckets of one key: found out by an index of sorted keys, rewritten file by file.

Both tables start in numbered files of their own rules. An index of the first table holds, for each bucket and page, its distinct keys in order with
their counts; it lies as Parquet beside the tables. The other table's keys, counted by starting file, look themselves up in it by binary search.
That gives the orphans, the rows of the inner join, and, before any row moves, what each final file will hold:
rows, digest of its keys, and from which starting files its rows come. A starting file whose rows are just those of a final file stays;
the others are read once more, dealt to their buckets (orphans, found by a join with orphan keys alone, to one of their own), sorted and written, and the
old files go.

Payloads are never joined with payloads. A page has about PAGE keys however large the tables are, so a lookup's memory is bounded; a key that a
third of the rows has is counted before it moves, so its page has one entry a starting file. A final file is written by one task, which sorts it on disk where it must, as a file can't be
written by two. The driver sees numbers of files, not rows.

Results in the odd cases. Null keys have a bucket of their own (buckets + 1) in both tables; the other table's keys that the first lacks go to bucket `buckets`. Repeated keys and rows are
kept, and multiply in n_joined. A null in the column that starts the other table means file 0. Sorting has nulls first; columns must be of types that Spark can sort. Columns named as
the working columns don't clash. An empty table has no files and no rows in the result.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import shutil
import uuid
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gateloom.llm.common import shards, shared_dir

#: About so many distinct keys on a page of the index.
PAGE = 1 << 15


def free(name: str, table: DataFrame) -> str:
    """name, with underscores until no column has it."""
    taken = {c.lower() for c in table.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bucket_of(key: F.Column, buckets: int) -> F.Column:
    """The bucket of a key: crc32 of s and its digits; null ones have buckets + 1."""
    return F.coalesce((F.crc32(F.concat(F.lit("s"), key.cast("bigint").cast("string"))) % buckets).cast("int"), F.lit(buckets + 1))


def first_file(bucket: F.Column) -> F.Column:
    """The starting file of the first table: two of four neighbouring buckets share one."""
    return bucket - (bucket % 4 == 1).cast("int")


def other_file(column: F.Column, buckets: int) -> F.Column:
    """The starting file of the other table: crc32 of a column's digits, null is 0."""
    return F.coalesce((F.crc32(column.cast("string")) % buckets).cast("int"), F.lit(0))


def write_files(rows: DataFrame, number: str, key: str, path: str) -> None:
    """One sorted file for each value of number, in a folder of its own below path."""
    rest = [c for c in rows.columns if c not in (number, key)]
    order = [F.col(number), F.col(f"`{key}`").desc_nulls_first(), *[F.col(f"`{c}`").asc_nulls_first() for c in rest]]
    rows.repartition(shards(rows.sparkSession), number).sortWithinPartitions(*order).write.option("maxRecordsPerFile", 0).partitionBy(number).parquet(path)


def read_files(table: DataFrame, number: str, path: str) -> DataFrame:
    return table.sparkSession.read.schema(T.StructType([*table.schema.fields, T.StructField(number, T.IntegerType())])).parquet(path)


def paged(key: F.Column, pages: int) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(pages)).cast("int")


def key_index(keys: DataFrame, pages: int, path: str) -> DataFrame:
    """bucket, page, ids, counts: the distinct keys (bucket, key; nulls have no entry) of each page, ascending, and how often each occurs. Written to path."""
    entries = keys.filter("key IS NOT NULL").groupBy("bucket", "key").agg(F.count("*").alias("n")).withColumn("page", paged(F.col("key"), pages))
    rows = entries.groupBy("bucket", "page").agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("e"))
    rows.select("bucket", "page", F.col("e.key").alias("ids"), F.col("e.n").alias("counts")).write.parquet(path)
    return keys.sparkSession.read.parquet(path)


def looked_up(counts: DataFrame, index: DataFrame, pages: int, buckets: int) -> DataFrame:
    """bucket, key, file, n, matches: counts (home, key, file, n) with how many rows of the indexed table have the key; without any, the bucket is `buckets`."""
    entries = counts.filter("key IS NOT NULL").withColumn("page", paged(F.col("key"), pages))
    asked = entries.groupBy(F.col("home").alias("bucket"), "page").agg(F.collect_list(F.struct("key", "file", "n")).alias("asked"))

    def probe(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for i in range(b.num_rows):
                home, asked = b.column("bucket")[i].as_py(), b.column("asked")[i].values
                key, file, n = (asked.field(c).to_numpy(zero_copy_only=False) for c in range(3))
                matches = np.zeros(len(key), np.int64)
                if b.column("ids")[i].is_valid and len(b.column("ids")[i].values):
                    ids, count = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "counts"))
                    at = np.minimum(np.searchsorted(ids, key), len(ids) - 1)
                    matches = np.where(ids[at] == key, count[at], 0)
                bucket = np.where(matches > 0, home, buckets)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((bucket, pa.int32()), (key, pa.int64()), (file, pa.int32()), (n, pa.int64()), (matches, pa.int64()))], names=["bucket", "key", "file", "n", "matches"])

    found = asked.join(index, ["bucket", "page"], "left").mapInArrow(probe, "bucket int, key bigint, file int, n bigint, matches bigint")
    nulls = counts.filter("key IS NULL").select(F.lit(buckets + 1).alias("bucket"), "key", "file", "n", F.lit(0).cast("bigint").alias("matches"))
    return found.unionAll(nulls)


class Digest:
    """sha256 of values joined by commas, fed piece by piece."""

    def __init__(self) -> None:
        self.hash, self.held, self.size, self.first = hashlib.sha256(), [], 0, True

    def add(self, text: str, times: int) -> None:
        text = "," + text
        while times:
            m = min(times, 1 << 16)
            self.held.append(text * m)
            self.size, times = self.size + m * len(text), times - m
            if self.size > 1 << 20:
                self.flush()

    def flush(self) -> None:
        data = "".join(self.held)
        self.hash.update((data[1:] if self.first and data else data).encode())
        self.first, self.held, self.size = self.first and not data, [], 0

    def hexdigest(self) -> str:
        self.flush()
        return self.hash.hexdigest()


def key_digests(entries: DataFrame) -> DataFrame:
    """name, bucket, ids_sha256, n_rows: the digest of each final file's keys in falling order, nulls first, from entries (name, bucket, key, n)."""
    ordered = entries.repartition(shards(entries.sparkSession), "name", "bucket").sortWithinPartitions("name", "bucket", F.col("key").desc_nulls_first())

    def run(batches: Iterable[pa.RecordBatch]):
        at, digest, rows = None, Digest(), 0
        done: list[tuple] = []
        for b in batches:
            for name, bucket, key, n in zip(*(b.column(c).to_pylist() for c in ("name", "bucket", "key", "n"))):
                if (name, bucket) != at:
                    if at:
                        done.append((*at, digest.hexdigest(), rows))
                    at, digest, rows = (name, bucket), Digest(), 0
                digest.add("" if key is None else str(key), n)
                rows += n
        if at:
            done.append((*at, digest.hexdigest(), rows))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done) if done else [()] * 4, (pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["name", "bucket", "ids_sha256", "n_rows"])

    return ordered.mapInArrow(run, "name string, bucket int, ids_sha256 string, n_rows bigint")


def plan_of_files(entries: DataFrame) -> DataFrame:
    """name, bucket, lineage_sha256, stays: of each final file, from how many rows of which starting files it comes, and the starting file that is just it (null: none).

    entries: name, bucket, file, n. A starting file is a final one if all its rows go to one bucket and the bucket has no others.
    """
    cells = entries.groupBy("name", "bucket", "file").agg(F.sum("n").alias("n"))
    of_file = cells.groupBy("name", "file").agg(F.count("*").alias("to"))
    joined = cells.join(of_file, ["name", "file"])
    rows = joined.groupBy("name", "bucket").agg(F.array_sort(F.collect_list(F.struct("file", "n", "to"))).alias("e"))
    text = F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["file"].cast("string"), x["n"].cast("string"))), ",")
    alone = (F.size("e") == 1) & (F.get("e", 0)["to"] == 1)
    return rows.select("name", "bucket", F.sha2(text, 256).alias("lineage_sha256"), F.when(alone, F.get("e", 0)["file"]).alias("stays"))


class Files:
    """Files below a path of any Hadoop file system, for numbers of files. A shared folder that is mounted is listed as such, which also shows the checksum files that Spark hides."""

    def __init__(self, spark: SparkSession, path: str):
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.path_of, conf = fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path_of(path).getFileSystem(conf)
        self.mounted = self.fs.getUri().getScheme() == "file"
        self.plain = self.mounted and fs.FileSystem.getDefaultUri(conf).getScheme() == "file"

    def names(self, path: str) -> list[str]:
        if self.mounted:
            top = re.sub("^file:(//)?", "", path)
            return [f"{'' if self.plain else 'file:'}{folder}/{name}" for folder, _, found in os.walk(top) for name in found]
        out, found = [], self.fs.listFiles(self.path_of(path), True) if self.fs.exists(self.path_of(path)) else None
        while found is not None and found.hasNext():
            out.append(found.next().getPath().toString())
        return out

    def below(self, path: str) -> list[tuple[str, int | None, bool]]:
        """path, the number in its folder's name (null: none), whether it is a data file."""
        out = []
        for text in self.names(path):
            folder, name = text.rsplit("/", 2)[1:]
            number = folder.rpartition("=")[2]
            out.append((text, int(number) if "=" in folder and number.isdigit() else None, name.endswith(".parquet") and name[0] not in "._"))
        return out

    def remove(self, path: str) -> None:
        """A file, or a folder with all in it."""
        if not self.mounted:
            self.fs.delete(self.path_of(path), True)
        elif os.path.isdir(path := re.sub("^file:(//)?", "", path)):
            shutil.rmtree(path)
        else:
            os.remove(path)


def co_bucketed(first: DataFrame, other: DataFrame, key: str = "sale_id", spread: str = "item_id", names: tuple[str, str] = ("sales", "sale_lines"), buckets: int = 600, page: int = PAGE) -> DataFrame:
    """table_name, path, columns, bucket, n_rows, n_joined, ids_sha256, lineage_sha256, rewritten: a row for each final file of both tables.

    The files lie in a new folder of the shared one, each table in a folder of its name; the index beside it.
    """
    spark = first.sparkSession
    top = f"{shared_dir(spark)}/gateloom-pair-{uuid.uuid4().hex}"
    tables = {names[0]: first, names[1]: other}
    number = {n: free("file", t) for n, t in tables.items()}
    start = {n: f"{top}/tables/{n}/starting" for n in names}
    k = F.col(f"`{key}`")
    write_files(first.withColumn(number[names[0]], first_file(bucket_of(k, buckets))), number[names[0]], key, start[names[0]])
    write_files(other.withColumn(number[names[1]], other_file(F.col(f"`{spread}`"), buckets)), number[names[1]], key, start[names[1]])
    read = {n: read_files(t, number[n], start[n]) for n, t in tables.items()}

    pages = max(1, math.ceil(max(t.count() for t in read.values()) / buckets / page))
    keys = {n: t.select(k.cast("bigint").alias("key"), F.col(number[n]).alias("file"), bucket_of(k, buckets).alias("home")) for n, t in read.items()}
    index = key_index(keys[names[0]].select(F.col("home").alias("bucket"), "key"), pages, f"{top}/index")
    counts = keys[names[1]].groupBy("home", "key", "file").agg(F.count("*").alias("n"))
    looked_up(counts, index, pages, buckets).write.parquet(f"{top}/lookup")
    found = spark.read.schema("bucket int, key bigint, file int, n bigint, matches bigint").parquet(f"{top}/lookup")

    own = keys[names[0]].groupBy(F.col("home").alias("bucket"), "key", "file").agg(F.count("*").alias("n"))
    entries = own.select(F.lit(names[0]).alias("name"), "bucket", "key", "file", "n").unionAll(found.select(F.lit(names[1]).alias("name"), "bucket", "key", "file", "n"))
    joined = found.groupBy("bucket").agg(F.sum(F.col("n") * F.col("matches")).alias("n_joined"))
    plan = plan_of_files(entries).join(key_digests(entries), ["name", "bucket"]).join(joined, "bucket", "left").fillna(0, "n_joined")
    plan.write.parquet(f"{top}/plan")  # a row for each final file
    plan = spark.read.schema(plan.schema).parquet(f"{top}/plan")

    stays = {n: {r["stays"]: r["bucket"] for r in plan.filter((F.col("name") == n) & F.col("stays").isNotNull()).select("stays", "bucket").collect()} for n in names}
    final = {n: f"{top}/tables/{n}/bucketed" for n in names}
    for n in names:
        moved = read[n].filter(~F.col(number[n]).isin(list(stays[n])))
        bucket = bucket_of(k, buckets)
        if n == names[1]:
            lost, mark, flag = found.filter((F.col("matches") == 0) & F.col("key").isNotNull()).select("key").distinct(), free("orphan_key", other), free("is_orphan", other)
            lost = lost.select(F.col("key").alias(mark), F.lit(True).alias(flag))
            moved = moved.join(lost, k.cast("bigint") == F.col(mark), "left")
            bucket = F.when(F.col(flag), F.lit(buckets)).otherwise(bucket)
        name = free("bucket", tables[n])
        write_files(moved.select(*[F.col(f"`{c}`") for c in tables[n].columns], bucket.alias(name)), name, key, final[n])

    paths, files = [], Files(spark, top)
    for n in names:
        gone = set()
        for path, at, data in files.below(start[n]):
            if data and at in stays[n]:
                paths.append((n, stays[n][at], path, False))
            else:
                gone.add(path if at is None or at in stays[n] else path.rpartition("/")[0])
        for path, at, data in files.below(final[n]):
            if data:
                paths.append((n, at, path, True))
            else:
                gone.add(path)
        for path in gone:
            files.remove(path)
    where = spark.createDataFrame(paths, "name string, bucket int, path string, rewritten boolean")
    columns = reduce(lambda a, n: a.when(F.col("name") == n, F.lit(",".join(tables[n].columns))), names, F)
    return plan.join(F.broadcast(where), ["name", "bucket"]).select(F.col("name").alias("table_name"), "path", columns.alias("columns"), F.col("bucket").cast("bigint"), "n_rows", "n_joined", "ids_sha256", "lineage_sha256", "rewritten")
