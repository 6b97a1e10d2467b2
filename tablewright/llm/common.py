"""What several operators share: work folders, written tables, per-worker caches and link components."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import shared_folder

#: The white space the contracts name: \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"

BATCH_ROWS, BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


_collecting: list[list[str]] = []


@contextlib.contextmanager
def collecting() -> Iterator[list[str]]:
    """The folders that operators make meanwhile."""
    _collecting.append(paths := [])
    try:
        yield paths
    finally:
        _collecting.remove(paths)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run below ``spark.checkpoint.dir``, which a cluster must set."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _collecting:
        paths.append(path)
    return path


def written(df: DataFrame, name: str, compression: str = "zstd", partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts the lineage and survives lost executors."""
    path = work_dir(df.sparkSession, name)
    writer = df.write.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder that an operator made."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(df: DataFrame) -> None:
    """Deletes what ``written`` has made, once nothing reads it any more."""
    delete(df.sparkSession, df.written_at)


def worker_cache(user: str) -> dict:
    """A dict that lives as long as the Python worker, over all its tasks, until another operator asks for one."""
    holder = sys.modules.setdefault("_tablewright_worker_cache", types.ModuleType("_tablewright_worker_cache"))
    if holder.__dict__.get("user") != user:
        holder.__dict__.update(user=user, entries={})
    return holder.__dict__["entries"]


def mapped(df: DataFrame, make, schema) -> DataFrame:
    """``df.mapInArrow`` with batches bounded in rows and bytes, each task giving back what earlier ones have left unused."""
    spark = df.sparkSession
    if int(spark.conf.get(BATCH_ROWS)) > 2000:
        spark.conf.set(BATCH_ROWS, "2000")
    if spark.conf.get(BATCH_BYTES) == "67108864b":  # Spark's own default
        spark.conf.set(BATCH_BYTES, "16777216b")

    def run(batches):
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)
        yield from make(batches)

    return df.mapInArrow(run, schema)


def as_text(df: DataFrame, name: str) -> Column:
    """Column ``name`` with null read as the empty text."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, a slice of the batch at a time, so long texts aren't all turned into objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield from zip(*(part.column(name).to_pylist() for name in names), strict=True)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, weight=None, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Tuples gathered into Arrow batches of at most ``size`` rows, or about ``most`` of what ``weight(row)`` sums to."""
    held, load = [], 0
    for row in rows:
        held.append(row)
        load += weight(row) if weight else 0
        if len(held) >= size or load >= most:
            yield to_batch(held, schema)
            held, load = [], 0
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a plain DDL list of bigint, int, double, boolean, string and binary columns."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(","))])


def map_rows(df: DataFrame, make, columns: list[str], ddl: str, size: int = 2000, weight=None) -> DataFrame:
    """``make(iterator of tuples of columns)`` as mapInArrow; it yields tuples for ``ddl``."""

    def run(batches):
        yield from batches_of(make(rows_of(batches, *columns)), arrow_schema(ddl), size, weight)

    return mapped(df.select(*columns), run, ddl)


def local_forest(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Replaces the edges that one task has read by at most nodes - 1 that connect the same nodes, a bounded run at a time."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in rows:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
        if len(parent) >= 1_000_000:
            yield from ((n, find(n)) for n in list(parent) if find(n) != n)
            parent.clear()
    yield from ((n, find(n)) for n in list(parent) if find(n) != n)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b: long), root being the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond"),
    each a partial aggregation and an equi-join, until no edge changes. Every step is written in the shared folder.
    """
    edges = written(map_rows(edges, local_forest, ["a", "b"], "a bigint,b bigint").distinct(), name)
    mark = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # Written, so that the join below deals out both sides anew and Spark can split the edges of a hub.
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = both.join(least.hint("merge"), "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(down.select(F.col("u").alias("a"), F.col("m").alias("b")))
        old, edges = edges, written(small.distinct(), name)
        discard(old)
        discard(least)
        now = tuple(edges.agg(F.count("*"), F.sum(F.col("a") % 1_000_003), F.sum(F.col("b") % 1_000_003), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = now


def generator(*key: int) -> np.random.Generator:
    """A random generator that depends on ``key`` only, on any machine and in any task attempt."""
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([k & 0xFFFFFFFFFFFFFFFF for k in key])))
