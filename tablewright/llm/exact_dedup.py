"""Exact duplicates through an extendible-hash index whose log, directory and bucket entries are shared files.

1. Log: each scan task groups its own rows by content, comparing bytes within a hash chain, and writes a member row for
   every document and one representative row (the best local row) for each distinct text. A text that a third of all rows
   share is so sent on once per task, not once per row.
2. Directory: representatives are counted by hash prefix; buckets over capacity are split bit by bit, the directory
   doubling whenever a bucket's local depth passes the global depth. Entries: representatives / capacity, a few bytes each.
3. Owners: a task owns a contiguous range of directory slots, so of keys; it reads its representatives in key order, chains
   those of equal hash and compares their bytes. What it decides is the index: one entry for each representative.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import BLANKS, arrow_schema, batches_of, mapped, rows_of, work_dir, written

#: Representatives in a bucket before it is split.
CAPACITY = 4096
#: Buckets of one owner task, and hash bits that the directory can use (more representatives make buckets larger).
BUCKETS = 16
MOST_BITS = 24
#: Slots of a directory up to which it is broadcast (some 20 MB); a larger one is joined.
BROADCAST_SLOTS = 1 << 20
#: Bytes of distinct text that a scan task holds before it writes its representatives and starts anew.
HELD_BYTES = 32_000_000
DROP = str.maketrans("", "", BLANKS)


def normalised(text: str | None) -> bytes:
    """What is compared: the text without white space, in UTF-8; null is empty."""
    return (text or "").translate(DROP).encode()


@dataclass
class Local:
    """A distinct text within a task: its bytes, representative id, best row so far and number of rows."""

    text: bytes
    rep_id: int
    rank: tuple
    at: int
    rows: int = 1


def _log(batches, members: bool):
    """Rows of the log: kind 'member' (doc_id, rep_id, row_id, sha) or 'rep' (rep_id, key, rank, rows, row)."""
    task = TaskContext.get().partitionId()
    held: dict[bytes, list[Local]] = {}
    kept: list[pa.Array] = []
    n_rows = n_reps = n_kept = load = 0

    def flush():
        nonlocal held, kept, n_kept, load
        entries = [(key, x) for key, chain in held.items() for x in chain]
        if entries:
            rows = pa.concat_arrays(kept).take(pa.array([x.at for _, x in entries], pa.int64()))
            n = len(entries)
            longs = lambda values: pa.array(values, pa.int64())
            yield {"kind": pa.array(["rep"] * n), "doc_id": longs([None if x.rank[1] else x.rank[2] for _, x in entries]), "rep_id": longs([x.rep_id for _, x in entries]), "row_id": longs([x.rank[3] for _, x in entries]), "sha": pa.nulls(n, pa.string()), "key": longs([int.from_bytes(key, "big", signed=True) for key, _ in entries]), "points": longs([-x.rank[0] for _, x in entries]), "rows": longs([x.rows for _, x in entries]), "row": rows}
        held, kept, n_kept, load = {}, [], 0, 0

    for batch in batches:
        better, seen = [], {k: [] for k in ("doc_id", "rep_id", "row_id", "sha")}
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            for k, (doc_id, text) in enumerate(zip(part.column("d").to_pylist(), part.column("t").to_pylist(), strict=True)):
                content = normalised(text)
                digest = hashlib.sha256(content)
                key = digest.digest()[:8]
                rank = (-len(text or ""), doc_id is None, doc_id or 0, task << 36 | n_rows)
                chain = held.setdefault(key, [])
                for x in chain:
                    if x.text == content:
                        x.rows += 1
                        if rank < x.rank:
                            x.rank, x.at = rank, n_kept + len(better)
                            better.append(at + k)
                            load += len(content)
                        break
                else:
                    x = Local(content, task << 36 | n_reps, rank, n_kept + len(better))
                    chain.append(x)
                    better.append(at + k)
                    load += 2 * len(content)
                    n_reps += 1
                n_rows += 1
                if members:
                    for column, value in zip(seen.values(), (doc_id, x.rep_id, rank[3], digest.hexdigest()), strict=True):
                        column.append(value)
        kept.append(batch.column("row").take(pa.array(better, pa.int64())))
        n_kept += len(better)
        if members and batch.num_rows:
            n, column = batch.num_rows, batch.schema.field("row")
            yield {"kind": pa.array(["member"] * n), **{k: pa.array(v, pa.string() if k == "sha" else pa.int64()) for k, v in seen.items()}, **{k: pa.nulls(n, pa.int64()) for k in ("key", "points", "rows")}, "row": pa.nulls(n, column.type)}
        if load >= HELD_BYTES:
            yield from flush()
    yield from flush()


def directory(counts: np.ndarray, capacity: int) -> tuple[int, np.ndarray]:
    """(global depth, bucket of each slot) from rows per hash prefix, all 2**bits of them; buckets are numbered in key order.

    One bucket to begin with; the first overfull bucket is split by its next bit until none is left or all bits are used
    (rows of one hash can't be split: they stay a chain). A split past the global depth doubles the directory.
    """
    bits = len(counts).bit_length() - 1
    sums = np.concatenate(([0], np.cumsum(counts)))
    done, todo, depth = [], [(0, 0)], 0
    while todo:
        prefix, local = todo.pop()
        low, high = prefix << (bits - local), (prefix + 1) << (bits - local)
        if sums[high] - sums[low] > capacity and local < bits:
            depth = max(depth, local + 1)
            todo += [(2 * prefix + 1, local + 1), (2 * prefix, local + 1)]
        else:
            done.append(local)
    return depth, np.repeat(np.arange(len(done)), [1 << (depth - local) for local in done])


def _owner(batches):
    """Index entries of one owner's representatives, which come in key order."""
    key, chains = None, []

    def close():
        for _, reps in chains:
            rank = min(r[1] for r in reps)
            size = sum(r[2] for r in reps)
            for rep_id, _, _ in reps:
                yield rep_id, None if rank[1] else rank[2], rank[3], size

    for rep_id, now, points, doc_id, row_id, rows, row in rows_of(batches, "rep_id", "key", "points", "doc_id", "row_id", "rows", "t"):
        if now != key:
            yield from close()
            key, chains = now, []
        content = normalised(row)
        rep = (rep_id, (-points, doc_id is None, doc_id or 0, row_id), rows)
        for known, reps in chains:
            if known == content:
                reps.append(rep)
                break
        else:
            chains.append((content, [rep]))
    yield from close()


def _winners(batches):
    """The best row (column row) of each distinct text of one owner's representatives, which come in key order."""
    key, chains = None, []  # of each text: its bytes, the best rank, and the best row as (rows, place)
    for batch in batches:
        rows, done = batch.column("row"), []
        for at, (now, points, doc_id, row_id, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "points", "doc_id", "row_id", "t")), strict=True)):
            if now != key:
                done += [c[2] for c in chains]
                key, chains = now, []
            content, rank = normalised(text), (-points, doc_id is None, doc_id or 0, row_id)
            for c in chains:
                if c[0] == content:
                    if rank < c[1]:
                        c[1:] = rank, (rows, at)
                    break
            else:
                chains.append([content, rank, (rows, at)])
        parts = [r for r, _ in done if r is not rows]
        here = [at for r, at in done if r is rows]
        if done:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([*parts, rows.take(pa.array(here, pa.int64()))])], names=["row"])
        for c in chains:  # don't hold on to the whole batch
            if c[2][0] is rows:
                c[2] = (rows.take(pa.array([c[2][1]])), 0)
    if chains:
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([r.take(pa.array([at])) for *_, (r, at) in chains])], names=["row"])


def _dealt(df: DataFrame, doc_id: str, text: str, members: bool, capacity: int) -> tuple[DataFrame, DataFrame]:
    """The log of ``df``, and its representatives dealt to their owners in key order."""
    spark = df.sparkSession
    columns = T.StructType([T.StructField(k, t) for k, t in (("kind", T.StringType()), ("doc_id", T.LongType()), ("rep_id", T.LongType()), ("row_id", T.LongType()), ("sha", T.StringType()), ("key", T.LongType()), ("points", T.LongType()), ("rows", T.LongType()))])
    source = df.select(df[doc_id].cast("long").alias("d"), df[text].cast("string").alias("t"), F.struct("*").alias("row"))
    schema = T.StructType([*columns.fields, T.StructField("row", source.schema["row"].dataType, True)])

    def run(batches):
        for made in _log(batches, members):
            yield pa.RecordBatch.from_pydict(made)

    log = written(mapped(source, run, schema), "dedup-log", partition_by=["kind"])
    reps = log.where("kind = 'rep'")
    n = reps.count()
    bits = max(1, min(MOST_BITS, int(np.ceil(np.log2(max(n, 1) / capacity + 1))) + 4))
    counted = reps.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("p")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(1 << bits, np.int64)
    counts[counted.column("p").to_numpy()] = counted.column("n").to_numpy()
    depth, slots = directory(counts, capacity)
    path = work_dir(spark, "dedup-directory")
    spark.createDataFrame(pa.table({"slot": np.arange(len(slots)), "bucket": slots.astype(np.int32)}), "slot long, bucket int").write.parquet(path)
    slot = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
    buckets = int(slots[-1]) + 1
    owners = max(math.ceil(buckets / BUCKETS), min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    table = spark.read.schema("slot long, bucket int").parquet(path)
    table = F.broadcast(table) if len(slots) <= BROADCAST_SLOTS else table
    placed = reps.select("rep_id", "key", "points", "doc_id", "row_id", "rows", "row", slot.alias("slot")).join(table, "slot")
    owned = placed.withColumn("owner", F.floor(F.col("bucket") * owners / buckets).cast("int")).repartitionById(owners, "owner").sortWithinPartitions("bucket", "key")
    return log, owned.select("rep_id", "key", "points", "doc_id", "row_id", "rows", F.col("row")[text].alias("t"), "row")


def duplicate_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; null is empty. The row with the most code points stays, then the
    smallest doc_id (null last); of rows that tie in both, one stays. Other columns aren't read; an empty table gives no rows.
    """
    log, owned = _dealt(df.select(df[doc_id].alias("d_"), df[text].alias("t_")), "d_", "t_", True, capacity)
    ddl = "rep_id bigint,keep_id bigint,keep_row bigint,group_size bigint"

    def own(batches):
        yield from batches_of(_owner(batches), arrow_schema(ddl))

    index = written(mapped(owned.drop("row"), own, ddl), "dedup-index")
    members = log.where("kind = 'member'").select("doc_id", "rep_id", "row_id", "sha")
    return members.join(index, "rep_id").select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def unique_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``df``, all columns, that stay; ties, nulls and empty tables as in ``duplicate_groups``."""
    _, owned = _dealt(df, doc_id, text, False, capacity)
    return mapped(owned.select("key", "points", "doc_id", "row_id", "t", "row"), _winners, f"row {owned.schema['row'].dataType.simpleString()}").select("row.*")
