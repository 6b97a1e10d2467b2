"""Power-of-two packing: each document is cut into pieces of binary length, and equal lengths share a bucket.

A document of n ids becomes n // most pieces of ``most`` ids and one for each set bit of n % most, longest first (Pouransari
et al., "Dataset Decomposition"). A piece is a sequence by itself, so no sequence crosses documents and none is padded.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import as_text, mapped, rows_of, work_dir
from tablewright.llm.tokenizing import encoder

MOST = 1024


def binary_lengths(n: int, most: int = MOST) -> list[int]:
    """The lengths of a document's pieces in order; ``most`` is a power of two."""
    return [most] * (n // most) + [1 << k for k in reversed(range(most.bit_length() - 1)) if n % most >> k & 1]


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("task", pa.int32()), ("place", pa.int64())])
PIECES_DDL = "doc_id bigint,start bigint,length int,doc_tokens bigint,ids_crc32 bigint,ids binary,task int,place bigint"


def pack(documents: DataFrame, vocabulary: str, end_id: int, spaces: bool = True, most: int = MOST, path: str | None = None) -> DataFrame:
    """Writes the sequences of ``documents`` (doc_id, text) below ``path``, a folder for each length, and returns them.

    Columns: doc_id, start (in the document), length, doc_tokens, ids_crc32, ids (little-endian unsigned 16-bit, or 32-bit
    for larger vocabularies), sequence_id, offset. Null texts are empty and give the end id alone; null and repeated doc_ids
    are kept, a row each; other columns aren't read; an empty table gives no sequences. Sequences are numbered by length, then
    scan task, then place in the task's output, so reruns over the same files agree. Tasks count their own sequences of each
    length; a running sum over those counts, one key for each length, gives where each task's numbers begin. Texts are never
    shuffled, nothing goes through the driver, and a task holds one batch.
    """
    spark = documents.sparkSession
    path = path or work_dir(spark, "packed")

    def run(batches):
        encode, end = encoder(vocabulary, spaces).encode, np.array([end_id], np.uint32).tobytes()
        held, load, task, places = [[] for _ in PIECES], 0, TaskContext.get().partitionId(), Counter()
        for doc_id, text in rows_of(batches, "d", "t"):
            raw = encode(text) + end
            ids = np.frombuffer(raw, np.uint32)
            small = ids.astype(np.uint16).tobytes() if ids.max() < 1 << 16 else raw
            wide, start = len(small) // len(ids), 0
            for length in binary_lengths(len(ids), most):
                for column, value in zip(held, (doc_id, start, length, len(ids), zlib.crc32(raw[4 * start : 4 * (start + length)]), small[wide * start : wide * (start + length)], task, places[length]), strict=True):
                    column.append(value)
                places[length] += 1
                start += length
            load += len(small)
            if load > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(held, PIECES.types, strict=True)], schema=PIECES)
                held, load = [[] for _ in PIECES], 0
        if load:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(held, PIECES.types, strict=True)], schema=PIECES)

    docs = documents.select(documents["doc_id"].cast("long").alias("d"), as_text(documents, "text").alias("t"))
    pieces = mapped(docs, run, PIECES_DDL)
    pieces.withColumn("bucket", F.lpad(F.col("length").cast("string"), 10, "0")).write.option("compression", "zstd").partitionBy("bucket").parquet(path)
    stored = spark.read.schema(f"{PIECES_DDL},bucket string").parquet(path)
    per_task = stored.groupBy("length", "task").agg(F.count("*").alias("n"))
    per_length = per_task.groupBy("length").agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = per_task.withColumn("earlier", earlier).join(per_length.select("length", "before"), "length").select("length", "task", (F.col("before") + F.col("earlier")).alias("base"))
    return stored.join(bases, ["length", "task"]).select("doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens", "ids_crc32", "ids", (F.col("base") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def ids_of(packed: bytes, length: int) -> np.ndarray:
    """A sequence's ids."""
    return np.frombuffer(packed, np.uint16 if len(packed) == 2 * length else np.uint32).astype(np.uint32)
