"""Token ids in directly addressable codes: any token of a file is read without decoding what lies before it.

Format: a Parquet data set of segments and a manifest. A segment holds whole documents in ascending doc_id order; each id
is split into 8-bit chunks, one level for each. Level k holds the k-th chunk of the ids that reach it; a bitmap beside it
says which of them go on to level k + 1, and a rank directory holds the number of set bits before each block of 512 bits.
Reading token i takes one byte and one rank per level (Brisaboa, Ladra, Navarro: "Directly Addressable Codes").

Pages aren't compressed, so the bytes of a level lie in the file as they are. Row groups are small and carry the range of
their segments, by which a reader skips those that hold none of the positions it looks for.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.common import as_text, mapped, rows_of, work_dir
from tablewright.llm.tokenizing import encoder

RANK_BITS = 512
#: A segment is closed once it has this many tokens; a longer document is a segment of its own.
SEGMENT_TOKENS = 1 << 16
#: Bytes of a row group: some segments.
GROUP_BYTES = 1 << 20
#: Positions of one segment that one task looks up.
LOOKUPS = 100_000
SEGMENT_DDL = "shard int,segment int,start bigint,n_tokens bigint,first_id bigint,last_id bigint,doc_ids array<bigint>,doc_tokens array<bigint>,levels array<binary>,bitmaps array<binary>,ranks array<binary>"


def dac_encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, bitmaps and rank directories of unsigned 32-bit ids."""
    levels, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint32, copy=False)
    while True:
        levels.append((rest & 0xFF).astype(np.uint8).tobytes())
        rest = rest >> np.uint32(8)
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        bitmaps.append(bits.tobytes())
        ranks.append(np.concatenate(([0], np.cumsum(blocks)[:-1])).astype(np.uint32).tobytes() if len(more) else b"")
        if not more.any():
            return levels, bitmaps, ranks
        rest = rest[more]


def dac_decode(levels: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a segment."""
    out = np.frombuffer(levels[0], np.uint8).astype(np.uint32)
    at = np.arange(len(out))
    for k in range(1, len(levels)):
        going = np.unpackbits(np.frombuffer(bitmaps[k - 1], np.uint8), count=len(at), bitorder="little").astype(bool)
        at = at[going]
        out[at] |= np.frombuffer(levels[k], np.uint8).astype(np.uint32) << np.uint32(8 * k)
    return out


def dac_get(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], at: int) -> int:
    """The id at position ``at``, from one byte and one rank block per level."""
    out = 0
    for k, level in enumerate(levels):
        out |= level[at] << (8 * k)
        if not bitmaps[k][at >> 3] >> (at & 7) & 1:
            break
        block = at // RANK_BITS
        before = np.frombuffer(bitmaps[k], np.uint8, count=(at >> 3) - block * RANK_BITS // 8, offset=block * RANK_BITS // 8)
        at = int(np.frombuffer(ranks[k], np.uint32, count=1, offset=4 * block)[0]) + int(np.bitwise_count(before).sum()) + (bitmaps[k][at >> 3] & ((1 << (at & 7)) - 1)).bit_count()
    return out


def _segments(rows, vocabulary: str, end_id: int, spaces: bool):
    encode, end = encoder(vocabulary, spaces).encode, np.array([end_id], np.uint32).tobytes()
    shard, segment, start, load = TaskContext.get().partitionId(), 0, 0, 0
    doc_ids, counts, parts = [], [], []

    def close():
        ids = np.frombuffer(b"".join(parts), np.uint32)
        known = [x for x in doc_ids if x is not None]
        return (shard, segment, start, len(ids), min(known, default=None), max(known, default=None), doc_ids, counts, *dac_encode(ids))

    for doc_id, text in rows:
        ids = encode(text) + end
        n = len(ids) // 4
        if counts and load + n > SEGMENT_TOKENS:
            yield close()
            segment, start, load = segment + 1, start + load, 0
            doc_ids, counts, parts = [], [], []
        load += n
        doc_ids.append(doc_id)
        counts.append(n)
        parts.append(ids)
    if counts:
        yield close()


def write_tokens(documents: DataFrame, path: str, vocabulary: str, end_id: int, spaces: bool = False, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of every whole text, each document followed by ``end_id``, in ascending doc_id order below ``path``.

    Null texts are empty; null doc_ids come first; equal doc_ids are ordered by a hash of the text, then the text; columns other
    than the two named ones are not read; an empty table gives an empty file set. Documents are range-partitioned once, by doc_id and a hash of
    the text, so many rows of one doc_id, or none, still lie in several shards; a task holds one segment. The manifest has a
    row for each shard: the tokens before it.
    """
    spark = documents.sparkSession
    kind = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), *((n, pa.int64()) for n in ("start", "n_tokens", "first_id", "last_id")), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), *((n, pa.list_(pa.binary())) for n in ("levels", "bitmaps", "ranks"))])

    def run(batches):
        for row in _segments(rows_of(batches, "d", "t"), vocabulary, end_id, spaces):
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, row, strict=True))], schema=kind)

    docs = documents.select(documents[doc_id].cast("long").alias("d"), as_text(documents, text).alias("t"))
    keyed = docs.withColumn("h", F.xxhash64("t"))
    ordered = keyed.repartitionByRange("d", "h").sortWithinPartitions("d", "h", "t").select("d", "t")
    mapped(ordered, run, SEGMENT_DDL).write.option("compression", "none").option("parquet.block.size", GROUP_BYTES).option("parquet.enable.dictionary", "false").parquet(f"{path}/segments")
    totals = spark.read.schema(SEGMENT_DDL).parquet(f"{path}/segments").groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"))
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals.select("shard", before.alias("base"), "n_tokens").write.parquet(f"{path}/manifest")


def _segments_with_start(spark: SparkSession, path: str) -> DataFrame:
    """The segments with the global place of their first token. The manifest joins as its size has it."""
    manifest = spark.read.schema("shard int, base long, n_tokens long").parquet(f"{path}/manifest").select("shard", "base")
    return spark.read.schema(SEGMENT_DDL).parquet(f"{path}/segments").join(manifest, "shard").withColumn("start", F.col("base") + F.col("start"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids: little-endian unsigned 32-bit, first_id) for every document, decoded from the files.

    ``first_id`` is the document's first token, read by random access; that it isn't the decoded one is an error.
    """
    names = ("start", "doc_ids", "doc_tokens", "levels", "bitmaps", "ranks")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                start, doc_ids, counts, levels, bitmaps, ranks = (batch.column(n)[k].as_py() for n in names)
                ids = dac_decode(levels, bitmaps)
                ends = [0, *accumulate(counts)]
                first = [dac_get(levels, bitmaps, ranks, at) for at in ends[:-1]]
                if first != ids[ends[:-1]].tolist():
                    raise ValueError("random access and decoding disagree")
                for at in range(0, len(doc_ids), 2000):
                    to = min(at + 2000, len(doc_ids))
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids[at:to], pa.int64()), "start": pa.array([start + x for x in ends[at:to]], pa.int64()), "n_tokens": pa.array(counts[at:to], pa.int64()), "ids": pa.array([ids[ends[x] : ends[x + 1]].tobytes() for x in range(at, to)], pa.binary()), "first_id": pa.array(first[at:to], pa.int64())})

    return mapped(_segments_with_start(spark, path).select(*names), run, "doc_id bigint,start bigint,n_tokens bigint,ids binary,first_id bigint")


def tokens_at(positions: DataFrame, path: str) -> DataFrame:
    """(position, id) for the global positions in ``positions`` (column position), by random access within their segments.

    Positions find their segments by an equi-join on stretches of ``SEGMENT_TOKENS``, then meet them in a task: a segment
    first, then its positions one after another, so neither is gathered. Many positions of one segment are dealt over several
    tasks, each with the segment. Null positions, and those that no document covers, give no row; repeated ones a row each.
    """
    segments = _segments_with_start(positions.sparkSession, path).where("n_tokens > 0")
    spans = segments.select("shard", "segment", "start", "n_tokens")
    stretch = lambda c: F.floor(c / SEGMENT_TOKENS)
    spread = spans.withColumn("stretch", F.explode(F.sequence(stretch(F.col("start")), stretch(F.col("start") + F.col("n_tokens") - 1))))
    wanted = positions.select(F.col("position").cast("long").alias("position")).where("position >= 0").withColumn("stretch", stretch(F.col("position")))
    found = wanted.join(spread, "stretch").where("position >= start AND position < start + n_tokens").select("shard", "segment", "position", (F.col("position") - F.col("start")).alias("at"))
    parts = found.groupBy("shard", "segment").agg(F.ceil(F.count("*") / LOOKUPS).cast("int").alias("parts"))
    empty = F.array().cast("array<binary>")
    held = segments.join(parts, ["shard", "segment"]).select("shard", "segment", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("position"), F.lit(None).cast("long").alias("at"), "levels", "bitmaps", "ranks")
    asked = found.join(parts, ["shard", "segment"]).select("shard", "segment", F.pmod(F.xxhash64("position"), "parts").cast("int").alias("part"), "position", "at", empty.alias("levels"), empty.alias("bitmaps"), empty.alias("ranks"))
    key = ["shard", "segment", "part"]
    met = held.unionByName(asked).repartition(*key).sortWithinPartitions(*key, F.asc_nulls_first("position"))

    def run(batches):
        code = None
        for batch in batches:
            out, ids = [], []
            for position, at, row in zip(batch.column("position").to_pylist(), batch.column("at").to_pylist(), range(batch.num_rows), strict=True):
                if position is None:
                    code = [batch.column(n)[row].as_py() for n in ("levels", "bitmaps", "ranks")]
                else:
                    out.append(position)
                    ids.append(dac_get(*code, at))
            yield pa.RecordBatch.from_pydict({"position": pa.array(out, pa.int64()), "id": pa.array(ids, pa.int64())})

    return mapped(met.select(*key, "position", "at", "levels", "bitmaps", "ranks"), run, "position bigint,id bigint")


def token_digests(documents: DataFrame, vocabulary: str, end_id: int, spaces: bool = False) -> DataFrame:
    """Writes ``documents`` and returns (doc_id, start, n_tokens, ids_crc32, first_id) as the files hold them."""
    path = work_dir(documents.sparkSession, "tokens")
    write_tokens(documents, path, vocabulary, end_id, spaces)
    return read_tokens(documents.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "first_id")


__all__ = ["dac_decode", "dac_encode", "dac_get", "read_tokens", "token_digests", "tokens_at", "write_tokens"]
