"""A uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows lie in hashed partitions. The matrix says how many rows each partition sends to each target block; given the sizes of
both sides its law is multivariate hypergeometric, as for a uniform random permutation (Sanders, "Random permutations on
distributed, external and hierarchical memory"). Each task derives its own row of the matrix by halving the set of
partitions, with a generator that depends on the seed and the halves only, so no task and no driver holds the matrix.
A task permutes its rows, sends them as its row says, and the receiving task permutes its block. A shard is a run of blocks.

Partitions and blocks hold ``PART_ROWS`` rows each, so a task's share doesn't grow with the input, up to ``MOST_PARTS`` of each;
beyond that they grow, as a matrix of more rows and columns would cost more than its rows do. Tasks sort and pass rows on in
batches, so their memory is bounded either way.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import generator, mapped

#: Populations below which numpy draws hypergeometric variates.
NUMPY_MOST = 900_000_000
#: Rows of a hashed partition and of a target block, on average, and how many of each there are at most.
PART_ROWS = 16_384
MOST_PARTS = 16_384


def _large_hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """A hypergeometric variate for populations beyond numpy's limit, by rejection from a ratio-of-uniforms hat (Stadlober's HRUA)."""
    less, more = min(good, bad), max(good, bad)
    whole = good + bad
    m = min(sample, whole - sample)
    mean, variance = m * less / whole, (whole - m) * m / (whole - 1) * less / whole * (more / whole)
    wide = math.sqrt(variance + 0.5)
    h = 2 * math.sqrt(2 / math.e) * wide + (3 - 2 * math.sqrt(3 / math.e))
    mode = (m + 1) * (less + 1) // (whole + 2)

    def log_weight(k: int) -> float:
        return math.lgamma(k + 1) + math.lgamma(less - k + 1) + math.lgamma(m - k + 1) + math.lgamma(more - m + k + 1)

    top = log_weight(mode)
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + h * (v - 0.5) / u)
        if max(0, m - more) <= k <= min(m, less) and 2 * math.log(u) <= top - log_weight(k):
            break
    if good > bad:
        k = m - k
    return k if m == sample else good - k


def split_counts(rng: np.random.Generator, columns: np.ndarray, sample: int) -> np.ndarray:
    """How many of ``sample`` rows drawn without replacement go to each column of the given sizes."""
    if int(columns.sum()) < NUMPY_MOST:
        return rng.multivariate_hypergeometric(columns, sample, method="marginals")
    out, rest = np.zeros_like(columns), int(columns.sum())
    for k, n in enumerate(columns.tolist()):
        rest -= n
        if sample and n:
            drawn = n if not rest and sample >= n else int(rng.hypergeometric(n, rest, sample)) if n + rest < NUMPY_MOST else _large_hypergeometric(rng, n, rest, sample)
            out[k], sample = drawn, sample - drawn
    return out


def matrix_row(sizes: np.ndarray, blocks: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row ``part`` of the communication matrix with row sums ``sizes`` and column sums ``blocks``."""
    low, high, columns = 0, len(sizes), blocks
    while high - low > 1:
        middle = (low + high) // 2
        left = split_counts(generator(seed, low, high), columns, int(sizes[low:middle].sum()))
        if part < middle:
            columns, high = left, middle
        else:
            columns, low = columns - left, middle
    return columns


def even_sizes(n: int, k: int) -> np.ndarray:
    """``n`` in ``k`` parts that differ by one at most."""
    return np.array([n // k + (j < n % k) for j in range(k)], np.int64)


def _start(n: Column, k: int, j: Column) -> Column:
    """The rows before part j of ``even_sizes(n, k)``."""
    return j * F.floor(n / k) + F.least(j, n % k)


def uniform_shards(df: DataFrame, identity: list[str], shards: int = 8, seed: int = 20) -> DataFrame:
    """``df``, all columns, with shard (0 to shards - 1; counts at most one apart) and slot (gapless from 0 in each shard).

    Every assignment of rows to slots has the same chance. ``identity`` names the columns that tell rows apart: rows equal
    in all of them may take one another's slots, and reruns agree but for those. Null values count as a value of their own;
    an empty table gives no rows; columns of ``df`` called shard or slot are replaced. Blocks are even in rows whatever the
    rows hold; partitions are but for rows equal in ``identity``, which lie in one: name columns that tell rows apart.
    """
    df = df.drop("shard", "slot")
    total = df.count()
    count = max(1, min(MOST_PARTS, math.ceil(total / PART_ROWS)))
    per_shard = math.ceil(count / shards)
    own = [df[c] for c in identity]
    keyed = df.select(F.struct("*").alias("row"), F.pmod(F.xxhash64(F.lit(seed), *own), F.lit(count)).cast("int").alias("part"), F.xxhash64(F.lit(seed + 1), *own).alias("first"), F.xxhash64(F.lit(seed + 2), *own).alias("second"))
    sizes = np.zeros(count, np.int64)
    for r in keyed.groupBy("part").agg(F.count("*").alias("n")).collect():
        sizes[r["part"]] = r["n"]
    blocks = np.concatenate([even_sizes(n, per_shard) for n in even_sizes(total, shards).tolist()])
    local = keyed.repartitionById(count, "part").sortWithinPartitions("part", "first", "second")

    def send(batches):
        part, taken, ends = -1, 0, None
        for batch in batches:
            parts = batch.column("part").to_numpy()
            out = np.empty(len(parts), np.int32)
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if parts[a] != part:
                    part, taken = int(parts[a]), 0
                    ends = np.cumsum(matrix_row(sizes, blocks, part, seed))
                out[a:b] = np.searchsorted(ends, np.arange(taken, taken + b - a), side="right")
                taken += b - a
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("second"), pa.array(out)], names=["row", "second", "block"])

    sent = mapped(local.select("row", "part", "second"), send, f"row {keyed.schema['row'].dataType.simpleString()},second bigint,block int")
    dealt = sent.withColumn("third", F.xxhash64(F.lit(seed + 3), *(F.col("row")[c] for c in identity))).repartitionById(len(blocks), "block").sortWithinPartitions("block", "second", "third")

    def receive(batches):
        block, taken = -1, 0
        for batch in batches:
            blocks_of = batch.column("block").to_numpy()
            at = np.arange(len(blocks_of), dtype=np.int64)
            starts = np.concatenate(([0], np.flatnonzero(np.diff(blocks_of)) + 1)) if len(at) else np.zeros(0, np.int64)
            if len(at):
                at -= np.repeat(starts, np.diff([*starts, len(at)]))
                if blocks_of[0] == block:
                    at[: starts[1] if len(starts) > 1 else len(at)] += taken
                block, taken = int(blocks_of[-1]), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("block"), pa.array(at)], names=["row", "block", "at"])

    placed = mapped(dealt.select("row", "block"), receive, f"row {keyed.schema['row'].dataType.simpleString()},block int,at bigint")
    shard, sub = F.floor(F.col("block") / per_shard).cast("int"), F.col("block") % per_shard
    rows = F.lit(total // shards).cast("long") + F.when(shard < total % shards, 1).otherwise(0)
    return placed.select("row.*", shard.alias("shard"), (_start(rows, per_shard, sub) + F.col("at")).cast("long").alias("slot"))
