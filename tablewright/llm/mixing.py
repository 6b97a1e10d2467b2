"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted target / size times; the whole part is certain, and the fraction is rounded so that
the words of the source come out near the target. A pivotal step (Deville and Tille) pairs two units of fractional
probability: words pass from one to the other in a random direction that leaves both unbiased, until one is integral.
Here the longest document left is paired with the pool of all shorter ones, whose probabilities move together, so long
documents are settled while the pool can still make up for them. At most one document of a leaf task is left over; the
left-overs of up to ``FAN`` leaves meet in a node of a reduction tree, and one document per source is rounded at the root.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import discard, generator, map_rows, mapped, written

LEAF_ROWS = 8192
FAN = 256
LEAF_COLUMNS = ["row", "size", "position", "leaf", "base", "source_size", "target"]
MOST_COPIES = 3
SEED = 9
#: Rows of the table of sources up to which it is broadcast (a few MB).
BROADCAST_SOURCES = 50_000


def word_sizes(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` as (row: all columns, size: words, runs without \\x20 and \\x09-\\x0D; null: 0)."""
    source = df.select(F.struct("*").alias("row"), df[text].cast("string").alias("t"))

    def run(batches):
        for batch in batches:
            sizes = [len(x.encode().split()) if x else 0 for at in range(0, batch.num_rows, 512) for x in batch.column("t").slice(at, 512).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sizes, pa.int64())], names=["row", "size"])

    return mapped(source, run, f"row {source.schema['row'].dataType.simpleString()},size bigint")


def targets(sizes: list[int], most: int = MOST_COPIES) -> list[float]:
    """Targets for sources in order: weights 1, 2, 3, repeating, share all words; none above ``most`` times its size."""
    weights = [k % 3 + 1 for k in range(len(sizes))]
    out = [0.0] * len(sizes)
    free, rest = list(range(len(sizes))), float(sum(sizes))
    while free:
        whole = sum(weights[k] for k in free)
        over = [k for k in free if rest * weights[k] / whole > most * sizes[k]]
        if not over:
            for k in free:
                out[k] = rest * weights[k] / whole
            break
        for k in over:
            out[k] = float(most * sizes[k])
        rest -= sum(out[k] for k in over)
        over = set(over)
        free = [k for k in free if k not in over]
    return out


def exchange(size_i: float, mass_i: float, size_j: float, mass_j: float, u: float) -> tuple[float, float]:
    """New masses (probability times size) of two documents; one of them is 0 or its size."""
    up, down = min(size_i - mass_i, mass_j), min(mass_i, size_j - mass_j)
    if u * (up + down) < down:
        return (size_i, mass_j - up) if up == size_i - mass_i else (mass_i + up, 0.0)
    return (0.0, mass_j + down) if down == mass_i else (mass_i - down, size_j)


class Pool:
    """The documents of a leaf from the longest on; all not yet seen share one probability, ``mass / size``."""

    def __init__(self, rng, size: int, part: float):
        self.rng, self.size, self.part, self.mass, self.all = rng, size, part, size * part, None

    def settle(self, size: int) -> tuple[int | None, float]:
        """(up, 0), or (None, mass) for the document that is left over."""
        if size == 0:  # no words to exchange: rounded alone
            return int(self.rng.random() < self.part), 0.0
        if self.all is not None:
            return self.all, 0.0
        mass = size * self.mass / self.size
        self.size, self.mass = self.size - size, self.mass - mass if self.size > size else 0.0
        mass, self.mass = exchange(size, mass, self.size, self.mass, self.rng.random())
        if integral(mass, size):
            return int(mass > size / 2), 0.0
        self.all = int(self.mass > 0)
        return None, mass


def integral(mass: float, size: float) -> bool:
    """Whether a probability is 0 or 1 but for rounding errors."""
    return not 1e-9 * size < mass < size * (1 - 1e-9)


def settle_few(rng, sizes: list[int], masses: list[float]) -> list[float]:
    """The new masses of documents of unequal probabilities: all but one integral.

    The longest document that isn't settled moves against all others, which share its words by size p (1 - p), along one line
    in a random direction up to the first that becomes integral; so the words stay and no probability is biased.
    """
    size, mass = np.array(sizes, float), np.array(masses, float)
    while True:
        p = np.where(size > 0, mass / np.maximum(size, 1e-300), 0.0)
        free = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
        if len(free) < 2:
            return mass.tolist()
        k, rest = free[0], free[1:]
        share = size[rest] * p[rest] * (1 - p[rest])
        share = share / share.sum()
        up = min(size[k] - mass[k], (mass[rest] / share).min())
        down = min(mass[k], ((size[rest] - mass[rest]) / share).min())
        move = up if rng.random() * (up + down) < down else -down
        mass[k] += move
        mass[rest] -= move * share
        near = np.isclose(mass, size, rtol=1e-9, atol=0)
        mass = np.where(near, size, np.where(mass < 1e-9 * size, 0.0, mass))


def _leaves(batches):
    """The rows with copies, or with null and the mass for the one document that a leaf leaves over."""
    key, pool = None, None
    for batch in batches:
        copies, mass = [], []
        for position, leaf, size, base, part, whole in zip(*(batch.column(c).to_pylist() for c in ("position", "leaf", "size", "base", "part", "leaf_size")), strict=True):
            if (position, leaf) != key:
                key, pool = (position, leaf), Pool(generator(SEED, 1, position, leaf), whole, part)
            up, left = pool.settle(size)
            copies.append(None if up is None else base + up)
            mass.append(left)
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in LEAF_COLUMNS), pa.array(copies, pa.int64()), pa.array(mass, pa.float64())], names=[*LEAF_COLUMNS, "copies", "mass"])


def mix(sized: DataFrame, source: str, identity: list[str], most: int = MOST_COPIES) -> DataFrame:
    """``sized`` (row, size) as row, size, source_size, target, copies: how often the mix takes each row.

    Sources are ordered by code point, null last, and weigh 1, 2, 3, repeating; a row without words is rounded alone; one
    of equal rows (in ``identity`` and size) stands for another, so reruns agree. An empty table gives no rows, a lone
    source is taken once. The table of sources has a row for each source and goes through the driver; documents don't.
    """
    spark = sized.sparkSession
    stats = sized.groupBy(F.col("row")[source].cast("string").alias("source")).agg(F.sum("size").alias("n"), F.count("*").alias("rows")).orderBy(F.asc_nulls_last("source")).collect()
    wanted = targets([r["n"] for r in stats], most)
    table = []
    for k, r in enumerate(stats):
        ratio = min(float(most), wanted[k] / r["n"]) if r["n"] else 1.0
        base = math.floor(ratio + 1e-12)
        table.append((r["source"], k, r["n"], wanted[k], base, max(0.0, ratio - base), math.ceil(r["rows"] / LEAF_ROWS)))
    sources = spark.createDataFrame(table, "source string, position int, source_size long, target double, base long, part double, leaves int")
    sources = F.broadcast(sources) if len(table) <= BROADCAST_SOURCES else sources
    own = [F.col("row")[c] for c in identity]
    rows = sized.withColumn("_source", F.col("row")[source].cast("string")).join(sources, F.col("_source").eqNullSafe(F.col("source"))).drop("_source", "source")
    rows = rows.withColumn("tie", F.xxhash64(F.lit(SEED), "size", *own)).withColumn("leaf", F.pmod("tie", "leaves").cast("int"))
    whole = F.sum("size").over(Window.partitionBy("position", "leaf"))
    placed = rows.repartition("position", "leaf").withColumn("leaf_size", whole).sortWithinPartitions("position", "leaf", F.desc("size"), "tie")
    row_type = sized.schema["row"].dataType.simpleString()
    ddl = f"row {row_type},size bigint,position int,leaf int,base bigint,source_size bigint,target double,copies bigint,mass double"
    settled = written(mapped(placed.select(*LEAF_COLUMNS, "part", "leaf_size"), _leaves, ddl), "mixing")
    out = ["row", "size", "source_size", "target"]
    left = settled.where("copies IS NULL")
    decided = _tree(left.select("position", F.col("leaf").alias("child"), "leaf", "size", "mass"), max((t[-1] for t in table), default=0))
    last = left.join(decided, ["position", "leaf"]).select(*out, (F.col("base") + F.col("up")).alias("copies"))
    return settled.where("copies IS NOT NULL").select(*out, "copies").unionByName(last)


def _tree(carried: DataFrame, widest: int) -> DataFrame:
    """(position, leaf, up) for the documents that leaves have left over, level by level."""
    ddl = "position int,child int,leaf int,size bigint,mass double,up int"
    level, decided = 1, None
    while True:
        root = widest <= 1

        def nodes(rows, level=level, root=root):
            for (position, node), held in groupby(rows, key=lambda r: r[:2]):
                held = list(held)
                rng = generator(SEED, 2, level, position, node)
                for (*_, leaf, size, _), mass in zip(held, settle_few(rng, [r[3] for r in held], [r[4] for r in held]), strict=True):
                    up = int(mass > size / 2) if integral(mass, size) else int(rng.random() * size < mass) if root else None
                    yield position, node, leaf, size, mass, up

        placed = carried.withColumn("node", F.floor(F.col("child") / FAN).cast("int")).repartition("position", "node").sortWithinPartitions("position", "node", F.desc("size"), "leaf")
        stepped = written(map_rows(placed, nodes, ["position", "node", "leaf", "size", "mass"], ddl), "mixing-tree")
        now = stepped.where("up IS NOT NULL").select("position", "leaf", "up")
        decided = now if decided is None else decided.unionByName(now)
        if root:
            return decided
        carried, level, widest = stepped.where("up IS NULL").select("position", "child", "leaf", "size", "mass"), level + 1, math.ceil(widest / FAN)


def taken(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``documents``.

    Null texts have no words; null and repeated doc_ids keep a row each, told apart by their texts; rows equal in both may
    stand for one another; other columns aren't read; an empty table gives no rows.
    """
    narrow = word_sizes(documents.select(documents[doc_id].cast("long").alias("doc_id"), documents[source].alias("source"), documents[text].alias("text")))
    sized = written(narrow.select(F.struct("row.doc_id", "row.source", F.xxhash64("row.text").alias("text")).alias("row"), "size"), "mixing-sizes")
    drawn = mix(sized, "source", ["doc_id", "text"])
    discard(sized)  # the mix has been settled and written
    return drawn.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(documents: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of ``documents``, all columns, as many times as it is taken; nulls and ties as in ``taken``."""
    sized = written(word_sizes(documents, text), "mixing-sizes")
    drawn = mix(sized, source, documents.columns)
    discard(sized)  # the mix has been settled and written
    return drawn.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
