"""Embedding near duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance 2 - 2 c. A random rotation (signs and a Walsh-Hadamard transform)
spreads it evenly; of the rotated vectors' blocks of ``width`` coordinates, at least one then holds a share of it that is
no more than the block's share of the coordinates. Each block is range-joined under that budget: a grid on some of its
coordinates, with cells twice as wide as the budget's radius, sends a vector to every cell that its ball meets; in the home
cell of the other vector the block distance decides on candidates, and the cosine of the original vectors in double
precision verifies them. A pair is taken at the first block that holds it only, so nothing is counted twice.

Vectors that are equal bit for bit are one node before the join. A cell with many home vectors is split into parts, each
met by all its visitors, so a task holds a bounded part whatever the cell. Tasks send link counts and a spanning forest of
the links they verify, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import components, generator, local_forest, mapped, written

WIDTH = 8
#: Coordinates of a block that its grid has: the more vectors a label has, the more, as each takes a vector to 1.8 times as many
#: cells and leaves about a third fewer pairs to compare. Which pairs are linked doesn't depend on it.
LEAST_AXES, MOST_AXES = 2, 5
CELLS_AN_AXIS = 2.2
#: Home vectors of a cell that one part holds, and visitors that meet them at a time.
PART = 4096
VISITORS = 1024
#: Relative slack of budgets for rounding; verification is exact.
SLACK = 1e-9


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component below 1, so that no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Rotated rows, zero-padded to a power of two; a row's result doesn't depend on the rows beside it."""
    n = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), n))
    signs = generator(seed, n).integers(0, 2, n) * 2.0 - 1
    y[:, : x.shape[1]] = x
    for turn in range(2):
        y = y * np.roll(signs, turn * 7)
        h = 1
        while h < n:
            z = y.reshape(len(y), -1, 2, h)
            y = np.concatenate((z[:, :, :1] + z[:, :, 1:], z[:, :, :1] - z[:, :, 1:]), axis=2).reshape(len(y), n)
            h *= 2
        y = y / np.sqrt(n)
    return y


def blocks_of(n: int, width: int) -> list[tuple[int, int]]:
    return [(a, min(a + width, n)) for a in range(0, n, width)]


def axes_for(vectors: int) -> int:
    """As many as leave some ``PART`` home vectors in a cell, within bounds."""
    return max(LEAST_AXES, min(MOST_AXES, math.ceil(math.log(max(vectors, 1) / PART + 1) / math.log(CELLS_AN_AXIS))))


def _vectors(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def _place(batches, limit: float, width: int, seed: int, axes: int):
    """Rows (dim, block, cell, home) of each class for every cell it visits."""
    for batch in batches:
        groups: dict[int, list[int]] = {}
        raw = batch.column("raw").to_pylist()
        for k, x in enumerate(raw):
            groups.setdefault(len(x) // 8, []).append(k)
        for dim, own in groups.items():
            for at in range(0, len(own), 1024):
                rows = own[at : at + 1024]
                y = rotate(unit(_vectors([raw[k] for k in rows])), seed)
                for number, (a, b) in enumerate(blocks_of(y.shape[1], width)):
                    reach = np.sqrt(limit * (b - a) / y.shape[1] * (1 + SLACK)) * (1 + SLACK)
                    grid = y[:, a : min(b, a + axes)] / (2 * reach)
                    base = np.floor(grid).astype(np.int64)
                    for step in np.ndindex(*[3] * grid.shape[1]):
                        move = np.array(step) - 1
                        away = np.where(move == 0, 0.0, np.where(move < 0, grid - base, base + 1 - grid))
                        some = np.flatnonzero((away * away).sum(axis=1) <= 0.25 * (1 + 1e-6))
                        if some.size:
                            cell = base[some] + move
                            at_rows = pa.array([rows[k] for k in some.tolist()])
                            n = len(some)
                            yield pa.RecordBatch.from_arrays([batch.column("node").take(at_rows), batch.column("label").take(at_rows), pa.array([dim] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array([":".join(map(str, c)) for c in cell.tolist()]), pa.array([not move.any()] * n)], names=["node", "label", "dim", "block", "cell", "home"])


def _verify(batches, limit: float, least: float, width: int, seed: int):
    """('links', node, count) and ('edge', a, b) rows from cells in order: homes of a part first, then its visitors."""
    key, homes, visitors = None, [], []

    def rows_of_pairs():
        if not homes or not visitors:
            return
        hn, hs, hx = np.array([r[0] for r in homes]), np.array([r[1] for r in homes]), _vectors([r[2] for r in homes])
        vn, vs, vx = np.array([r[0] for r in visitors]), np.array([r[1] for r in visitors]), _vectors([r[2] for r in visitors])
        hy, vy, hx, vx = rotate(unit(hx), seed), rotate(unit(vx), seed), scaled(hx), scaled(vx)
        cuts = blocks_of(hy.shape[1], width)
        a, b = cuts[key[3]]
        budget = np.array([limit * (y - x) / hy.shape[1] * (1 + SLACK) for x, y in cuts])
        h, v = hy[:, a:b], vy[:, a:b]
        near = (h * h).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2 * h @ v.T <= budget[key[3]] + 1e-9
        near &= vn[None, :] < hn[:, None]
        i, j = np.nonzero(near)
        for at in range(0, len(i), 100_000):
            p, q = i[at : at + 100_000], j[at : at + 100_000]
            squares = (hy[p] - vy[q]) ** 2
            inside = np.add.reduceat(squares, [x for x, _ in cuts], axis=1) <= budget
            first = inside.argmax(axis=1) == key[3]
            x, y = hx[p], vx[q]
            cosine = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
            linked = inside.any(axis=1) & first & (cosine >= least)
            p, q = p[linked], q[linked]
            if len(p):
                nodes, where = np.unique(np.concatenate((hn[p], vn[q])), return_inverse=True)
                counts = np.bincount(where, np.concatenate((vs[q], hs[p]))).astype(np.int64)
                yield from (("links", n, c) for n, c in zip(nodes.tolist(), counts.tolist(), strict=True))
                yield from (("edge", u, w) for u, w in local_forest(zip(hn[p].tolist(), vn[q].tolist(), strict=True)))

    def rows():
        nonlocal key, homes, visitors
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                columns = batch.slice(at, 1024).to_pydict()
                for label, dim, part, block, cell, home, node, size, raw in zip(*(columns[c] for c in ("label", "dim", "part", "block", "cell", "home", "node", "size", "raw")), strict=True):
                    now = (label, dim, part, block, cell)
                    if now != key:
                        yield from rows_of_pairs()
                        key, homes, visitors = now, [], []
                    if home == 1:
                        homes.append((node, size, raw))
                    else:
                        visitors.append((node, size, raw))
                        if len(visitors) >= VISITORS:
                            yield from rows_of_pairs()
                            visitors = []
        yield from rows_of_pairs()

    held = []
    for row in rows():
        held.append(row)
        if len(held) >= 20_000:
            yield held
            held = []
    if held:
        yield held


def near_duplicates(vectors: DataFrame, least: float = 0.93, width: int = WIDTH, seed: int = 6) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors are compared when labels and lengths are equal; null labels, and vectors that are null, empty, zero or hold null
    or non-finite components, link with nothing. Null vec_ids keep their row, whose component_id is null unless it is linked;
    repeated rows count as vectors of their own; other columns aren't read; an empty table gives no rows.
    """
    limit = 2 - 2 * least
    values = F.transform(vectors["embedding"], lambda v: v.cast("double"))
    own = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("string").alias("label"), values.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))

    def pack(batches):
        for batch in batches:
            raw = [None if not good else np.array(v, "<f8").tobytes() for good, v in zip(batch.column("fine").to_pylist(), batch.column("v").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(raw, pa.binary())], names=["vec_id", "label", "raw"])

    rows = written(mapped(own.withColumn("fine", fine), pack, "vec_id bigint,label string,raw binary").withColumn("row", F.monotonically_increasing_id()), "vectors")
    classes = written(rows.where("raw IS NOT NULL").groupBy("label", "raw").agg(F.min("vec_id").alias("least"), F.count("*").alias("size")).withColumn("node", F.monotonically_increasing_id()), "vector-classes")

    axes = axes_for(classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0)

    def place(batches):
        yield from _place(batches, limit, width, seed, axes)

    placed = written(mapped(classes.select("node", "label", "raw"), place, "node bigint,label string,dim int,block int,cell string,home boolean"), "vector-cells")
    where = ["label", "dim", "block", "cell"]
    parts = placed.where("home").groupBy(*where).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    met = placed.join(parts, where)
    homes = met.where("home").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("home", F.lit(1))
    visits = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("home", F.lit(2))
    columns = [*where, "part", "home", "node"]
    both = homes.select(*columns).unionByName(visits.select(*columns)).join(classes.select("node", "size", "raw"), "node")
    dealt = both.repartition(*where, "part").sortWithinPartitions(*where, "part", "home", "node")

    def verify(batches):
        for held in _verify(batches, limit, least, width, seed):
            kind, a, b = zip(*held, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

    found = written(mapped(dealt.select(*where, "part", "home", "node", "size", "raw"), verify, "kind string,a bigint,b bigint"), "vector-links")
    links = found.where("kind = 'links'").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    roots = components(found.where("kind = 'edge'").select("a", "b"), "vector-components")
    named = classes.join(links, "node", "left").join(roots, "node", "left").select("node", "label", "raw", "least", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(smallest, "root").select("label", "raw", "n_links", "component_id")
    out = rows.join(of, ["label", "raw"], "left")
    component = F.when(F.col("n_links") > 0, F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
