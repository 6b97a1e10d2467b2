"""Near copies: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more, by an exact prefix filter.

Pairs that SimHash's grid has found come in as candidates and are verified first; the filter finds the others, which the grid
can't tell apart: at a similarity of 0.8 some 15 % of the bits differ. Of two documents that are similar enough, the first shingles of each (a prefix of some 20 %) in one common order share one, so documents meet on those. The order
goes by the number of documents that hold a shingle: what only one document holds comes first and meets nothing, so a document
with a prefix of such shingles is done, and only near copies, and texts made mostly of shared passages, take part in what
follows. The order decides how many pairs are tried, never which are linked.

1. Scan tasks take blocks of documents and send each shingle, cut to 32 bits beside its part of the hash range, to the part's
   task; a shingle that many documents of a block hold goes once, and comes last in the order for everybody.
2. A part's task counts documents and answers each block about shingles that more than one document holds.
3. The block's task orders them and gives out the prefixes of documents: the points where they meet.
4. The candidates whose parities leave hope are verified on whole sets. At each point all meet one of them, another one at each
   point, and pairs that the candidates haven't connected are verified likewise. That collapses large groups. Then every two of a point that aren't connected by then are compared by their parities inside
   a task, a part of a point's documents at a time, and only pairs with hope leave it, to be verified in turn.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import components, discard, mapped, written

#: A block of documents is closed once it has so many shingles or documents.
BLOCK_SHINGLES = 2_000_000
BLOCK_ROWS = 60_000
#: Shingles that a part of the hash range has, about, and parts there are at least (a power of two).
PART_SHINGLES = 8_000_000
LEAST_PARTS = 64
#: Documents of a block that hold a shingle which is then common to all, and the places of such shingles in the order.
COMMON = 16
LAST = 255
#: The document that stands for "common in this block".
MANY = 0xFFFF
#: Documents of a point that one part holds, and pairs of them that a task compares at a time.
PART = 2048
PAIRS = 50_000


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a text of fewer words is one shingle, one without words has none."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = max(1, len(parts) - words + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(words, len(parts))):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        total = (total ^ (total >> np.uint64(shift))) * np.uint64(factor)
    return np.unique(total ^ (total >> np.uint64(31)))


def prefix_sizes(n: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """How many first shingles of ``n`` share one with those of any similar document; and with those of one at least as long."""
    return tuple(n - np.ceil(share * n - 1e-9).astype(np.int64) + 1 for share in (similarity, 2 * similarity / (1 + similarity)))


def parities(own: np.ndarray) -> bytes:
    """For each of 4 n or more hash slots, a power of two, whether an odd number of ``own`` fall into it."""
    size = max(64, 1 << int(4 * len(own) - 1).bit_length())
    slots = np.bincount((own & np.uint64(size - 1)).view(np.int64), minlength=size)
    return np.packbits((slots & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """So many shingles at least are in one only of two sets with these parities."""
    x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def hopeful(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (a, b) without those that the parities (node, n, bits) show to differ in too many shingles; none alike goes."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    held = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        for batch in batches:
            most = (batch.column("na").to_numpy() + batch.column("nb").to_numpy()) * ((1 - similarity) / (1 + similarity)) + 1e-9
            found = [least_difference(x, y) for x, y in zip(batch.column("bitsa").to_pylist(), batch.column("bitsb").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(np.array(found) <= most))

    return mapped(held.select("a", "b", "na", "nb", "bitsa", "bitsb"), run, "a bigint,b bigint")


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of parities (64-bit words) over fewer slots."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


def _compared(batches, similarity: float):
    """(a, b) of documents of a bucket whose groups differ and whose parities leave hope; a part first, then its visitors.

    A pair that comes up in several buckets of a task is given once, as far as the last million pairs go.
    """
    key, homes, visitors, seen = None, [], [], set()

    def tables(rows):
        """Rows by length of their parities: words, then node, n, short, root and the parities."""
        by = {}
        for r in rows:
            by.setdefault(len(r[4]) // 8, []).append(r)
        return {w: (*(np.array([r[k] for r in of]) for k in range(4)), np.frombuffer(b"".join(r[4] for r in of), np.uint64).reshape(len(of), w)) for w, of in by.items()}

    def hopeful_pairs(left, right, same):
        for w, (node, n, short, root, bits) in left.items():
            for v, (node2, n2, short2, root2, bits2) in right.items():
                if max(v, w) > 2 * min(v, w):
                    continue  # lengths too far apart
                x, y = folded(bits, min(v, w)), folded(bits2, min(v, w))
                for at in range(0, len(node), 256):
                    p = slice(at, at + 256)
                    a, b = n[p, None], n2[None, :]
                    some = (root[p, None] != root2[None, :]) & (np.minimum(a, b) >= np.ceil(similarity * np.maximum(a, b) - 1e-9)) & (((a <= b) & short[p, None]) | ((b <= a) & short2[None, :]))
                    if same:
                        some &= node[p, None] < node2[None, :]
                    i, j = np.nonzero(some)
                    step = max(1, PAIRS * 8 // min(v, w))
                    for k in range(0, len(i), step):
                        q, r = i[k : k + step] + at, j[k : k + step]
                        apart = np.bitwise_count(x[q] ^ y[r]).sum(axis=1, dtype=np.int64)
                        near = apart <= (n[q] + n2[r]) * ((1 - similarity) / (1 + similarity)) + 1e-9
                        yield np.minimum(node[q[near]], node2[r[near]]), np.maximum(node[q[near]], node2[r[near]])

    def new(found):
        for a, b in found:
            fresh = [x for x in zip(a.tolist(), b.tolist(), strict=True) if x not in seen]
            if len(seen) > 1_000_000:
                seen.clear()
            seen.update(fresh)
            if fresh:
                a, b = zip(*dict.fromkeys(fresh), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    left = None
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            for point, share, visits, *row in zip(*(part.column(c).to_pylist() for c in ("point", "part", "visits", "node", "n", "short", "root", "bits")), strict=True):
                if (point, share) != key:
                    if left is None:
                        yield from new(hopeful_pairs(t := tables(homes), t, True))
                    elif visitors:
                        yield from new(hopeful_pairs(left, tables(visitors), False))
                    key, homes, visitors, left = (point, share), [], [], None
                if not visits:
                    homes.append(row)
                    continue
                if left is None:
                    left = tables(homes)
                    yield from new(hopeful_pairs(left, left, True))
                visitors.append(row)
                if len(visitors) >= PART:
                    yield from new(hopeful_pairs(left, tables(visitors), False))
                    visitors = []
    if left is None:
        yield from new(hopeful_pairs(t := tables(homes), t, True))
    elif visitors:
        yield from new(hopeful_pairs(left, tables(visitors), False))


def _coded(parts: np.ndarray, tokens: np.ndarray, who: np.ndarray, cls: np.ndarray | None = None):
    """(part, bytes) for entries in order of their parts: 32-bit tokens, 16-bit documents and, if given, 8-bit classes."""
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield int(parts[a]), tokens[a:b].astype("<u4").tobytes() + who[a:b].astype("<u2").tobytes() + (b"" if cls is None else cls[a:b].astype(np.uint8).tobytes())


LOG_DDL = "kind string,part int,block bigint,data binary"
LOG = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])


def _log_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), LOG.types, strict=True)], schema=LOG)


def _scanned(batches, words: int, bits: int):
    """'ask' rows (entries of a part), and for the block 'known' rows (entries of common shingles) and one of 'sizes' (ids, set sizes)."""
    block, ids, sets, load = TaskContext.get().partitionId() << 24, [], [], 0

    def close():
        n = np.array([len(x) for x in sets], np.int64)
        h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        h, who = h[order], np.repeat(np.arange(len(n)), n)[order]
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        runs = np.diff([*starts.tolist(), len(h)])
        common = np.repeat(runs >= COMMON, runs)
        part, token = (h >> np.uint64(64 - bits)).astype(np.int32), (h >> np.uint64(32 - bits)).astype(np.uint32)
        once = np.zeros(len(h), bool)
        once[starts] = True
        sent = ~common | once
        asked = _coded(part[sent], token[sent], np.where(common, MANY, who)[sent])
        yield _log_batch([("sizes", block % (1 << bits), block, np.array(ids, np.int64).tobytes() + n.astype(np.uint32).tobytes())])
        for kind, found in (("ask", asked), ("known", _coded(part[common], token[common], who[common], np.full(int(common.sum()), LAST)))):
            held, size = [], 0
            for p, data in found:
                held.append((kind, p, block, data))
                size += len(data)
                if size > 8_000_000:
                    yield _log_batch(held)
                    held, size = [], 0
            if held:
                yield _log_batch(held)

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            for id_, text in zip(batch.column("id").slice(at, 512).to_pylist(), batch.column("t").slice(at, 512).to_pylist(), strict=True):
                own = shingle_set(text, words)
                if not len(own):
                    continue
                ids.append(id_)
                sets.append(own)
                load += len(own)
                if load >= BLOCK_SHINGLES or len(ids) >= BLOCK_ROWS:
                    yield from close()
                    block, ids, sets, load = block + 1, [], [], 0
    if ids:
        yield from close()


def _decoded(data: bytes, classes: bool) -> tuple[np.ndarray, ...]:
    n = len(data) // (7 if classes else 6)
    out = np.frombuffer(data, "<u4", n), np.frombuffer(data, "<u2", n, 4 * n)
    return (*out, np.frombuffer(data, np.uint8, n, 6 * n)) if classes else out


def _answered(batches):
    """What a part's task tells the blocks: 'known' rows of entries that more than one document holds; other rows pass through."""
    asked: dict[int, list[tuple[int, bytes]]] = {}
    for batch in batches:
        own = batch.column("kind").to_pylist()
        for kind, part, block, data in zip(own, *(batch.column(c).to_pylist() for c in ("part", "block", "data")), strict=True):
            if kind == "ask":
                asked.setdefault(part, []).append((block, data))
        if any(k != "ask" for k in own):
            yield batch.filter(pa.array([k != "ask" for k in own]))
    for part in list(asked):
        entries = sorted(asked.pop(part))
        decoded = [_decoded(data, False) for _, data in entries]
        token, who = (np.concatenate([d[k] for d in decoded]) for k in (0, 1))
        _, place, count = np.unique(token, return_inverse=True, return_counts=True)
        many = np.zeros(len(count), bool)
        many[place[who == MANY]] = True
        cls = np.where(many, LAST, np.minimum(count, LAST - 1))[place]
        keep = (who != MANY) & (cls > 1)
        ends = np.cumsum([len(d[0]) for d in decoded])
        held = []
        for (block, _), a, b in zip(entries, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            some = keep[a:b]
            if some.any():
                held += [("known", p, block, data) for p, data in _coded(np.full(int(some.sum()), part), token[a:b][some], who[a:b][some], cls[a:b][some])]
        if held:
            yield _log_batch(held)


POINTS_DDL = "point bigint,node bigint,n int,short boolean"


def _points(batches, similarity: float):
    """The prefixes of each block's documents as points, from its 'sizes' row and 'known' rows."""
    block, sizes, parts = None, None, []

    def close():
        if sizes is None or not parts:
            return
        count = len(sizes) // 12
        ids, n = np.frombuffer(sizes, np.int64, count), np.frombuffer(sizes, np.uint32, count, 8 * count).astype(np.int64)
        decoded = [(p, *_decoded(data, True)) for p, data in sorted(parts)]
        point = np.concatenate([(np.int64(p) << np.int64(32)) | token.astype(np.int64) for p, token, _, _ in decoded])
        who, cls = np.concatenate([d[2] for d in decoded]).astype(np.int64), np.concatenate([d[3] for d in decoded])
        order = np.lexsort((point, cls, who))
        point, who = point[order], who[order]
        first = np.concatenate(([0], np.flatnonzero(np.diff(who)) + 1))
        shared = np.diff([*first.tolist(), len(who)])
        # Shingles that no other document holds come before all these.
        place = np.arange(len(who)) - np.repeat(first, shared) + np.repeat(n[who[first]] - shared, shared)
        long, short = prefix_sizes(n[who], similarity)
        chosen = place < long
        for a in range(0, int(chosen.sum()), 100_000):
            k = np.flatnonzero(chosen)[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(point[k]), pa.array(ids[who[k]]), pa.array(n[who[k]].astype(np.int32)), pa.array(place[k] < short[k])], names=["point", "node", "n", "short"])

    for batch in batches:
        for kind, part, now, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "part", "block", "data")), strict=True):
            if now != block:
                yield from close()
                block, sizes, parts = now, None, []
            if kind == "sizes":
                sizes = data
            else:
                parts.append((part, data))
    yield from close()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets (node, shingles) have that Jaccard similarity at least."""
    held = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches):
        for batch in batches:
            alike = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return mapped(held.select("a", "b", "x", "y"), run, "a bigint,b bigint")


def links(rows: DataFrame, words: int, similarity: float, candidates: DataFrame) -> DataFrame:
    """(a, b), a < b: links between the documents of ``rows`` (id, t) that connect all that are similar; not every link there is.

    ``candidates`` (a, b), a < b, are verified first, and what they connect isn't looked for again; they may be any pairs.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    bits = max(LEAST_PARTS.bit_length() - 1, math.ceil(math.log2(total / 6 / PART_SHINGLES + 1)))

    def scan(batches):
        yield from _scanned(batches, words, bits)

    def choose(batches):
        yield from _points(batches, similarity)

    answers = mapped(mapped(rows.select("id", "t"), scan, LOG_DDL).repartitionById(1 << bits, "part"), _answered, LOG_DDL)
    points = mapped(answers.repartition("block").sortWithinPartitions("block"), choose, POINTS_DDL)
    bucket = Window.partitionBy("point")
    # A point's first document is another one at each point, so a document meets many of its group in turn.
    first = F.min(F.struct(F.xxhash64("node", "point").alias("place"), "node", "n")).over(bucket)
    met = written(points.withColumn("c", first).withColumn("size", F.count("*").over(bucket)).where("size > 1"), "near-points")
    near = F.least("na", "nb") >= F.ceil(F.lit(similarity) * F.greatest("na", "nb") - 1e-9)

    def full_sets(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [shingle_set(t, words) for t in part.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(x) for x in own], pa.int32()), pa.array([parities(x) for x in own], pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())], names=["node", "n", "bits", "shingles"])

    here = met.select(F.col("node").alias("id")).distinct()
    sets = written(mapped(rows.select("id", "t").join(here, "id", "left_semi"), full_sets, "node bigint,n int,bits binary,shingles binary"), "near-sets")
    classes = sets.select("node", "n", "bits")
    star = met.select(F.col("c.node").alias("a"), F.col("node").alias("b"), F.col("c.n").alias("na"), F.col("n").alias("nb")).where("a != b").where(near)
    star = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # Similar documents share a point, so a candidate without a set is none.
    known = written(verified(hopeful(candidates, classes, similarity), sets, similarity), "near-known")
    group = components(known, "near-known-groups")
    for x in ("a", "b"):
        star = star.join(group.select(F.col("node").alias(x), F.col("root").alias(f"root{x}")).hint("merge"), x, "left")
    star = star.where(F.coalesce("roota", "a") != F.coalesce("rootb", "b")).select("a", "b")
    tried = written(hopeful(star, classes, similarity), "near-tried")
    edges = written(known.unionByName(verified(tried, sets, similarity)), "near-edges")
    grouped = met.join(components(edges, "near-groups").hint("merge"), "node", "left").select("point", "node", "n", "short", F.coalesce("root", "node").alias("root"), "size")
    still = grouped.withColumns({"one": F.min("root").over(bucket), "other": F.max("root").over(bucket)}).where("one != other")
    homes = still.withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / PART)).cast("int")).select("point", "part", F.lit(False).alias("visits"), "node", "n", "short", "root")
    homes = written(homes, "near-homes")
    visits = homes.where("part > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("part") - 1))).withColumn("visits", F.lit(True))
    both = homes.unionByName(visits).join(classes.select("node", "bits").hint("merge"), "node")
    dealt = both.repartition("point", "part").sortWithinPartitions("point", "part", "visits")

    def compare(batches):
        yield from _compared(batches, similarity)

    cross = mapped(dealt.select("point", "part", "visits", "node", "n", "short", "root", "bits"), compare, "a bigint,b bigint").distinct()
    more = written(cross.join(tried, ["a", "b"], "left_anti"), "near-tried")
    found = written(edges.unionByName(verified(more, sets, similarity)), "near-edges")
    for done in (met, sets, known, tried, edges, homes, more):
        discard(done)
    return found
