"""SimHash near duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its segments. Each differing bit moves one count by one, so the Manhattan
distance of two embeddings never exceeds the fingerprints' Hamming distance: pairs within 2 bits lie within Manhattan
distance 2, and then some grid point lies within distance 1 of both. Every distinct fingerprint is put at its own grid
point and at those one step away in each direction; an equi-join on the point finds the candidates, the embedding's
distance and then the Hamming distance verify them. Equal fingerprints are one node before that, so copies form no pairs.

With s segments the join has 2 s + 1 rows per distinct fingerprint. A fingerprint has at most 64 + C(64, 2) = 2080 others
within 2 bits, so links are at most linear in the input. For 21 segments, two random fingerprints are candidates with
probability 1.3e-8.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm import near_copies
from tablewright.llm.common import components, discard, map_rows, written

SEED = 42
SEGMENTS = 21
MOST_BITS = 2


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash over XXH64 of word shingles, repeats included; without words zero. Signed 64-bit.

    Letters A-Z are lower-cased, words are runs without white space, a text of fewer words is one shingle.
    """
    parts = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not parts:
        return 0
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        joined = b" ".join(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        starts = np.concatenate(([0], np.cumsum(sizes[:-1] + 1)))
        ends = (starts + sizes)[words - 1 :].tolist()
        shingles = [joined[a:b] for a, b in zip(starts.tolist(), ends, strict=False)]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 65536):
        part = shingles[at : at + 65536]
        hashes = np.array([digest(x, SEED) for x in part], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (total * 2 > len(shingles)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; null texts are empty."""

    def make(rows):
        return ((d, fingerprint(t, words)) for d, t in rows)

    return map_rows(documents.select(documents[doc_id].cast("long").alias("d"), documents[text].cast("string").alias("t")), make, ["d", "t"], "doc_id bigint,fp bigint")


def _widths(segments: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each segment; bit counts and one step beside them must fit three bits."""
    small, extra = divmod(64, segments)
    if small + (extra > 0) > 5 or segments > 21:
        raise ValueError("from 13 to 21 segments")
    sizes = [small + (k < extra) for k in range(segments)]
    return [(sum(sizes[:k]), n) for k, n in enumerate(sizes)]


def _counts(fp: Column, segments: int) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))).cast("long") for at, n in _widths(segments)]


def links(nodes: DataFrame, most: int = MOST_BITS, segments: int = SEGMENTS) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints (column fp) that differ in at most ``most`` bits, 1 or 2; a pair may come twice."""
    if not 0 < most <= 2:
        raise ValueError("one step of the grid covers two bits at most")
    point = sum(((c + 1) * (1 << (3 * k)) for k, c in enumerate(_counts(F.col("fp"), segments))), F.lit(0).cast("long"))
    steps = [0, *((1 << (3 * k)) * sign for k in range(segments) for sign in (1, -1))]
    placed = nodes.select("fp", point.alias("home"))
    cells = placed.select("fp", F.explode(F.array(*(F.struct((F.col("home") + F.lit(s).cast("long")).alias("point"), F.lit(n).cast("short").alias("step")) for n, s in enumerate(steps)))).alias("c")).select("fp", "c.point", "c.step")
    a, b = cells.select("point", F.col("fp").alias("a"), F.col("step").alias("sa")), cells.select("point", F.col("fp").alias("b"), F.col("step").alias("sb"))
    # Equal steps onto one point mean equal homes: such pairs are taken at home alone.
    # Spark takes the cells for as large as the fingerprints' files, so without the hint it would send all of them to the driver.
    found = a.hint("merge").join(b, "point").where("a < b AND (sa != sb OR sa = 0)")
    distance = sum((F.abs(x - y) for x, y in zip(_counts(F.col("a"), segments), _counts(F.col("b"), segments), strict=True)), F.lit(0).cast("long"))
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most).where(distance <= most).select("a", "b")


def near_duplicates(documents: DataFrame, words: int = 3, most: int = MOST_BITS, segments: int = SEGMENTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``documents``: doc_id, fingerprint (16 hex digits), component_id.

    Texts without words share fingerprint zero and are linked like any others. Null doc_ids keep their row and don't count
    for a component's smallest doc_id, which is null only if all are; repeated rows keep a row each; other columns aren't
    read; an empty table gives no rows.
    """
    prints = written(fingerprints(documents, words, doc_id, text), "simhash")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = components(links(classes, most, segments), "simhash-links")
    # What grows with the input isn't broadcast, at any size of its files.
    labelled = classes.join(roots.hint("merge"), classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of = labelled.join(named.hint("merge"), "root").select("fp", "component_id")
    return prints.join(of.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def candidates(documents: DataFrame, words: int, most: int = MOST_BITS, segments: int = SEGMENTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b), a < b: doc_ids of documents with one fingerprint, or with two that ``links`` finds; at most two pairs for each document.

    Every document is paired with the smallest of its fingerprint, and that with the one of the smallest fingerprint it links to.
    """
    prints = written(fingerprints(documents, words, doc_id, text), "simhash")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    of = lambda x: classes.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}")).hint("merge")
    near = links(classes, most, segments).groupBy("b").agg(F.min("a").alias("a")).join(of("a"), "a").join(of("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    same = prints.join(classes.hint("merge"), "fp").where("doc_id != first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    out = written(near.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "simhash-pairs")
    for done in (prints, classes):
        discard(done)
    return out


def unique_documents(documents: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``documents``, all columns, without near duplicates: of each group the smallest doc_id stays (null last).

    Two documents are linked when the Jaccard similarity of their sets of shingles is ``similarity`` at least; a text of fewer
    words is one shingle; texts without words, null ones too, aren't linked; repeated rows are; an empty table gives no rows.
    The pairs of the embedding's grid are verified first; beyond a few bits it no longer tells pairs apart, and those that it
    can't find, ``near_copies`` finds on the shingles.
    """
    source = documents.select(F.struct("*").alias("row"), documents[text].cast("string").alias("t"), documents[doc_id].cast("long").alias("d"))
    rows = written(source.withColumn("id", F.monotonically_increasing_id()).drop("t"), "near-rows")
    texts = rows.select("id", F.col("row")[text].cast("string").alias("t"))
    found = near_copies.links(texts, words, similarity, candidates(texts, words, doc_id="id", text="t"))
    roots = components(found, "near-links")
    labelled = rows.select("id", "d").join(roots.withColumnRenamed("node", "id").hint("merge"), "id")
    stays = labelled.groupBy("root").agg(F.min(F.struct(F.col("d").isNull(), "d", "id")).alias("best")).select(F.col("best.id").alias("id"))
    gone = written(labelled.select("id").join(stays, "id", "left_anti"), "near-gone")
    # One strategy at every size: what goes may grow with the input, so it isn't broadcast.
    return rows.select("id", "row").join(gone.hint("merge"), "id", "left_anti").select("row.*")


__all__ = ["candidates", "fingerprint", "fingerprints", "links", "near_duplicates", "unique_documents"]
