"""The registered query of each training-data operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import embedding_dedup, exact_dedup, licenses, lm_score, mixing, packing, sharding, simhash, token_store, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from directly addressable codes."""
    return token_store.token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each power-of-two piece, its sequence's id and its place there."""
    packed = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document: 3-word shingles, links at 2 or fewer differing bits."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, most=2)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and labels of licence notices in every document."""
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("matches")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    return exact_dedup.duplicate_groups(_table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector: cosine of 0.93 or more within a label."""
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.93)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, and how many words are tagged toxic."""
    scored = toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_toxic_words"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under law ``rows``; size and checksum are of the texts that arrive."""
    placed = sharding.uniform_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id", "text"], shards=8)
    text = F.coalesce("text", F.lit(""))
    return placed.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and lattice scores of every document."""
    return lm_score.lm_scores(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


#: All rows and whole texts; ties between rows that agree in both are broken by nothing else, as doc_id is unique here.
OP5_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


#: All vectors of equal labels against one another; components by the smallest label that reaches a vector.
OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x != 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id != b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp USING (vec_id) LEFT JOIN deg USING (vec_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_store, op2_packing, op3_simhash, op4_licenses, op5_exact_dedup, op6_embedding_dedup, op7_toxicity, op8_sharding, op9_mixing, op10_lm_score)}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op6_embedding_dedup": OP6_SQL}
