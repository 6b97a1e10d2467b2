"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage but the last returns the columns of ``documents``. Nulls, empty texts and repeated rows are handled as the
operators' docstrings say; an empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import exact_dedup, mixing, packing, simhash, toxicity
from tablewright.llm.common import collecting, delete, discard, written

#: Folders that the operators of each stage have made and that are still there, by the stage's place.
_made: dict[int, list[str]] = {}


def _staged(place: int, stage: Callable) -> Callable:
    """The stage; it deletes what earlier stages' operators left behind, unless ``docs`` still reads it."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if any(_made.get(k) for k in range(place)) else []
        for k in range(place):
            for path in _made.pop(k, []):
                if any(path.split(":")[-1].strip("/") in f for f in read):
                    _made.setdefault(k, []).append(path)
                else:
                    delete(spark, path)
        with collecting() as paths:
            out = stage(spark, docs, sf_dir)
        _made.setdefault(place, []).extend(paths)
        return out

    run.__doc__, run.__name__ = stage.__doc__, stage.__name__
    return run


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.7."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space."""
    return exact_dedup.unique_documents(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: shingles of five words, similarity of 0.8 or more.

    Candidates come from op3's grid of segment popcounts; those it can't tell apart, from an exact prefix filter.
    """
    return simhash.unique_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The power-of-two pieces of what is left, with their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [(name, _staged(k, stage)) for k, (name, stage) in enumerate((("toxicity", without_toxic), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("mixing", mixed), ("packing", packed)))]

#: Classifier training, random rounding and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
            if before is not None:
                discard(before)
            before = docs
    return docs
