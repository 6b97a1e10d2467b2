"""Named versions of a catalog's fingerprints in one partitioned table, and what changed between them."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.meta import analysis
from tablewright.meta.catalog import Catalog

SCHEMA = "instance string, db string, table string, col_hash string, index_hash string, fk_hash string, scanned_at timestamp, version string"


def save(c: Catalog, path: str, version: str, at: datetime.datetime | None = None) -> None:
    """Adds a version; its partition is written by Spark's commit protocol, so readers see all of it or nothing."""
    spark = c.tables.sparkSession
    if version in versions(spark, path):
        raise ValueError(f"version {version} exists")
    stamp = F.lit(at) if at else F.current_timestamp()
    analysis.fingerprints(c).withColumn("scanned_at", stamp.cast("timestamp")).withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def versions(spark: SparkSession, path: str) -> list[str]:
    """Versions from the oldest on."""
    rows = _stored(spark, path).groupBy("version").agg(F.max("scanned_at").alias("at")).orderBy("at", "version").collect()
    return [r.version for r in rows]


def load(spark: SparkSession, path: str, version: str) -> DataFrame:
    return _stored(spark, path).where(F.col("version") == version).drop("version", "scanned_at")


def changes(spark: SparkSession, path: str, before: str, after: str | None = None, current: Catalog | None = None) -> DataFrame:
    """Tables added, removed or changed from one version to another, or to a catalog as it is now."""
    now = analysis.fingerprints(current) if current is not None else load(spark, path, after or versions(spark, path)[-1])
    return analysis.delta(load(spark, path, before), now)


def since(spark: SparkSession, path: str, at: datetime.datetime, current: Catalog) -> DataFrame:
    """Changes from the newest version that is no younger than ``at``; without one every table is new."""
    old = _stored(spark, path).where(F.col("scanned_at") <= F.lit(at)).groupBy("version").agg(F.max("scanned_at").alias("at")).orderBy(F.desc("at")).limit(1).collect()
    before = load(spark, path, old[0].version) if old else spark.createDataFrame([], SCHEMA).drop("version", "scanned_at")
    return analysis.delta(before, analysis.fingerprints(current))
