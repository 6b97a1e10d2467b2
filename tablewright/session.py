"""Sessions and the tables of a folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from tablewright.plans.engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(master: str = "local[*]", **settings: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``settings`` override, dots written as double underscores."""
    conf = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.python.filterPushdown.enabled": "true", "spark.ui.enabled": "false"}
    conf |= {k.replace("__", "."): v for k, v in settings.items()}
    return SparkSession.builder.master(master).config(map=conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the cluster names in ``spark.checkpoint.dir``.

    Unset, it is a temporary folder of this machine if the session is a local one, and an error otherwise.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tablewright-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    """An engine over the tables of ``sf_dir``; nothing is read before a statement names it."""
    return Engine(spark, **options).register("main", {t: (lambda t=t: table(spark, sf_dir, t)) for t in TABLES})
