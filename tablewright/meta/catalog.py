"""Schema facts as DataFrames: tables, columns, indexes and foreign keys, keyed by instance, database and table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = "instance string, db string, table string, row_count long"
COLUMNS = "instance string, db string, table string, position int, column string, type string, nullable boolean, default string, is_primary boolean"
INDEXES = "instance string, db string, table string, index string, columns array<string>, is_unique boolean"
FKS = "instance string, db string, table string, column string, to_table string, to_column string"


@dataclass
class Catalog:
    tables: DataFrame
    columns: DataFrame
    indexes: DataFrame
    fks: DataFrame


def from_rows(spark: SparkSession, rows: dict[str, list[tuple]]) -> Catalog:
    """A catalog from collected rows (``sources.sqlite.collect`` and its like)."""
    return Catalog(*(spark.createDataFrame(rows.get(k, []), ddl) for k, ddl in (("tables", TABLES), ("columns", COLUMNS), ("indexes", INDEXES), ("fks", FKS))))


def from_frames(spark: SparkSession, frames: dict[str, DataFrame], instance: str = "main", db: str = "main", keys: dict[str, str] | None = None, counts: bool = False) -> Catalog:
    """The catalog of DataFrames; ``keys`` names their primary keys; row counts are taken only on demand."""
    keys = keys or {}
    columns = [(instance, db, t, k, f.name, f.dataType.simpleString(), f.nullable, None, keys.get(t) == f.name) for t, df in frames.items() for k, f in enumerate(df.schema)]
    tables = [(instance, db, t, df.count() if counts else 0) for t, df in frames.items()]
    return from_rows(spark, {"tables": tables, "columns": columns})
