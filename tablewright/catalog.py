"""All registered queries: a Spark callable and, beside it, the SQL that DuckDB runs over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewright import session
from tablewright.queries import metadata, relational, sources


def _statement(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return session.engine(spark, sf_dir).query(sql)

    run.__doc__ = sql
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _statement(sql) for name, (sql, _) in relational.STATEMENTS.items()}
    return out | {name: f for name, (f, _) in (relational.FRAMES | sources.FRAMES | metadata.FRAMES).items()}


def oracle_sql() -> dict[str, str]:
    out = {name: own or sql for name, (sql, own) in relational.STATEMENTS.items()}
    return out | {name: sql for name, (_, sql) in (relational.FRAMES | sources.FRAMES | metadata.FRAMES).items() if sql}
