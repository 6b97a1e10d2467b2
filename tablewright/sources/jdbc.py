"""Database servers over Spark's JDBC reader, and Hive over Spark's own catalog. Drivers come with the cluster.

No server was reachable where this was written: addresses and options are tested, connections aren't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.sources.dsn import Dsn

#: Address patterns and driver classes of JDBC drivers.
DRIVERS = {
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver"),
    "starrocks": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver"),
    "postgres": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver"),
    "gaussdb": ("jdbc:opengauss://{host}:{port}/{database}", "org.opengauss.Driver"),
    "oracle": ("jdbc:oracle:thin:@//{host}:{port}/{database}", "oracle.jdbc.OracleDriver"),
    "clickhouse": ("jdbc:clickhouse://{host}:{port}/{database}", "com.clickhouse.jdbc.ClickHouseDriver"),
    "duckdb": ("jdbc:duckdb:{database}", "org.duckdb.DuckDBDriver"),
}
EXPLAIN = {"mysql": "EXPLAIN {sql}", "starrocks": "EXPLAIN {sql}", "postgres": "EXPLAIN {sql}", "gaussdb": "EXPLAIN {sql}", "sqlite": "EXPLAIN QUERY PLAN {sql}", "oracle": "EXPLAIN PLAN FOR {sql}", "clickhouse": "EXPLAIN {sql}", "hive": "EXPLAIN {sql}", "duckdb": "EXPLAIN {sql}"}


def options(dsn: Dsn) -> dict[str, str]:
    """Reader options for an address; fetches 10,000 rows at a time, pushes filters, aggregates and limits down."""
    url, driver = DRIVERS[dsn.kind]
    out = {"url": url.format(host=dsn.host, port=dsn.port, database=dsn.database), "driver": driver, "fetchsize": "10000", "pushDownPredicate": "true", "pushDownAggregate": "true", "pushDownLimit": "true", "pushDownOffset": "true"}
    if dsn.user:
        out |= {"user": dsn.user, "password": dsn.password}
    return out


def partitioning(column: str, low: int, high: int, n: int) -> dict[str, str]:
    """Options that read a table in ``n`` key ranges."""
    return {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(n)}


def limited(kind: str, sql: str, n: int) -> str:
    """A statement with the row limit in the server's own words."""
    return f"SELECT * FROM ({sql}) q FETCH FIRST {n} ROWS ONLY" if kind == "oracle" else f"SELECT * FROM ({sql}) q LIMIT {n}"


def read_table(spark: SparkSession, dsn: Dsn, table: str, **more: str) -> DataFrame:
    """A table of a server; with ``partitioning`` options several tasks read it."""
    if dsn.kind == "hive":
        return spark.table(f"{dsn.database}.{table}" if dsn.database else table)
    return spark.read.format("jdbc").options(**options(dsn), dbtable=table, **more).load()


def read_query(spark: SparkSession, dsn: Dsn, sql: str) -> DataFrame:
    """A read-only statement that the server runs itself, in its own dialect; Hive's runs here. EXPLAIN in Oracle takes two steps."""
    from tablewright.plans.guard import check_read_only
    from tablewright.plans.native import check_native

    if dsn.kind == "hive":
        check_read_only(spark, sql)
        return spark.sql(sql)
    check_native(sql)
    more = {}
    if dsn.kind == "oracle" and sql.split(None, 1)[0].upper() == "EXPLAIN":
        more, sql = {"sessionInitStatement": sql}, "SELECT plan_table_output FROM TABLE(dbms_xplan.display())"
    return spark.read.format("jdbc").options(**options(dsn), query=sql, **more).load()
