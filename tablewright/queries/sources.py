"""Queries across labelled sources: references, federation, policies and PromQL-shaped statements."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.plans import promql
from tablewright.plans.engine import Engine
from tablewright.plans.policy import Policy, PolicyError
from tablewright.session import TABLES, engine, shared_folder, table
from tablewright.sources import files


def _exported(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table written as CSV in the shared folder and read back as a delimited source."""
    base = shared_folder(spark)
    path = f"{base.rstrip('/')}/export-{uuid.uuid4().hex}"
    table(spark, sf_dir, name).write.option("header", True).csv(path)
    return files.read_delimited(spark, f"{path}/*.csv")


def _federation(spark: SparkSession, sf_dir: str) -> Engine:
    """Parquet tables under ``lake`` and ``store``, two of them as CSV under ``files``."""
    out = Engine(spark)
    for label, names in (("lake", TABLES[:4]), ("store", TABLES[4:8])):
        out.register(label, {t: (lambda t=t: table(spark, sf_dir, t)) for t in names})
    return out.register("files", {t: (lambda t=t: _exported(spark, sf_dir, t)) for t in ("nation", "region")})


def _over_sources(sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _federation(spark, sf_dir).query(sql)

    run.__doc__ = sql
    return run


def dsl_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each reference of a statement is bound to: label, table and number of columns."""
    from tablewright.plans.dialect import references

    e = _federation(spark, sf_dir)
    found = references("SELECT * FROM @lake.customer c JOIN @store.orders o ON c.c_custkey = o.o_custkey JOIN @lake.nation n ON TRUE WHERE c.c_name <> 'x@lake.region'")
    return spark.createDataFrame([(label, t, len(e.bind(label, t).columns)) for label, t in found], "label string, name string, width long")


def policy_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, rules=Policy(mask_columns=("customer.c_n*",))).query("SELECT c_custkey, c_name, c_mktsegment FROM customer")


def policy_mask_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked columns under other names, through expressions, a common table expression and a union."""
    sql = "WITH c AS (SELECT c_custkey, c_name AS x, upper(c_name) AS y FROM customer) SELECT c_custkey, x, y FROM c UNION ALL SELECT n_nationkey, 'nobody', n_name FROM nation"
    return engine(spark, sf_dir, rules=Policy(mask_columns=("customer.c_n*",))).query(sql)


def policy_deny_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which statements that go round the registered tables are refused: files by path, code, whatever isn't a read."""
    e = engine(spark, sf_dir, rules=Policy(deny_tables=("orders",)))
    statements = [f"SELECT count(*) AS n FROM parquet.`{sf_dir}/orders.parquet`", f"SELECT * FROM nation WHERE n_nationkey IN (SELECT o_custkey FROM parquet.`{sf_dir}/orders.parquet`)", "SELECT java_method('java.lang.System', 'getProperty', 'user.home') AS x", "SELECT TRANSFORM(n_name) USING 'cat' FROM nation", "EXECUTE IMMEDIATE 'SELECT 1'", "SELECT * FROM nation"]
    out = []
    for k, s in enumerate(statements):
        try:
            e.query(s)
            out.append((k, False))
        except PermissionError:
            out.append((k, True))
    return spark.createDataFrame(out, "statement int, denied boolean")


def _late_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as CSV whose status is a number in all rows but the last ones, read back with types."""
    late = F.when(F.col("o_orderkey") > 1400, F.concat(F.lit("A"), F.col("o_custkey"))).otherwise(F.col("o_custkey").cast("string"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", late.alias("code"), F.col("o_totalprice").alias("price"))
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    o.coalesce(1).orderBy("o_orderkey").write.option("header", True).csv(path)
    return files.read_delimited(spark, f"{path}/*.csv")


def policy_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, rules=Policy(deny_columns=("supplier.s_acctbal",))).query("SELECT * FROM (SELECT * FROM supplier) x")


def policy_deny_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of several statements a rule on orders denies, aliases and subqueries included."""
    e = engine(spark, sf_dir, rules=Policy(deny_tables=("orders",)))
    statements = ["SELECT * FROM nation", "SELECT * FROM orders o", "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", "WITH x AS (SELECT * FROM orders) SELECT * FROM x", "SELECT 'orders' AS word FROM region"]
    out = []
    for k, s in enumerate(statements):
        try:
            e.query(s)
            out.append((k, False))
        except PolicyError:
            out.append((k, True))
    return spark.createDataFrame(out, "statement int, denied boolean")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples of a metric: labels user and type, value."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("type"), "value")


def _promql(sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return promql.run_over(_samples(spark, sf_dir), promql.parse(sql))

    run.__doc__ = sql
    return run


def ir_where_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matchers of an AND chain."""
    found = promql.parse("SELECT value FROM events WHERE (type = 'view' AND user != '7') AND type LIKE 'v%'").where
    return spark.createDataFrame([(m.label, m.op, m.value) for m in found], "label string, op string, value string")


FEDERATED_JOIN = "SELECT n.n_name, count(*) AS customers FROM @lake.customer c JOIN @files.nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name"

FRAMES = {
    "join_cross_format": (_over_sources("SELECT s.s_name, n.n_name, r.r_name FROM @lake.supplier s JOIN @files.nation n ON s.s_nationkey = n.n_nationkey JOIN @files.region r ON n.n_regionkey = r.r_regionkey"), "SELECT s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "federated_join": (_over_sources(FEDERATED_JOIN), "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    "federated_union": (_over_sources("SELECT n_name AS name FROM @files.nation UNION SELECT r_name FROM @lake.region"), "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region"),
    "federated_agg": (_over_sources("SELECT n.n_name, sum(o.o_totalprice) AS total FROM @store.orders o JOIN @lake.customer c ON o.o_custkey = c.c_custkey JOIN @files.nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name"), "SELECT n_name, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    "federated_same_kind": (_over_sources("SELECT c.c_name, o.o_orderkey FROM @lake.customer c JOIN @store.orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 300000"), "SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000"),
    "dsl_single_source": (_over_sources("SELECT p_brand, count(*) AS n FROM @store.part WHERE p_name <> 'x@lake.region' GROUP BY p_brand"), "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand"),
    "dsl_bind": (dsl_bind, "SELECT * FROM (VALUES ('lake', 'customer', 5), ('store', 'orders', 6), ('lake', 'nation', 3)) t(label, name, width)"),
    "policy_mask": (policy_mask, "SELECT c_custkey, '***' AS c_name, c_mktsegment FROM customer"),
    "policy_mask_alias": (policy_mask_alias, "SELECT c_custkey, '***' AS x, '***' AS y FROM customer UNION ALL SELECT n_nationkey, '***', '***' FROM nation"),
    "policy_deny_path": (policy_deny_path, "SELECT * FROM (VALUES (0, TRUE), (1, TRUE), (2, TRUE), (3, TRUE), (4, TRUE), (5, FALSE)) t(statement, denied)"),
    "csv_late_cells": (_late_cells, "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN o_orderkey > 1400 THEN 'A' ELSE '' END || o_custkey AS code, o_totalprice AS price FROM orders"),
    "policy_strip": (policy_strip, "SELECT s_suppkey, s_name, s_nationkey FROM supplier"),
    "policy_deny_table": (policy_deny_table, "SELECT * FROM (VALUES (0, FALSE), (1, TRUE), (2, TRUE), (3, TRUE), (4, FALSE)) t(statement, denied)"),
    "promql_group_agg": (_promql("SELECT type, avg(value) FROM events GROUP BY type"), "SELECT event_type AS type, avg(value) AS value FROM events GROUP BY event_type"),
    "promql_label_filter": (_promql("SELECT user, value FROM events WHERE type = 'purchase' AND user LIKE '1%'"), "SELECT CAST(user_id AS VARCHAR) AS user, value FROM events WHERE event_type = 'purchase' AND CAST(user_id AS VARCHAR) LIKE '1%'"),
    "promql_order_limit": (_promql("SELECT user, sum(value) FROM events GROUP BY user ORDER BY user LIMIT 5 OFFSET 2"), "SELECT CAST(user_id AS VARCHAR) AS user, sum(value) AS value FROM events GROUP BY user_id ORDER BY 1 LIMIT 5 OFFSET 2"),
    "ir_where_flatten": (ir_where_flatten, "SELECT * FROM (VALUES ('type', '=', 'view'), ('user', '!=', '7'), ('type', '=~', 'v.*')) t(label, op, value)"),
}
