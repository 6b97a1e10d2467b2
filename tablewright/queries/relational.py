"""Statements in the file dialect, each with the DuckDB text where that differs, and queries written with DataFrame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import scalars
from tablewright.operators import relational as ops
from tablewright.session import table

#: name: (dialect text, DuckDB text or "" where it is the same).
STATEMENTS: dict[str, tuple[str, str]] = {
    # scalars, projection, filters
    "scan_select_star": ("SELECT * FROM nation", ""),
    "project_columns": ("SELECT n_name, n_regionkey FROM nation", ""),
    "project_expr": ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity + 1 AS more FROM lineitem", ""),
    "arith_expr": ("SELECT l_orderkey, l_linenumber, -l_quantity AS negated, l_quantity - l_tax AS minus, l_extendedprice / l_quantity AS unit, (l_quantity + 2) * 3 AS scaled FROM lineitem WHERE l_quantity > 0", ""),
    "filter_cmp": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.03 AND l_returnflag <> 'N'", ""),
    "filter_eq_literal": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'", ""),
    "filter_and_or": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' OR o_orderpriority = '1-URGENT' AND o_totalprice > 100000", ""),
    "filter_not": ("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 50000)", ""),
    "filter_like": ("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%small%'", "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%small%'"),
    "filter_not_like": ("SELECT p_partkey FROM part WHERE p_name NOT LIKE '%1%'", "SELECT p_partkey FROM part WHERE p_name NOT ILIKE '%1%'"),
    "filter_between": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12", ""),
    "filter_not_between": ("SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45", ""),
    "filter_in_list": ("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')", ""),
    "filter_not_in_list": ("SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')", ""),
    "filter_is_null": ("SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'O') IS NULL", ""),
    "filter_is_not_null": ("SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'O') IS NOT NULL", ""),
    "fn_abs": ("SELECT c_custkey, abs(c_acctbal) AS size FROM customer", ""),
    "fn_round": ("SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * l_discount, 2) AS amount FROM lineitem", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount * 100) / 100 AS amount FROM lineitem"),
    "fn_cast_float": ("SELECT p_partkey, CAST(p_size AS FLOAT) / 7 AS weeks, CAST(p_name AS FLOAT) AS nothing FROM part", "SELECT p_partkey, CAST(p_size AS DOUBLE) / 7 AS weeks, TRY_CAST(p_name AS DOUBLE) AS nothing FROM part"),
    "fn_cast_int": ("SELECT p_partkey, CAST(CAST(p_size AS TEXT) AS BIGINT) AS size, CAST(p_brand AS BIGINT) AS nothing FROM part", "SELECT p_partkey, CAST(p_size AS BIGINT) AS size, TRY_CAST(p_brand AS BIGINT) AS nothing FROM part"),
    "fn_cast_text": ("SELECT p_partkey, CAST(p_size AS TEXT) AS size FROM part", ""),
    # joins
    "join_inner": ("SELECT c.c_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 200000", ""),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000", ""),
    "join_right": ("SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'", ""),
    "join_multi": ("SELECT r.r_name, n.n_name, count(*) AS suppliers FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name", ""),
    "join_theta": ("SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey < r.r_regionkey", ""),
    "join_compound": ("SELECT s.s_suppkey, c.c_custkey FROM supplier s JOIN customer c ON s.s_nationkey = c.c_nationkey AND s.s_acctbal < c.c_acctbal", ""),
    "join_left_theta": ("SELECT r.r_name, n.n_name FROM region r LEFT JOIN nation n ON n.n_regionkey > r.r_regionkey + 2", ""),
    "semi_in_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)", ""),
    # aggregates
    "agg_group_by": ("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", ""),
    "agg_global": ("SELECT count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders", ""),
    "agg_empty_input": ("SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_totalprice < 0", ""),
    "agg_count_star": ("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus", ""),
    "agg_count_col": ("SELECT o_orderpriority, count(*) AS n_all, count(nullif(o_orderstatus, 'O')) AS n_not_open FROM orders GROUP BY o_orderpriority", ""),
    "agg_sum": ("SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey", ""),
    "agg_avg": ("SELECT o_orderpriority, avg(o_totalprice) AS mean FROM orders GROUP BY o_orderpriority", ""),
    "agg_min_max": ("SELECT p_brand, min(p_type) AS first_type, max(p_type) AS last_type, min(p_retailprice) AS least, max(p_size) AS largest FROM part GROUP BY p_brand", ""),
    "agg_count_distinct": ("SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY c_mktsegment", ""),
    "agg_having_alias": ("SELECT o_custkey, avg(o_totalprice) AS mean FROM orders GROUP BY o_custkey HAVING mean > 150000", ""),
    "agg_having_func": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12", ""),
    "agg_expr_over_agg": ("SELECT o_orderstatus, sum(o_totalprice) / count(*) AS mean, ROUND(avg(o_totalprice), 2) AS rounded FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, sum(o_totalprice) / count(*) AS mean, round(avg(o_totalprice) * 100) / 100 AS rounded FROM orders GROUP BY o_orderstatus"),
    "agg_of_expr": ("SELECT l_returnflag, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY l_returnflag", ""),
    "agg_order_by": ("SELECT o_orderpriority, avg(o_totalprice) AS avg_price FROM orders GROUP BY o_orderpriority HAVING avg_price > 0 ORDER BY avg_price DESC", ""),
    "agg_order_limit": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 5 OFFSET 2", ""),
    "group_by_no_agg": ("SELECT n_regionkey FROM nation GROUP BY n_regionkey", ""),
    "agg_first_value": ("SELECT n_regionkey, r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey", "SELECT n_regionkey, r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey, r_name"),
    # windows
    "win_row_number": ("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS place FROM orders", ""),
    "win_rank": ("SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS place FROM part", ""),
    "win_dense_rank": ("SELECT p_partkey, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS place FROM part", ""),
    "win_ntile": ("SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS BIGINT) AS quarter FROM customer", ""),
    "win_lag": ("SELECT o_orderkey, lag(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders", ""),
    "win_lead": ("SELECT o_orderkey, lead(o_totalprice, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders", ""),
    "win_lag_default": ("SELECT o_orderkey, lag(o_totalprice, 1, CAST(0 AS DOUBLE)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders", ""),
    "win_first_value": ("SELECT event_id, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_type FROM events", ""),
    "win_last_value": ("SELECT event_id, last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last_type FROM events", ""),
    "win_total": ("SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS total FROM orders", ""),
    "win_running_sum": ("SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS running FROM orders", "SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM orders"),
    "win_rows_sliding": ("SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS recent FROM events", ""),
    "win_rows_following": ("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS coming FROM events", ""),
    "win_range": ("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_quantity RANGE BETWEEN 5.0 PRECEDING AND 5.0 FOLLOWING) AS near FROM lineitem", ""),
    # sorts and limits
    "sort_asc": ("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 20", ""),
    "sort_desc": ("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 20", ""),
    "sort_alias": ("SELECT s_suppkey, s_acctbal * 2 AS twice FROM supplier ORDER BY twice, s_suppkey LIMIT 7", ""),
    "sort_multi": ("SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment DESC, c_nationkey, c_custkey LIMIT 25", ""),
    "sort_nulls_default": ("SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status FROM orders ORDER BY status DESC, o_orderkey LIMIT 30", "SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status FROM orders ORDER BY status DESC NULLS FIRST, o_orderkey LIMIT 30"),
    "sort_nulls_first": ("SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status FROM orders ORDER BY status NULLS FIRST, o_orderkey LIMIT 30", ""),
    "sort_nulls_last": ("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders ORDER BY status DESC NULLS LAST, o_orderkey LIMIT 30", ""),
    "limit": ("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 3", ""),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25", ""),
    "top_k": ("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10", ""),
    # sets
    "union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", ""),
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", ""),
    "union_cross_source": ("SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation WHERE n_regionkey = 1", ""),
    "distinct_on": ("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey", ""),
    "select_distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", ""),
    "where_error": ("SELECT c_custkey FROM customer WHERE 1 / (c_custkey - 1) > 0.01", "SELECT c_custkey FROM customer WHERE 1 / nullif(c_custkey - 1, 0) > 0.01"),
    "where_misfit": ("SELECT n_name FROM nation WHERE n_name > 5 OR n_nationkey = 3", "SELECT n_name FROM nation WHERE coalesce(TRY_CAST(n_name AS DOUBLE) > 5, FALSE) OR n_nationkey = 3"),
    "plus_text": ("SELECT n_nationkey, n_name + '-' + n_name AS twice, (n_name + '!') AS shout, n_nationkey + 1 AS more FROM nation", "SELECT n_nationkey, n_name || '-' || n_name AS twice, n_name || '!' AS shout, n_nationkey + 1 AS more FROM nation"),
    "not_in_null": ("SELECT n_name FROM nation WHERE n_regionkey NOT IN (SELECT nullif(r_regionkey, 2) FROM region WHERE r_regionkey > 0)", "SELECT n_name FROM nation WHERE n_regionkey IN (0, 2)"),
    # additions: what Spark has beside the dialect
    "extra_intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", ""),
    "extra_except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000", ""),
    "extra_rollup": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", ""),
    "extra_case": ("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS class FROM part", ""),
    "extra_full_join": ("SELECT s.s_suppkey, n.n_nationkey FROM supplier s FULL JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000", ""),
}


def anti_not_in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a large order; a null key among the orders would hide nobody."""
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 250000")
    return ops.anti(table(spark, sf_dir, "customer"), orders, "c_custkey", "o_custkey").select("c_custkey")


def win_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.over_partition(table(spark, sf_dir, "orders"), ["o_custkey"], total=F.sum("o_totalprice")).select("o_orderkey", "total")


def win_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.over_partition(table(spark, sf_dir, "events"), ["event_type"], mean=F.avg("value")).select("event_id", "mean")


def win_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.over_partition(table(spark, sf_dir, "events"), ["user_id"], n=F.count(F.nullif("event_type", F.lit("view")))).select("event_id", "n")


def win_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.over_partition(table(spark, sf_dir, "orders"), ["o_custkey"], least=F.min("o_totalprice"), most=F.max("o_totalprice")).select("o_orderkey", "least", "most")


def agg_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that isn't grouped, taken from the group's first row in an order of its own."""
    first = F.min_by("o_orderpriority", "o_orderkey")
    return ops.group(table(spark, sf_dir, "orders"), ["o_custkey"], n=F.count("*"), first_priority=first)


def scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of one table in key order."""
    return ops.page(ops.sort(table(spark, sf_dir, "part"), "p_partkey"), 12, 5).select("p_partkey", "p_name")


def auto_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows come back of a statement without a limit: the cap on the outermost result."""
    from tablewright import session

    result = session.engine(spark, sf_dir, max_rows=100).execute("SELECT o_orderkey FROM orders")
    return spark.createDataFrame([(result.row_count, result.truncated)], "row_count long, truncated boolean")


def fn_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names wrapped in terminal escapes, cleaned."""
    dirty = F.concat(F.lit("\x1b[31m"), F.col("n_name"), F.lit("\x07\x1b[0m"))
    return table(spark, sf_dir, "nation").select("n_nationkey", scalars.sanitize(dirty).alias("clean"))


FRAMES = {
    "anti_not_in_subquery": (anti_not_in_subquery, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)"),
    "win_sum": (win_sum, "SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS total FROM orders"),
    "win_avg": (win_avg, "SELECT event_id, avg(value) OVER (PARTITION BY event_type) AS mean FROM events"),
    "win_count": (win_count, "SELECT event_id, count(nullif(event_type, 'view')) OVER (PARTITION BY user_id) AS n FROM events"),
    "win_min_max": (win_min_max, "SELECT o_orderkey, min(o_totalprice) OVER (PARTITION BY o_custkey) AS least, max(o_totalprice) OVER (PARTITION BY o_custkey) AS most FROM orders"),
    "agg_first_row": (agg_first_row, "SELECT o_custkey, count(*) AS n, arg_min(o_orderpriority, o_orderkey) AS first_priority FROM orders GROUP BY o_custkey"),
    "scan_limit": (scan_limit, "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 12 OFFSET 5"),
    "auto_limit": (auto_limit, "SELECT least(count(*), 100) AS row_count, count(*) > 100 AS truncated FROM orders"),
    "fn_sanitize": (fn_sanitize, "SELECT n_nationkey, n_name AS clean FROM nation"),
}
