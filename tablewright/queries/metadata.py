"""Queries over the tables' own schemas, and over keys and samples made from table columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import scalars
from tablewright.meta import analysis
from tablewright.meta.catalog import Catalog, from_rows
from tablewright.queries import schema_sql
from tablewright.session import shared_folder, table

#: The shop whose schema is analysed: columns (first one the primary key), indexed columns and declared keys.
SHOP = {
    "users": (["id", "name", "email", "created_at"], ["id"], []),
    "orders": (["id", "user_id", "total", "status", "created_at"], ["id", "user_id"], [("user_id", "users", "id")]),
    "order_items": (["id", "order_id", "product_id", "amount"], ["id"], [("order_id", "orders", "id")]),
    "products": (["id", "title", "price", "category_id"], ["id"], []),
    "categories": (["id", "name"], [], []),
    "category": (["id", "label", "parent_id"], [], []),
    "log_lines": (["message", "level", "host"], [], []),
}


#: The table of ``sf_dir`` whose size each of the shop's tables has.
SIZES = dict(zip(SHOP, ("customer", "orders", "lineitem", "part", "region", "nation", "events"), strict=True))


def _shop_rows(without: str = "", extra: bool = False) -> dict[str, list[tuple]]:
    """The shop's schema as rows, without row counts."""
    rows: dict[str, list[tuple]] = {"tables": [], "columns": [], "indexes": [], "fks": []}
    for t, (columns, indexed, keys) in SHOP.items():
        if t == without:
            continue
        rows["tables"].append(("main", "shop", t))
        columns = [*columns, "note"] if extra and t == "users" else columns
        for k, c in enumerate(columns):
            kind = "bigint" if c.endswith("id") else "double" if c in ("total", "price", "amount") else "text"
            rows["columns"].append(("main", "shop", t, k, c, "int" if extra and c == "status" else kind, c != "id", None, c == "id"))
        rows["indexes"] += [("main", "shop", t, f"ix_{t}_{c}", [c], c == "id") for c in indexed]
        rows["fks"] += [("main", "shop", t, c, to, to_column) for c, to, to_column in keys]
    return rows


def _shop(spark: SparkSession, sf_dir: str, without: str = "", extra: bool = False, counted: bool = False) -> Catalog:
    """The shop's catalog; ``counted``: with the row counts of tables in ``sf_dir``."""
    rows = _shop_rows(without, extra)
    rows["tables"] = [(*r, table(spark, sf_dir, SIZES[r[2]]).count() if counted else 0) for r in rows["tables"]]
    return from_rows(spark, rows)


def meta_infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types inferred from columns that were turned into text."""
    df = table(spark, sf_dir, "lineitem")
    names = ["l_orderkey", "l_quantity", "l_returnflag", "l_shipdate"]
    text = df.select(*(F.date_format(c, "yyyy-MM-dd").alias(c) if c == "l_shipdate" else F.col(c).cast("string") for c in names))
    wide = text.agg(*(scalars.inferred_type(F.col(c)).alias(c) for c in names))
    return wide.unpivot([], names, "column", "type")


def meta_infer_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _shop(spark, sf_dir).columns
    return c.select("table", "column", scalars.inferred_comment(F.col("column"), F.col("type"), F.lit("")).alias("comment"))


def meta_infer_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.infer_refs(_shop(spark, sf_dir))


def meta_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    _checkpoints(spark)
    c = _shop(spark, sf_dir)
    return analysis.clusters(c, analysis.all_refs(c)).select("root", F.array_join("members", ",").alias("members"), "size", "name")


def meta_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _shop(spark, sf_dir, counted=True)
    return analysis.rank(c, analysis.all_refs(c))


def meta_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.lint(_shop(spark, sf_dir))


def meta_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.fingerprints(_shop(spark, sf_dir))


def meta_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _shop(spark, sf_dir, without="log_lines"), _shop(spark, sf_dir, without="category", extra=True)
    return analysis.delta(analysis.fingerprints(before), analysis.fingerprints(after))


def meta_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.diff_columns(_shop(spark, sf_dir), _shop(spark, sf_dir, extra=True))


def meta_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _shop(spark, sf_dir)
    return analysis.graph(c, analysis.all_refs(c))[1]


def meta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _shop(spark, sf_dir, counted=True)
    return analysis.summary(c, analysis.all_refs(c), top=5).select("table", "score", F.array_join("columns", ",").alias("columns"), F.array_join("refers_to", ",").alias("refers_to"))


def _trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A graph in the data: customers and suppliers of a nation are linked to it, nations to their region."""
    c, s, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    links = c.where("c_acctbal > 0").select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("n"), "c_nationkey").alias("b")).unionByName(s.where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("a"), F.concat(F.lit("n"), "s_nationkey").alias("b"))).unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b")))
    nodes = c.select(F.concat(F.lit("c"), "c_custkey").alias("node")).unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("node"))).unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("node"))).unionByName(n.select(F.concat(F.lit("r"), "n_regionkey").alias("node")).distinct())
    return nodes, links


TRADE_SQL = """WITH links AS (
  SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer WHERE c_acctbal > 0
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier WHERE s_acctbal > 0
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
nodes AS (SELECT 'c' || c_custkey AS node FROM customer UNION SELECT 's' || s_suppkey FROM supplier
  UNION SELECT 'n' || n_nationkey FROM nation UNION SELECT 'r' || n_regionkey FROM nation),
both_ways AS (SELECT a AS node, b AS neighbor FROM links UNION SELECT b, a FROM links)
"""


def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.degrees(*_trade(spark, sf_dir))


def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.neighbors(_trade(spark, sf_dir)[1])


def graph_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.isolated(*_trade(spark, sf_dir))


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    _checkpoints(spark)
    return analysis.components(*_trade(spark, sf_dir))


def _checkpoints(spark: SparkSession) -> None:
    """The folder that ``checkpoint()`` writes to: the shared one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def key_family_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys made from events, grouped by family."""
    keys = table(spark, sf_dir, "events").select(F.concat(F.lit("user:"), "user_id", F.lit(":"), "event_type").alias("key"))
    return analysis.key_families(keys)


def value_type_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many event values are of each type, as text and as properties."""
    e = table(spark, sf_dir, "events")
    values = e.select(F.col("user_id").cast("string").alias("v")).unionByName(e.select(F.col("event_type").alias("v"))).unionByName(e.select(F.col("props").alias("v"))).unionByName(e.select(F.concat(F.floor("value").cast("string"), F.lit(".5")).alias("v")))
    return values.groupBy(scalars.value_type(F.col("v")).alias("type")).agg(F.count("*").alias("n"))


KEY_SQL = r"""SELECT pattern, count(*) AS n, min(key) AS example FROM (
  SELECT key, regexp_replace(regexp_replace(key, '[0-9a-fA-F]{8,}', '{hex}', 'g'), '\d{2,}', '{id}', 'g') AS pattern
  FROM (SELECT 'user:' || user_id || ':' || event_type AS key FROM events)) GROUP BY pattern"""
COMPONENT_SQL = (
    TRADE_SQL.replace("WITH ", "WITH RECURSIVE ").rstrip()
    + """, up AS (SELECT node, CASE WHEN node LIKE 'r%' THEN node WHEN node LIKE 'n%' THEN (SELECT b FROM links WHERE a = node) ELSE
  (SELECT l2.b FROM links l1 JOIN links l2 ON l1.b = l2.a WHERE l1.a = nodes.node) END AS region FROM nodes)
SELECT node, CASE WHEN region IS NULL THEN node ELSE min(node) OVER (PARTITION BY region) END AS root FROM up"""
)
KIND_SQL = r"""SELECT '{c}' AS "column", CASE WHEN bool_and(regexp_full_match({text}, '[+-]?\d+')) THEN 'INTEGER' WHEN bool_and(TRY_CAST({text} AS DOUBLE) IS NOT NULL) THEN 'FLOAT'
  WHEN bool_and(TRY_CAST({text} AS DATE) IS NOT NULL) THEN 'DATE' ELSE 'TEXT' END AS "type" FROM lineitem"""
INFER_SQL = " UNION ALL ".join(KIND_SQL.format(c=c, text=f"strftime({c}, '%Y-%m-%d')" if c == "l_shipdate" else f"CAST({c} AS VARCHAR)") for c in ("l_orderkey", "l_quantity", "l_returnflag", "l_shipdate"))
VALUE_SQL = r"""SELECT CASE WHEN regexp_full_match(v, '[+-]?\d+') AND TRY_CAST(v AS BIGINT) IS NOT NULL THEN 'integer' WHEN regexp_full_match(v, '[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?') THEN 'float'
  WHEN regexp_matches(v, '^\s*[\{\[]') THEN 'json' ELSE 'string' END AS type, count(*) AS n FROM (
  SELECT CAST(user_id AS VARCHAR) AS v FROM events UNION ALL SELECT event_type FROM events UNION ALL SELECT props FROM events UNION ALL SELECT CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '.5' FROM events) GROUP BY 1"""


def _sql(*parts: str) -> str:
    """Operators of ``schema_sql`` over the shop; the last part is the query."""
    *ctes, query = [schema_sql.schema(_shop_rows(), SIZES), *parts]
    return f"WITH RECURSIVE {', '.join(ctes)}{'' if query.startswith('SELECT') else ', '} {query}"


def _two(before: dict, after: dict, *parts: str) -> str:
    """The same over two versions of the shop, a_ and b_."""
    *ctes, query = [schema_sql.schema(before, SIZES, "a_"), schema_sql.schema(after, SIZES, "b_"), *parts]
    return f"WITH {', '.join(ctes)}{'' if query.startswith('SELECT') else ', '} {query}"


FRAMES = {
    "meta_infer_types": (meta_infer_types, INFER_SQL),
    "meta_infer_comment": (meta_infer_comment, _sql(schema_sql.COMMENT)),
    "meta_infer_refs": (meta_infer_refs, _sql(schema_sql.REFS, schema_sql.INFERRED)),
    "meta_clusters": (meta_clusters, _sql(schema_sql.REFS, schema_sql.CLUSTERS)),
    "meta_rank": (meta_rank, _sql(schema_sql.REFS, schema_sql.SCORES, schema_sql.RANK)),
    "meta_lint": (meta_lint, _sql(schema_sql.LINT)),
    "meta_fingerprint": (meta_fingerprint, _sql(schema_sql.prints(), schema_sql.PRINTS)),
    "meta_delta": (meta_delta, _two(_shop_rows("log_lines"), _shop_rows("category", True), schema_sql.prints("a_"), schema_sql.prints("b_"), schema_sql.DELTA)),
    "meta_diff": (meta_diff, _two(_shop_rows(), _shop_rows(extra=True), schema_sql.DIFF)),
    "meta_graph": (meta_graph, _sql(schema_sql.REFS, schema_sql.GRAPH)),
    "meta_summary": (meta_summary, _sql(schema_sql.REFS, schema_sql.SCORES, schema_sql.SUMMARY)),
    "graph_degree": (graph_degree, TRADE_SQL + "SELECT n.node, count(x.a) AS degree FROM nodes n LEFT JOIN (SELECT a AS a FROM links UNION ALL SELECT b FROM links) x ON n.node = x.a GROUP BY n.node"),
    "graph_neighbors": (graph_neighbors, TRADE_SQL + "SELECT node, neighbor FROM both_ways"),
    "graph_isolated": (graph_isolated, TRADE_SQL + "SELECT node FROM nodes WHERE node NOT IN (SELECT node FROM both_ways)"),
    "graph_components": (graph_components, COMPONENT_SQL),
    "key_family_group": (key_family_group, KEY_SQL),
    "value_type_infer": (value_type_infer, VALUE_SQL),
}
