"""DuckDB text of the schema analytics: the shop's schema as rows, and each operator over them in SQL of its own."""

from __future__ import annotations


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, list):
        return "[" + ", ".join(map(_literal, v)) + "]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)


def schema(rows: dict[str, list[tuple]], sizes: dict[str, str], prefix: str = "") -> str:
    """Common table expressions ``tabs``, ``cols``, ``idx`` and ``fks`` (names prefixed) for a shop's rows; row counts are counted."""
    tabs = " UNION ALL ".join(f"SELECT 'main' AS instance, 'shop' AS db, '{r[2]}' AS tab, (SELECT count(*) FROM {sizes[r[2]]}) AS row_count" for r in rows["tables"])
    return (
        f"{prefix}tabs AS ({tabs}),\n"
        f"{prefix}cols AS (SELECT * FROM (VALUES {_values(rows['columns'])}) t(instance, db, tab, position, col, type, nullable, dflt, is_primary)),\n"
        f"{prefix}idx AS (SELECT * FROM (VALUES {_values(rows['indexes'])}) t(instance, db, tab, idx, columns, is_unique)),\n"
        f"{prefix}fks AS (SELECT * FROM (VALUES {_values(rows['fks'])}) t(instance, db, tab, col, to_tab, to_col))"
    )


#: References by name, and those beside the declared ones.
REFS = """stems AS (SELECT c.*, CASE WHEN lower(col) LIKE '%\\_id' ESCAPE '\\' THEN regexp_replace(lower(col), '_id$', '') WHEN lower(col) LIKE '%id' AND length(col) > 2 THEN regexp_replace(lower(col), '[_-]*id$', '')
    WHEN lower(col) LIKE '%\\_fk' ESCAPE '\\' THEN regexp_replace(lower(col), '_fk$', '') END AS stem FROM cols c WHERE NOT is_primary AND NOT EXISTS (SELECT 1 FROM fks f WHERE f.tab = c.tab AND f.col = c.col)),
targets AS (SELECT tab, coalesce(min(CASE WHEN is_primary THEN lower(col) END), max(CASE WHEN lower(col) = 'id' THEN 'id' END)) AS key FROM cols GROUP BY tab),
inferred AS (SELECT s.tab AS from_tab, s.col AS from_col, t.tab AS to_tab, t.key AS to_col FROM stems s CROSS JOIN (VALUES (0, ''), (1, 's'), (2, 'es')) p(n, ending) JOIN targets t ON lower(t.tab) = s.stem || p.ending
    WHERE s.stem <> '' AND t.key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s.tab, s.col ORDER BY p.n, t.tab) = 1),
refs AS (SELECT tab AS from_tab, col AS from_col, to_tab, to_col, FALSE AS inferred FROM fks UNION ALL SELECT *, TRUE FROM inferred)"""

INFERRED = "SELECT 'main' AS from_instance, 'shop' AS from_db, from_tab AS from_table, from_col AS from_column, 'main' AS to_instance, 'shop' AS to_db, to_tab AS to_table, to_col AS to_column, TRUE AS inferred, 85 AS confidence FROM inferred"

#: The comment texts.
COMMENT = """SELECT tab AS "table", col AS "column", CASE WHEN lower(col) LIKE '%id' THEN '标识符' WHEN contains(lower(col), 'name') OR contains(lower(col), 'title') THEN '名称'
    WHEN contains(lower(col), 'time') OR contains(lower(col), 'date') THEN '时间' WHEN contains(lower(col), 'amount') OR contains(lower(col), 'price') OR contains(lower(col), 'total') THEN '金额/数量'
    WHEN contains(lower(col), 'status') OR contains(lower(col), 'state') THEN '状态' WHEN contains(lower(col), 'email') THEN '电子邮箱' ELSE '' END AS comment FROM cols"""

#: The cluster names.
CLUSTERS = """both_ways AS (SELECT from_tab AS a, to_tab AS b FROM refs UNION SELECT to_tab, from_tab FROM refs),
reach AS (SELECT tab AS a, tab AS b FROM tabs UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
roots AS (SELECT a AS tab, min(b) AS root FROM reach GROUP BY a),
named AS (SELECT root, string_agg('main/shop/' || tab, ',' ORDER BY tab) AS members, count(*) AS size, min(tab) AS first, list(tab) AS tabs FROM roots GROUP BY root),
raw AS (SELECT *, left(first, CAST((SELECT max(k) FROM range(0, 64) r(k) WHERE k <= length(first) AND len(list_distinct(list_transform(tabs, lambda t: left(t, k)))) = 1) AS INTEGER)) AS prefix FROM named),
cut AS (SELECT *, CASE WHEN regexp_matches(prefix, '[_-]$') THEN regexp_replace(prefix, '[_-]$', '') WHEN regexp_matches(prefix, '[_-]') THEN regexp_replace(prefix, '[_-][^_-]*$', '') ELSE prefix END AS short FROM raw)
SELECT 'main/shop/' || root AS root, members, size, CASE WHEN size = 1 THEN first WHEN short <> '' THEN short || '* cluster' ELSE size || '-table cluster' END AS name FROM cut"""

#: Scores of tables; write and query figures aren't known here, so their weights fall out.
SCORES = """ends AS (SELECT from_tab AS tab, 0 AS into_ FROM refs UNION ALL SELECT to_tab, 1 FROM refs),
degree AS (SELECT tab, count(*) AS degree, sum(into_) AS into_ FROM ends GROUP BY tab),
facts AS (SELECT t.tab, t.row_count, coalesce(d.degree, 0) AS degree, coalesce(d.into_, 0) AS into_, (SELECT count(*) FROM cols c WHERE c.tab = t.tab) AS n_columns, (SELECT count(*) FROM idx i WHERE i.tab = t.tab) AS n_indexes FROM tabs t LEFT JOIN degree d ON d.tab = t.tab),
factors AS (SELECT tab, degree / greatest((SELECT max(degree) FROM facts), 1) AS graph_degree, into_ / greatest((SELECT max(into_) FROM facts), 1) AS fk_centrality,
    CASE WHEN row_count <= 0 THEN 0.0 ELSE least(1.0, log10(row_count + 1.0) / log10(greatest((SELECT max(row_count) FROM facts), 1) + 1.0)) END AS rows_, least(1.0, n_indexes / n_columns) AS index_density FROM facts),
scores AS (SELECT *, round((0.30 * graph_degree + 0.30 * fk_centrality + 0.18 * rows_ + 0.07 * index_density) / 0.85 * 1000) / 1000 AS score FROM factors)"""
RANK = """SELECT 'main' AS instance, 'shop' AS db, tab AS "table", score, CAST(graph_degree AS DOUBLE) AS graph_degree, CAST(fk_centrality AS DOUBLE) AS fk_centrality, CAST(rows_ AS DOUBLE) AS row_count, CAST(index_density AS DOUBLE) AS index_density,
    CAST(0 AS DOUBLE) AS write_intensity, CAST(0 AS DOUBLE) AS query_frequency FROM scores"""
SUMMARY = """SELECT tab AS "table", score, (SELECT string_agg(col, ',' ORDER BY position) FROM cols c WHERE c.tab = s.tab) AS columns, coalesce((SELECT string_agg(DISTINCT to_tab, ',' ORDER BY to_tab) FROM refs r WHERE r.from_tab = s.tab), '') AS refers_to
FROM scores s ORDER BY score DESC, tab LIMIT 5"""

LINT = """by_table AS (SELECT tab, count(*) AS n, bool_or(is_primary) AS keyed, bool_or(regexp_matches(lower(col), 'created|updated|time')) AS timed FROM cols GROUP BY tab)
SELECT 'main' AS instance, 'shop' AS db, tab AS "table", 'info' AS severity, 'wide_table' AS rule, CAST(n AS VARCHAR) AS detail FROM by_table WHERE n > 30
UNION ALL SELECT 'main', 'shop', tab, 'warn', 'missing_primary_key', '' FROM by_table WHERE NOT keyed
UNION ALL SELECT DISTINCT 'main', 'shop', tab, 'warn', 'unindexed_foreign_key', lower(col) FROM fks f WHERE NOT EXISTS (SELECT 1 FROM idx i WHERE i.tab = f.tab AND list_contains(i.columns, f.col))
UNION ALL SELECT 'main', 'shop', tab, 'info', 'no_timestamp', '' FROM by_table WHERE n >= 3 AND NOT timed"""


def prints(prefix: str = "") -> str:
    """A common table expression of fingerprints."""
    digest = lambda what, table: f"coalesce((SELECT sha256(string_agg(x, '|' ORDER BY x)) FROM (SELECT lower({what}) AS x FROM {prefix}{table} k WHERE k.tab = t.tab)), sha256(''))"
    return (
        f"{prefix}prints AS (SELECT t.tab, {digest("concat_ws(':', col, type, CAST(nullable AS VARCHAR), CAST(is_primary AS VARCHAR))", 'cols')} AS col_hash,"
        f" {digest("concat_ws(':', idx, array_to_string(columns, ','), CAST(is_unique AS VARCHAR))", 'idx')} AS index_hash, {digest("concat_ws(':', col, to_tab, to_col)", 'fks')} AS fk_hash FROM {prefix}tabs t)"
    )


PRINTS = "SELECT 'main' AS instance, 'shop' AS db, tab AS \"table\", col_hash, index_hash, fk_hash FROM prints"
DELTA = """SELECT 'main' AS instance, 'shop' AS db, coalesce(a.tab, b.tab) AS "table", CASE WHEN a.tab IS NULL THEN 'added' WHEN b.tab IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a_prints a FULL JOIN b_prints b ON a.tab = b.tab WHERE a.tab IS NULL OR b.tab IS NULL OR (a.col_hash, a.index_hash, a.fk_hash) <> (b.col_hash, b.index_hash, b.fk_hash)"""
DIFF = """sides AS (SELECT coalesce(a.tab, b.tab) AS tab, lower(coalesce(a.col, b.col)) AS col, a.tab IS NULL AS added, b.tab IS NULL AS removed, lower(a.type) AS t1, lower(b.type) AS t2, CAST(a.nullable AS VARCHAR) AS n1, CAST(b.nullable AS VARCHAR) AS n2,
    CAST(a.dflt AS VARCHAR) AS d1, CAST(b.dflt AS VARCHAR) AS d2, CAST(a.is_primary AS VARCHAR) AS k1, CAST(b.is_primary AS VARCHAR) AS k2, CAST(a.position AS VARCHAR) AS p1, CAST(b.position AS VARCHAR) AS p2 FROM a_cols a FULL JOIN b_cols b ON a.tab = b.tab AND lower(a.col) = lower(b.col)),
fields AS (SELECT tab, col, added, removed, 'type' AS field, t1 AS old, t2 AS new FROM sides UNION ALL SELECT tab, col, added, removed, 'nullable', n1, n2 FROM sides UNION ALL SELECT tab, col, added, removed, 'default', d1, d2 FROM sides
    UNION ALL SELECT tab, col, added, removed, 'is_primary', k1, k2 FROM sides UNION ALL SELECT tab, col, added, removed, 'position', p1, p2 FROM sides)
SELECT 'main' AS instance, 'shop' AS db, tab AS "table", col AS "column", CASE WHEN added THEN 'added' WHEN removed THEN 'removed' ELSE 'changed' END AS change, field, old, new
FROM fields WHERE CASE WHEN added OR removed THEN field = 'type' ELSE old IS DISTINCT FROM new END"""
GRAPH = """SELECT DISTINCT 'main' AS a, 'main/shop' AS b, 'contains' AS kind FROM tabs UNION ALL SELECT DISTINCT 'main/shop', 'main/shop/' || tab, 'contains' FROM tabs
UNION ALL SELECT DISTINCT 'main/shop/' || tab, 'main/shop/' || tab || '/' || col, 'contains' FROM cols
UNION ALL SELECT 'main/shop/' || from_tab, 'main/shop/' || to_tab, CASE WHEN inferred THEN 'inferred_ref' ELSE 'declared_fk' END FROM refs"""
