"""Schema facts of database servers: what each kind is asked, and its answers as rows for the metadata tables.

A collector runs the four statements of a kind over a connection, any function from SQL to rows: Spark's JDBC reader by default.
Column order of the statements: tables (db, table, row count); columns (db, table, position, column, type, nullable, default,
is primary); indexes (db, table, index, column, position, unique); foreign keys (db, table, column, to table, to column).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewright.meta.collect import Rows
from tablewright.sources import files, jdbc, xlsx
from tablewright.sources.dsn import Dsn

_MYSQL = {
    "tables": "SELECT table_schema, table_name, coalesce(table_rows, 0) FROM information_schema.tables WHERE table_schema = '{db}'",
    "columns": "SELECT table_schema, table_name, ordinal_position - 1, column_name, column_type, is_nullable = 'YES', column_default, column_key = 'PRI' FROM information_schema.columns WHERE table_schema = '{db}'",
    "indexes": "SELECT table_schema, table_name, index_name, column_name, seq_in_index, non_unique = 0 FROM information_schema.statistics WHERE table_schema = '{db}'",
    "fks": "SELECT table_schema, table_name, column_name, referenced_table_name, referenced_column_name FROM information_schema.key_column_usage WHERE table_schema = '{db}' AND referenced_table_name IS NOT NULL",
}
_POSTGRES = {
    "tables": "SELECT n.nspname, c.relname, greatest(c.reltuples, 0)::bigint FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE c.relkind IN ('r', 'p', 'v', 'm') AND n.nspname NOT IN ('pg_catalog', 'information_schema')",
    "columns": "SELECT n.nspname, c.relname, a.attnum - 1, a.attname, format_type(a.atttypid, a.atttypmod), NOT a.attnotnull, pg_get_expr(d.adbin, d.adrelid), EXISTS (SELECT 1 FROM pg_index i WHERE i.indrelid = c.oid AND i.indisprimary AND a.attnum = ANY(i.indkey)) FROM pg_attribute a JOIN pg_class c ON c.oid = a.attrelid JOIN pg_namespace n ON n.oid = c.relnamespace LEFT JOIN pg_attrdef d ON d.adrelid = a.attrelid AND d.adnum = a.attnum WHERE a.attnum > 0 AND NOT a.attisdropped AND c.relkind IN ('r', 'p', 'v', 'm') AND n.nspname NOT IN ('pg_catalog', 'information_schema')",
    "indexes": "SELECT n.nspname, t.relname, x.relname, a.attname, array_position(i.indkey::int[], a.attnum::int), i.indisunique FROM pg_index i JOIN pg_class x ON x.oid = i.indexrelid JOIN pg_class t ON t.oid = i.indrelid JOIN pg_namespace n ON n.oid = t.relnamespace JOIN pg_attribute a ON a.attrelid = t.oid AND a.attnum = ANY(i.indkey) WHERE n.nspname NOT IN ('pg_catalog', 'information_schema')",
    "fks": "SELECT n.nspname, t.relname, a.attname, r.relname, b.attname FROM pg_constraint k JOIN pg_class t ON t.oid = k.conrelid JOIN pg_class r ON r.oid = k.confrelid JOIN pg_namespace n ON n.oid = t.relnamespace JOIN pg_attribute a ON a.attrelid = t.oid AND a.attnum = k.conkey[1] JOIN pg_attribute b ON b.attrelid = r.oid AND b.attnum = k.confkey[1] WHERE k.contype = 'f'",
}
#: The statements that read each kind's catalog; {db} is the database of the address, or the user for Oracle.
STATEMENTS: dict[str, dict[str, str]] = {
    "mysql": _MYSQL,
    "starrocks": {k: _MYSQL[k] for k in ("tables", "columns")},
    "postgres": _POSTGRES,
    "gaussdb": _POSTGRES,
    "oracle": {
        "tables": "SELECT owner, table_name, nvl(num_rows, 0) FROM all_tables WHERE owner = upper('{user}')",
        "columns": "SELECT c.owner, c.table_name, c.column_id - 1, c.column_name, c.data_type, CASE c.nullable WHEN 'Y' THEN 1 ELSE 0 END, NULL, CASE WHEN EXISTS (SELECT 1 FROM all_constraints k JOIN all_cons_columns q ON q.owner = k.owner AND q.constraint_name = k.constraint_name WHERE k.constraint_type = 'P' AND k.owner = c.owner AND k.table_name = c.table_name AND q.column_name = c.column_name) THEN 1 ELSE 0 END FROM all_tab_columns c WHERE c.owner = upper('{user}')",
        "indexes": "SELECT i.table_owner, i.table_name, i.index_name, c.column_name, c.column_position, CASE i.uniqueness WHEN 'UNIQUE' THEN 1 ELSE 0 END FROM all_indexes i JOIN all_ind_columns c ON c.index_owner = i.owner AND c.index_name = i.index_name WHERE i.table_owner = upper('{user}')",
        "fks": "SELECT k.owner, k.table_name, a.column_name, r.table_name, b.column_name FROM all_constraints k JOIN all_cons_columns a ON a.owner = k.owner AND a.constraint_name = k.constraint_name JOIN all_constraints r ON r.owner = k.r_owner AND r.constraint_name = k.r_constraint_name JOIN all_cons_columns b ON b.owner = r.owner AND b.constraint_name = r.constraint_name AND b.position = a.position WHERE k.constraint_type = 'R' AND k.owner = upper('{user}')",
    },
    "clickhouse": {
        "tables": "SELECT database, name, coalesce(total_rows, 0) FROM system.tables WHERE database = '{db}'",
        "columns": "SELECT database, table, position - 1, name, type, startsWith(type, 'Nullable'), default_expression, is_in_primary_key FROM system.columns WHERE database = '{db}'",
    },
    "duckdb": {
        "tables": "SELECT schema_name, table_name, estimated_size FROM duckdb_tables() UNION ALL SELECT schema_name, view_name, 0 FROM duckdb_views() WHERE NOT internal",
        "columns": "SELECT c.schema_name, c.table_name, c.column_index - 1, c.column_name, c.data_type, c.is_nullable, c.column_default, EXISTS (SELECT 1 FROM duckdb_constraints() k WHERE k.table_oid = c.table_oid AND k.constraint_type = 'PRIMARY KEY' AND list_contains(k.constraint_column_names, c.column_name)) FROM duckdb_columns() c WHERE NOT c.internal",
        "indexes": "SELECT schema_name, table_name, constraint_type || '_' || table_name || '_' || constraint_index, unnest(constraint_column_names), generate_subscripts(constraint_column_names, 1), TRUE FROM duckdb_constraints() WHERE constraint_type IN ('PRIMARY KEY', 'UNIQUE') UNION ALL SELECT schema_name, table_name, index_name, unnest(string_split(regexp_replace(expressions, '[\\[\\]'' \"]', '', 'g'), ',')), 1, is_unique FROM duckdb_indexes()",
        "fks": "SELECT schema_name, table_name, unnest(constraint_column_names), referenced_table, unnest(referenced_column_names) FROM duckdb_constraints() WHERE constraint_type = 'FOREIGN KEY'",
    },
}


def collect(dsn: Dsn, run: Callable[[str], list[tuple]]) -> Rows:
    """Rows for the metadata tables of a server; a statement that the kind doesn't have gives none."""
    out: Rows = {"tables": [], "columns": [], "indexes": [], "fks": []}
    asked = {k: run(sql.format(db=dsn.database.replace("'", "''"), user=dsn.user.replace("'", "''"))) for k, sql in STATEMENTS[dsn.kind].items()}
    label, text = dsn.label, lambda v: None if v is None else str(v)
    out["tables"] = [(label, db, t, int(n or 0)) for db, t, n in asked["tables"]]
    out["columns"] = [(label, db, t, int(at), name, kind, bool(nullable), text(default), bool(primary)) for db, t, at, name, kind, nullable, default, primary in asked["columns"]]
    indexes: dict[tuple, list[tuple[int, str]]] = {}
    for db, t, index, column, at, unique in asked.get("indexes", []):
        indexes.setdefault((db, t, index, bool(unique)), []).append((int(at or 0), column))
    out["indexes"] = [(label, db, t, index, [c for _, c in sorted(columns)], unique) for (db, t, index, unique), columns in sorted(indexes.items())]
    out["fks"] = [(label, *r) for r in asked.get("fks", [])]
    return out


def over_jdbc(spark: SparkSession, dsn: Dsn) -> Callable[[str], list[tuple]]:
    """A connection by Spark's JDBC reader; a catalog's rows are as many as its columns and come to the driver."""
    return lambda sql: [tuple(r) for r in spark.read.format("jdbc").options(**jdbc.options(dsn), query=sql).load().collect()]


def collect_hive(spark: SparkSession, database: str, label: str = "hive") -> Rows:
    """The tables of a database of Spark's catalog: columns, and row counts and storage facts where the catalog has them."""
    out: Rows = {"tables": [], "columns": []}
    for t in sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary):
        facts = described(spark, f"`{database}`.`{t}`")
        rows = facts.get("Statistics", "")
        out["tables"].append((label, database, t, int(rows.split(", ")[1].split()[0]) if ", " in rows else 0))
        for k, c in enumerate(spark.catalog.listColumns(f"`{database}`.`{t}`")):
            out["columns"].append((label, database, t, k, c.name, c.dataType, c.nullable, None, False))
    return out


def described(spark: SparkSession, table: str) -> dict[str, str]:
    """What DESCRIBE FORMATTED says of a table below its columns: location, format, statistics, partitions and so on."""
    out, below = {}, False
    for r in spark.sql(f"DESCRIBE FORMATTED {table}").collect():
        below |= r["col_name"].startswith("#")
        if below and r["col_name"] and not r["col_name"].startswith("#"):
            out[r["col_name"].rstrip(":")] = r["data_type"]
    return out


def collect_files(spark: SparkSession, dsn: Dsn) -> Rows:
    """A delimited file, or each sheet of a workbook, as a table: row count, columns and their types in the first rows."""
    frames: dict[str, DataFrame]
    if dsn.kind == "xlsx":
        frames = {s: xlsx.read_sheet(spark, dsn.database, s, typed=False) for s in xlsx.sheets(spark, dsn.database)}
    else:
        frames = {dsn.label: files.read_delimited(spark, dsn.database, dsn.options.get("delimiter", ""), dsn.options.get("encoding", ""), typed=False)}
    out: Rows = {"tables": [], "columns": []}
    for t, df in frames.items():
        out["tables"].append((dsn.label, dsn.kind, t, df.count()))
        out["columns"] += [(dsn.label, dsn.kind, t, k, c, kind, True, None, False) for k, (c, kind) in enumerate(files.sampled_types(df).items())]
    return out
