"""SQLite files through a Python data source: key ranges are read in parallel, filters go down, and the catalog is read too."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def spark_type(declared: str) -> T.DataType:
    """SQLite's affinity rules, in its order."""
    d = (declared or "").upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if not d or "BLOB" in d:
        return T.BinaryType() if d else T.StringType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUMERIC", "DEC")):
        return T.DoubleType()
    return T.StringType()


class Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, options
        self.where: list[str] = []
        self.values: list = []

    def partitions(self) -> list[Range]:
        n = int(self.options.get("partitions", "4"))
        with _connect(self.options["path"]) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.options['table'])}").fetchone()
            except sqlite3.OperationalError:  # a view, or a table without row ids
                return [Range(None, None)]
        if low is None:
            return [Range(None, None)]
        step = (high - low) // n + 1
        return [Range(low + k * step, low + (k + 1) * step) for k in range(n) if low + k * step <= high]

    def read(self, partition: Range) -> Iterator[tuple]:
        where, values = list(self.where), list(self.values)
        if partition.low is not None:
            where.append("rowid >= ? AND rowid < ?")
            values += [partition.low, partition.high]
        columns = ", ".join(_quoted(f.name) for f in self.schema)
        make = [{T.LongType: int, T.DoubleType: float, T.StringType: str}.get(type(f.dataType), bytes) for f in self.schema]
        with _connect(self.options["path"]) as db:
            cursor = db.execute(f"SELECT {columns} FROM {_quoted(self.options['table'])}" + (f" WHERE {' AND '.join(where)}" if where else ""), values)
            for row in cursor:
                yield tuple(None if v is None else m(v) if m is not bytes or not isinstance(v, str) else v.encode() for m, v in zip(make, row, strict=True))


class FilteringReader(Reader):
    """Filters are SQLite's; only where Spark's setting allows a reader that takes them."""

    COMPARE = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = _quoted(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if name and type(f) in self.COMPARE and isinstance(f.value, (int, float, str)):
                self.where.append(f"{name} {self.COMPARE[type(f)]} ?")
                self.values.append(f.value)
            elif name and isinstance(f, In) and all(isinstance(v, (int, float, str)) for v in f.value):
                self.where.append(f"{name} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif name and isinstance(f, (IsNull, IsNotNull)):
                self.where.append(f"{name} IS {'NOT ' * isinstance(f, IsNotNull)}NULL")
            else:
                yield f


class SqliteSource(DataSource):
    """Options: path, table, partitions, filters (whether they go down)."""

    @classmethod
    def name(cls) -> str:
        return "tablewright_sqlite"

    def schema(self) -> T.StructType:
        with _connect(self.options["path"]) as db:
            rows = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not rows:
            raise LookupError(f"no table {self.options['table']}")
        return T.StructType([T.StructField(r[1], spark_type(r[2])) for r in rows])

    def reader(self, schema: T.StructType) -> Reader:
        return (FilteringReader if self.options.get("filters") == "true" else Reader)(schema, self.options)


def read_table(spark: SparkSession, path: str, table: str, partitions: int = 4) -> DataFrame:
    """A table of a SQLite file that all executors can open. Filters go down where ``spark.sql.python.filterPushdown.enabled``."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("tablewright_sqlite").options(path=path, table=table, partitions=str(partitions), filters=spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).load()


def read_query(spark: SparkSession, path: str, sql: str) -> DataFrame:
    """A read-only statement that SQLite runs itself, on one executor task; a column is of numbers if all its cells are, else of text."""
    from tablewright.plans.native import check_native

    check_native(sql)
    with _connect(path) as db:
        names = [d[0] for d in db.execute(sql).description]
        try:
            found = db.execute(f"SELECT {', '.join(f'group_concat(DISTINCT typeof({_quoted(n)}))' for n in names)} FROM ({sql})").fetchone()
        except sqlite3.OperationalError:  # PRAGMA, EXPLAIN
            found = [None] * len(names)
    whole = {"integer": T.LongType(), "real": T.DoubleType()}
    seen = [set((x or "text").split(",")) - {"null"} for x in found]
    kinds = [whole.get(next(iter(x)), T.StringType()) if len(x) == 1 else T.DoubleType() if x == {"integer", "real"} else T.StringType() for x in seen]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            with _connect(path) as db:
                cursor = db.execute(sql)
                while rows := cursor.fetchmany(1000):
                    columns = []
                    for k, kind in enumerate(kinds):
                        cells = [r[k] for r in rows]
                        if isinstance(kind, T.LongType):
                            columns.append(pa.array(cells, pa.int64()))
                        else:
                            columns.append(pa.array([None if v is None else float(v) for v in cells], pa.float64()) if isinstance(kind, T.DoubleType) else pa.array([None if v is None else str(v) for v in cells], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(names))])

    schema = T.StructType([T.StructField(f"c{k}", kind) for k, kind in enumerate(kinds)])
    return spark.range(0, 1, 1, 1).mapInArrow(run, schema).toDF(*names)


def tables(path: str) -> list[str]:
    with _connect(path) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def collect(path: str, label: str = "sqlite") -> dict[str, list[tuple]]:
    """Rows for the metadata tables: columns, indexes and foreign keys."""
    out: dict[str, list[tuple]] = {"tables": [], "columns": [], "indexes": [], "fks": []}
    with _connect(path) as db:
        for t in tables(path):
            n = db.execute(f"SELECT count(*) FROM {_quoted(t)}").fetchone()[0]
            out["tables"].append((label, "main", t, n))
            for at, name, kind, not_null, default, key in db.execute(f"PRAGMA table_info({_quoted(t)})"):
                out["columns"].append((label, "main", t, at, name, kind, not not_null, default, key > 0))
            for _, index, unique, *_ in db.execute(f"PRAGMA index_list({_quoted(t)})").fetchall():
                names = [r[2] for r in db.execute(f"PRAGMA index_info({_quoted(index)})")]
                out["indexes"].append((label, "main", t, index, names, bool(unique)))
            for _, _, target, own, to, *_ in db.execute(f"PRAGMA foreign_key_list({_quoted(t)})").fetchall():
                out["fks"].append((label, "main", t, own, target, to))
    return out
