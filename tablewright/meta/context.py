"""A catalog for readers: as JSON, as a text report, and as a folder of small texts; its topology and chunks of linked tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.meta import analysis
from tablewright.meta.analysis import KEY
from tablewright.meta.catalog import Catalog


def tables(c: Catalog) -> DataFrame:
    """A row for each table: row_count, columns (position order), indexes and foreign keys as arrays of structs."""
    listed = lambda df, name, *fields: df.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    out = c.tables.select(*KEY, "row_count").join(listed(c.columns, "columns", "position", "column", "type", "nullable", "default", "is_primary"), KEY, "left")
    out = out.join(listed(c.indexes, "indexes", "index", "columns", "is_unique"), KEY, "left")
    return out.join(listed(c.fks, "foreign_keys", "column", "to_table", "to_column"), KEY, "left")


def schema_json(c: Catalog) -> DataFrame:
    """(instance, db, table, json): a table's schema as one JSON text."""
    body = F.struct("instance", "db", "table", "row_count", *(F.coalesce(k, F.from_json(F.lit("[]"), t)).alias(k) for k, t in ((n, tables(c).schema[n].dataType) for n in ("columns", "indexes", "foreign_keys"))))
    return tables(c).select(*KEY, F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def topology(c: Catalog, refs: DataFrame, top: int = 15) -> DataFrame:
    """The ``top`` tables by their number of links, with what each refers to and what refers to it."""
    name = lambda side: F.concat_ws(".", f"{side}_table", f"{side}_column")
    out = refs.groupBy(*(F.col(f"from_{k}").alias(k) for k in KEY)).agg(F.array_sort(F.collect_set(F.concat(F.col("from_column"), F.lit(" -> "), name("to")))).alias("refers_to"))
    into = refs.groupBy(*(F.col(f"to_{k}").alias(k) for k in KEY)).agg(F.array_sort(F.collect_set(name("from"))).alias("referred_by"))
    none = F.array().cast("array<string>")
    t = c.tables.select(*KEY).join(out, KEY, "left").join(into, KEY, "left").select(*KEY, F.coalesce("refers_to", none).alias("refers_to"), F.coalesce("referred_by", none).alias("referred_by"))
    return t.withColumn("degree", F.size("refers_to") + F.size("referred_by")).orderBy(F.desc("degree"), *KEY).limit(top)


def chunks(c: Catalog, refs: DataFrame, most_columns: int = 120) -> DataFrame:
    """(chunk, part, instance, db, table, columns): tables of one component together, in parts of at most ``most_columns`` columns.

    A wider table is a part of its own. Tables are taken in order of importance within their component.
    """
    from pyspark.sql import Window

    found = analysis.components(analysis.table_nodes(c), analysis.edges(refs))
    width = c.columns.groupBy(*KEY).agg(F.count("*").alias("columns"))
    scored = analysis.rank(c, refs).select(*KEY, "score").join(width, KEY, "left").na.fill(0, ["columns"]).withColumn("node", F.concat_ws("/", *KEY)).join(found, "node")
    before = F.sum("columns").over(Window.partitionBy("root").orderBy(F.desc("score"), "node").rowsBetween(Window.unboundedPreceding, -1))
    return scored.select(F.col("root").alias("chunk"), F.floor(F.coalesce(before, F.lit(0)) / most_columns).cast("int").alias("part"), *KEY, "columns")


def report(c: Catalog, refs: DataFrame, top: int = 10) -> str:
    """A text report: sizes, the most important tables with their columns, links and findings. Bounded by ``top``."""
    n_tables, n_columns = c.tables.count(), c.columns.count()
    lines = [f"{n_tables} tables, {n_columns} columns, {refs.count()} references", ""]
    for r in analysis.summary(c, refs, top).collect():
        lines.append(f"{r.instance}.{r.db}.{r.table} ({r.score}): {', '.join(r.columns or [])}" + (f" -> {', '.join(r.refers_to)}" if r.refers_to else ""))
    found = analysis.lint(c).groupBy("severity", "rule").agg(F.count("*").alias("n")).orderBy("severity", "rule").collect()
    return "\n".join([*lines, "", *(f"{r.severity} {r.rule}: {r.n}" for r in found)]) + "\n"


def write_context(c: Catalog, refs: DataFrame, path: str, top: int = 10) -> None:
    """Writes a folder: schema (JSON lines), topology, chunks and the report, each as a data set that Spark's readers open."""
    spark = c.tables.sparkSession
    schema_json(c).select("json").write.mode("overwrite").text(f"{path}/schema")
    topology(c, refs).write.mode("overwrite").json(f"{path}/topology")
    chunks(c, refs).write.mode("overwrite").json(f"{path}/chunks")
    spark.createDataFrame([(line,) for line in report(c, refs, top).split("\n")], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")


def from_json(lines: list[str]) -> dict[str, list[tuple]]:
    """Rows for the metadata tables from schema JSON lines."""
    out: dict[str, list[tuple]] = {"tables": [], "columns": [], "indexes": [], "fks": []}
    for line in lines:
        t = json.loads(line)
        key = (t["instance"], t["db"], t["table"])
        out["tables"].append((*key, t["row_count"]))
        out["columns"] += [(*key, x["position"], x["column"], x["type"], x["nullable"], x["default"], x["is_primary"]) for x in t["columns"]]
        out["indexes"] += [(*key, x["index"], x["columns"], x["is_unique"]) for x in t["indexes"]]
        out["fks"] += [(*key, x["column"], x["to_table"], x["to_column"]) for x in t["foreign_keys"]]
    return out
