"""Analytics over schema facts, set-based: references, clusters, ranks, findings, fingerprints, deltas, diffs and the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import scalars
from tablewright.meta.catalog import Catalog

KEY = ["instance", "db", "table"]
REFS = ["from_instance", "from_db", "from_table", "from_column", "to_instance", "to_db", "to_table", "to_column", "inferred", "confidence"]
#: Weights of the factors that rank tables.
WEIGHTS = {"graph_degree": 0.30, "fk_centrality": 0.30, "row_count": 0.18, "index_density": 0.07, "write_intensity": 0.10, "query_frequency": 0.05}
WIDE = 30
#: What follows a cluster's common prefix, or its size.
CLUSTER_NAMES = ("* cluster", "-table cluster")


def declared_refs(c: Catalog) -> DataFrame:
    own = c.fks
    return own.select(F.col("instance").alias("from_instance"), F.col("db").alias("from_db"), F.col("table").alias("from_table"), F.col("column").alias("from_column"), F.col("instance").alias("to_instance"), F.col("db").alias("to_db"), "to_table", "to_column", F.lit(False).alias("inferred"), F.lit(100).alias("confidence"))


def infer_refs(c: Catalog) -> DataFrame:
    """References by name: ``*_id``, ``*id`` and ``*_fk`` columns that aren't primary or declared keys point at the table of their stem.

    The stem itself comes before its plurals in s and es; a target needs a primary key or a column id; of several targets the
    same database comes first, then the same instance. Confidence: 85, 70, otherwise 55.
    """
    low = F.lower("column")
    stem = F.when(low.endswith("_id"), F.regexp_replace(low, "_id$", "")).when(low.endswith("id") & (F.length(low) > 2), F.regexp_replace(low, "[_-]*id$", "")).when(low.endswith("_fk"), F.regexp_replace(low, "_fk$", ""))
    wanted = c.columns.where(~F.col("is_primary")).join(c.fks.select(*KEY, "column"), [*KEY, "column"], "left_anti").select(*KEY, "column", stem.alias("stem")).where("stem != ''")
    keys = c.columns.groupBy(*KEY).agg(F.min_by(low, "position").alias("first"), F.min(F.when(F.col("is_primary"), F.struct("position", low.alias("name")))).alias("primary"), F.max(low == "id").alias("has_id"))
    targets = keys.select(F.col("instance").alias("to_instance"), F.col("db").alias("to_db"), F.col("table").alias("to_table"), F.coalesce("primary.name", F.when(F.col("has_id"), "id")).alias("to_column"))
    named = wanted.select("*", F.posexplode(F.array("stem", F.concat("stem", F.lit("s")), F.concat("stem", F.lit("es")))).alias("plural", "name"))
    met = named.join(targets, F.lower("to_table") == F.col("name"))
    near = F.when((F.col("to_instance") == F.col("instance")) & (F.col("to_db") == F.col("db")), 85).when(F.col("to_instance") == F.col("instance"), 70).otherwise(55)
    first = Window.partitionBy(*KEY, "column").orderBy("plural", F.desc("confidence"), "to_instance", "to_db", "to_table")
    best = met.withColumn("confidence", near).where("to_column IS NOT NULL").withColumn("place", F.row_number().over(first)).where("place = 1")
    return best.select(F.col("instance").alias("from_instance"), F.col("db").alias("from_db"), F.col("table").alias("from_table"), F.col("column").alias("from_column"), "to_instance", "to_db", "to_table", "to_column", F.lit(True).alias("inferred"), "confidence")


def all_refs(c: Catalog) -> DataFrame:
    return declared_refs(c).unionByName(infer_refs(c))


def _node(side: str) -> Column:
    return F.concat_ws("/", *(f"{side}_{k}" for k in KEY))


def edges(refs: DataFrame) -> DataFrame:
    """(a, b) for each reference, by instance/db/table."""
    return refs.select(_node("from").alias("a"), _node("to").alias("b"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links reach.

    Every round takes the least label around and then that label's own; nodes without links take no part in it. Rounds end
    when a checksum of the labels stays the same.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct().checkpoint()
    now, mark = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node"), None
    while True:
        around = both.join(now, both["b"] == now["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = now.join(around, now["node"] == around["a"]).select("node", F.least("root", "near").alias("root"))
        now = step.join(step.select(F.col("node").alias("root"), F.col("root").alias("next")), "root").select("node", F.least("root", "next").alias("root")).checkpoint()
        last, mark = mark, now.agg(F.sum(F.xxhash64("node", "root").cast("decimal(38, 0)"))).first()[0]
        if mark == last:
            return nodes.select("node").distinct().join(now, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def table_nodes(c: Catalog) -> DataFrame:
    return c.tables.select(F.concat_ws("/", *KEY).alias("node"))


def clusters(c: Catalog, refs: DataFrame) -> DataFrame:
    """Groups of linked tables: root, members (sorted), size and a name from the members' common prefix."""
    found = components(table_nodes(c), edges(refs))
    grouped = found.groupBy("root").agg(F.array_sort(F.collect_list("node")).alias("members"), F.count("*").alias("size"))
    names = F.transform("members", lambda m: F.element_at(F.split(m, "/"), -1))
    first = names[0]
    lengths = F.sequence(F.lit(0), F.length(first))
    common = F.array_max(F.filter(lengths, lambda n: F.forall(names, lambda m: F.substring(m, F.lit(1), n) == F.substring(first, F.lit(1), n))))
    raw = F.substring(first, F.lit(1), common)
    cut = F.when(raw.rlike("[_-]$"), F.regexp_replace(raw, "[_-]$", "")).when(raw.rlike("[_-]"), F.regexp_replace(raw, "[_-][^_-]*$", "")).otherwise(raw)
    name = F.when(F.col("size") == 1, first).when(cut != "", F.concat(cut, F.lit(CLUSTER_NAMES[0]))).otherwise(F.concat(F.col("size").cast("string"), F.lit(CLUSTER_NAMES[1])))
    return grouped.select("root", "members", "size", name.alias("name"))


def rank(c: Catalog, refs: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Tables by importance: weighted factors from 0 to 1, factors that nothing is known of left out. ``stats``: instance, db, table, write_intensity, query_count."""
    ends = refs.select(_node("from").alias("node"), F.lit(0).alias("into")).unionByName(refs.select(_node("to").alias("node"), F.lit(1).alias("into")))
    degree = ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("into").alias("into"))
    width = c.columns.groupBy(*KEY).agg(F.count("*").alias("n_columns"))
    indexes = c.indexes.groupBy(*KEY).agg(F.count("*").alias("n_indexes"))
    t = c.tables.join(width, KEY, "left").join(indexes, KEY, "left").withColumn("node", F.concat_ws("/", *KEY)).join(degree, "node", "left").na.fill(0)
    if stats is not None:
        t = t.join(stats, KEY, "left").na.fill(0)
    else:
        t = t.withColumns({"write_intensity": F.lit(0.0), "query_count": F.lit(0).cast("long")})
    most = t.agg(*(F.greatest(F.max(k), F.lit(1)).alias(f"most_{k}") for k in ("degree", "into", "row_count")))
    log = lambda n, top: F.when(n <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log10(n + 1.0) / F.log10(top + 1.0)))
    t = t.crossJoin(F.broadcast(most)).withColumns({"graph_degree": F.col("degree") / F.col("most_degree"), "fk_centrality": F.col("into") / F.col("most_into"), "row_factor": log(F.col("row_count"), F.col("most_row_count")), "index_density": F.least(F.lit(1.0), F.when(F.col("n_columns") > 0, F.col("n_indexes") / F.col("n_columns")).otherwise(0.0)), "query_frequency": log(F.col("query_count"), F.lit(10000))})
    known = t.agg(*(F.max(F.col(k) > 0).alias(f"has_{k}") for k in ("write_intensity", "query_frequency")))
    t = t.crossJoin(F.broadcast(known))
    column = {"row_count": "row_factor"}
    weight = {k: F.when(F.col(f"has_{k}"), w).otherwise(0.0) if f"has_{k}" in t.columns else F.lit(w) for k, w in WEIGHTS.items()}
    whole = sum(weight.values(), F.lit(0.0))
    score = sum((weight[k] * F.col(column.get(k, k)) for k in WEIGHTS), F.lit(0.0)) / whole
    return t.select(*KEY, scalars.round_scaled(score, 3).alias("score"), "graph_degree", "fk_centrality", F.col("row_factor").alias("row_count"), "index_density", "write_intensity", "query_frequency").orderBy(F.desc("score"), *KEY)


def lint(c: Catalog, capabilities: set[str] = frozenset({"foreign_key", "index"})) -> DataFrame:
    """Findings (instance, db, table, severity, rule, detail), each rule only where the source has what it is about."""
    finding = lambda severity, rule, detail: [F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), detail.cast("string").alias("detail")]
    by_table = c.columns.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("is_primary").alias("keyed"), F.max(F.lower("column").rlike("created|updated|time")).alias("timed"))
    out = by_table.where(f"n > {WIDE}").select(*KEY, *finding("info", "wide_table", F.col("n")))
    out = out.unionByName(by_table.where("NOT keyed").select(*KEY, *finding("warn", "missing_primary_key", F.lit(""))))
    if {"foreign_key", "index"} <= set(capabilities):
        indexed = c.indexes.select(*KEY, F.explode("columns").alias("column")).select(*KEY, F.lower("column").alias("low"))
        bare = c.fks.select(*KEY, F.lower("column").alias("low")).distinct().join(indexed, [*KEY, "low"], "left_anti")
        out = out.unionByName(bare.select(*KEY, *finding("warn", "unindexed_foreign_key", F.col("low"))))
    if "foreign_key" in capabilities and "partition" not in capabilities:
        out = out.unionByName(by_table.where("n >= 3 AND NOT timed").select(*KEY, *finding("info", "no_timestamp", F.lit(""))))
    return out


def _digest(parts: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(parts), "|"), 256)


def fingerprints(c: Catalog) -> DataFrame:
    """One row per table: hashes of its columns, indexes and foreign keys, without regard to order and case."""
    columns = c.columns.groupBy(*KEY).agg(_digest(F.collect_list(F.lower(F.concat_ws(":", "column", "type", F.col("nullable").cast("string"), F.col("is_primary").cast("string"))))).alias("col_hash"))
    indexes = c.indexes.groupBy(*KEY).agg(_digest(F.collect_list(F.lower(F.concat_ws(":", "index", F.array_join("columns", ","), F.col("is_unique").cast("string"))))).alias("index_hash"))
    fks = c.fks.groupBy(*KEY).agg(_digest(F.collect_list(F.lower(F.concat_ws(":", "column", "to_table", "to_column")))).alias("fk_hash"))
    none = F.sha2(F.lit(""), 256)
    out = c.tables.select(*KEY).join(columns, KEY, "left").join(indexes, KEY, "left").join(fks, KEY, "left")
    return out.select(*KEY, *(F.coalesce(h, none).alias(h) for h in ("col_hash", "index_hash", "fk_hash")))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables added, removed or changed between two sets of fingerprints."""
    hashes = ["col_hash", "index_hash", "fk_hash"]
    a, b = before.select(*KEY, F.struct(*hashes).alias("was")), after.select(*KEY, F.struct(*hashes).alias("now"))
    both = a.join(b, KEY, "full")
    how = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select(*KEY, how.alias("change")).where("change IS NOT NULL")


def diff_columns(before: Catalog, after: Catalog) -> DataFrame:
    """Field-level changes of columns: change (added, removed, changed), field, old and new value; names and types ignore case."""
    fields = ["type", "nullable", "default", "is_primary", "position"]

    def side(c: Catalog, name: str) -> DataFrame:
        values = [F.lower(F.col(f).cast("string")) if f == "type" else F.col(f).cast("string") for f in fields]
        return c.columns.select(*KEY, F.lower("column").alias("low"), F.array(*values).alias(name))

    both = side(before, "was").join(side(after, "now"), [*KEY, "low"], "full")
    parts = F.explode(F.arrays_zip(F.array(*map(F.lit, fields)).alias("field"), F.col("was").alias("old"), F.col("now").alias("new")))
    changed = both.where("was IS NOT NULL AND now IS NOT NULL").select(*KEY, F.col("low").alias("column"), parts.alias("p")).where("NOT (p.old <=> p.new)").select(*KEY, "column", F.lit("changed").alias("change"), F.col("p.field").alias("field"), F.col("p.old").alias("old"), F.col("p.new").alias("new"))
    whole = both.where("was IS NULL OR now IS NULL").select(*KEY, F.col("low").alias("column"), F.when(F.col("was").isNull(), "added").otherwise("removed").alias("change"), F.lit("type").alias("field"), F.col("was")[0].alias("old"), F.col("now")[0].alias("new"))
    return changed.unionByName(whole)


def _diff_sets(before: DataFrame, after: DataFrame, key: list[str], value: Column) -> DataFrame:
    a = before.select(*KEY, *(F.lower(k).alias(k) for k in key), F.lower(value).alias("old"))
    b = after.select(*KEY, *(F.lower(k).alias(k) for k in key), F.lower(value).alias("new"))
    how = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, [*KEY, *key], "full").select(*KEY, *key, how.alias("change"), "old", "new").where("change IS NOT NULL")


def diff_indexes(before: Catalog, after: Catalog) -> DataFrame:
    return _diff_sets(before.indexes, after.indexes, ["index"], F.concat_ws(":", F.array_join("columns", ","), F.col("is_unique").cast("string")))


def diff_fks(before: Catalog, after: Catalog) -> DataFrame:
    return _diff_sets(before.fks, after.fks, ["column"], F.concat_ws(".", "to_table", "to_column"))


def graph(c: Catalog, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, kind) of instances, databases, tables and columns; edges (a, b, kind): contains, declared and inferred references."""
    path = lambda *k: F.concat_ws("/", *k)
    t, col = c.tables, c.columns
    nodes = t.select(F.col("instance").alias("node"), F.lit("instance").alias("kind")).unionByName(t.select(path("instance", "db").alias("node"), F.lit("database").alias("kind"))).unionByName(t.select(path(*KEY).alias("node"), F.lit("table").alias("kind"))).unionByName(col.select(path(*KEY, "column").alias("node"), F.lit("column").alias("kind")))
    contains = t.select(F.col("instance").alias("a"), path("instance", "db").alias("b")).unionByName(t.select(path("instance", "db").alias("a"), path(*KEY).alias("b"))).unionByName(col.select(path(*KEY).alias("a"), path(*KEY, "column").alias("b"))).withColumn("kind", F.lit("contains"))
    links = refs.select(_node("from").alias("a"), _node("to").alias("b"), F.when(F.col("inferred"), "inferred_ref").otherwise("declared_fk").alias("kind"))
    return nodes.distinct(), contains.distinct().unionByName(links)


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, degree); 0 for isolated nodes."""
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
    return nodes.select("node").distinct().join(ends, "node", "left").na.fill(0, ["degree"])


def neighbors(links: DataFrame) -> DataFrame:
    """(node, neighbor), both ways, once each."""
    return links.select(F.col("a").alias("node"), F.col("b").alias("neighbor")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("neighbor"))).distinct()


def isolated(nodes: DataFrame, links: DataFrame) -> DataFrame:
    return nodes.select("node").distinct().join(neighbors(links), "node", "left_anti")


def has_edge(links: DataFrame, a: str, b: str) -> bool:
    return bool(neighbors(links).where((F.col("node") == a) & (F.col("neighbor") == b)).limit(1).count())


def summary(c: Catalog, refs: DataFrame, top: int = 10) -> DataFrame:
    """The most important tables with their columns and the tables they refer to."""
    columns = c.columns.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "column"))), lambda x: x["column"]).alias("columns"))
    to = refs.groupBy(*(F.col(f"from_{k}").alias(k) for k in KEY)).agg(F.array_sort(F.collect_set("to_table")).alias("refers_to"))
    return rank(c, refs).limit(top).select(*KEY, "score").join(columns, KEY, "left").join(to, KEY, "left").withColumn("refers_to", F.coalesce("refers_to", F.array().cast("array<string>"))).orderBy(F.desc("score"), *KEY)


def key_families(keys: DataFrame, column: str = "key") -> DataFrame:
    """(pattern, n, example): keys grouped by family, largest first."""
    return keys.groupBy(scalars.key_family(F.col(column)).alias("pattern")).agg(F.count("*").alias("n"), F.min(column).alias("example")).orderBy(F.desc("n"), "pattern")
