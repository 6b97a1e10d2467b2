"""Relational operators over DataFrames where Spark's own need a convention: null order, first rows per key, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def sort_key(spec: str) -> Column:
    """``name``, ``name asc|desc``, ``... nulls first|last``; nulls come last ascending and first descending by default."""
    name, *rest = spec.split()
    rest = [x.lower() for x in rest]
    down = "desc" in rest
    first = "first" in rest if "nulls" in rest else down
    c = F.col(name)
    return (c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last())


def sort(df: DataFrame, *specs: str) -> DataFrame:
    return df.orderBy(*map(sort_key, specs))


def page(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Skips ``offset`` rows, then takes ``limit``. After ``sort`` Spark plans a top-k, not a full sort."""
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def distinct_on(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``; rows that tie in it need a further key to be told apart.

    One order column of a plain type and few columns are better off as an aggregate; the window spills, so any group size works.
    """
    w = Window.partitionBy(*keys).orderBy(*map(sort_key, order))
    return df.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def semi(df: DataFrame, other: DataFrame, on: str, other_on: str | None = None) -> DataFrame:
    """Rows whose ``on`` occurs in ``other``."""
    return df.join(other.select(F.col(other_on or on).alias(on)), on, "left_semi")


def anti(df: DataFrame, other: DataFrame, on: str, other_on: str | None = None) -> DataFrame:
    """Rows whose ``on`` doesn't occur in ``other``; a null there hides no row, and a row with a null stays."""
    return df.join(other.select(F.col(other_on or on).alias(on)), on, "left_anti")


def rows_frame(partition: list[str], order: list[str], low: int | None, high: int | None) -> WindowSpec:
    """A ROWS window; None is unbounded."""
    w = Window.partitionBy(*partition).orderBy(*map(sort_key, order))
    return w.rowsBetween(Window.unboundedPreceding if low is None else low, Window.unboundedFollowing if high is None else high)


def clamped_first(value: Column, standard: Column, partition: list[str], order: list[str]) -> Column:
    """A frame aggregate whose empty frames take the partition's first value, as clamped frames have it."""
    return F.coalesce(standard, F.first(value).over(rows_frame(partition, order, None, None)))


def group(df: DataFrame, by: list[str], having: Column | str | None = None, **aggregates: Column) -> DataFrame:
    """Groups with named aggregates; without aggregates the distinct keys. ``having`` may name an aggregate."""
    out = df.groupBy(*by).agg(*(c.alias(n) for n, c in aggregates.items())) if aggregates else df.select(*by).distinct()
    return out if having is None else out.where(having)


def over_partition(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """``df`` with aggregates over the whole of each row's partition, null keys being one: what an unframed window gives.

    The aggregate combines before it shuffles and its result joins back, broadcast while it is small, so the rows of a hot key
    never meet in one task.
    """
    if not keys:
        return df.crossJoin(df.agg(*(c.alias(n) for n, c in aggregates.items())))
    names = {k: f"__key{n}" for n, k in enumerate(keys)}
    whole = df.groupBy(*(F.col(k).alias(n) for k, n in names.items())).agg(*(c.alias(n) for n, c in aggregates.items()))
    on = None
    for k, n in names.items():
        same = df[k].eqNullSafe(whole[n])
        on = same if on is None else on & same
    return df.join(whole, on, "left").drop(*names.values())


def union(*parts: DataFrame, distinct: bool = False) -> DataFrame:
    """By position, with the first part's names."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.distinct() if distinct else out
