"""Delimited files and Parquet, and the sampled types that schema collection reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import scalars

#: Names of delimiters, and encodings with the name Java has for each.
DELIMITERS = {"comma": ",", "tab": "\t", "pipe": "|", "semicolon": ";", "": ","}
ENCODINGS = {"": "UTF-8", "utf-8": "UTF-8", "utf8": "UTF-8", "gbk": "GBK", "gb2312": "GB2312", "gb18030": "GB18030"}
SPARK_TYPES = {"INTEGER": T.LongType(), "FLOAT": T.DoubleType(), "DATE": T.TimestampNTZType(), "TEXT": T.StringType()}
SAMPLE = 100


def read_delimited(spark: SparkSession, path: str | list[str], delimiter: str = "", encoding: str = "", typed: bool = True, multiline: bool | None = None) -> DataFrame:
    """A file, folder, glob or list of files as one table.

    The first file's header names the columns; further files are read by position. Blank cells are null, quotes are lenient,
    short rows are filled with null and long ones cut, a byte order mark is dropped. ``typed``: a column is cast to the first
    type that all its cells fit, which takes a pass over the files; no cell is lost. ``multiline``: whether a quoted cell may
    hold line ends, when a file is one task; by default that is looked up in the same files first, by lines with an odd number
    of quotes. Encodings other than UTF-8 need a legacy setting of Spark, which is set on the session.
    """
    sep, charset = DELIMITERS.get(delimiter.lower(), delimiter), ENCODINGS[encoding.lower()]
    if not charset.startswith("UTF"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    first = spark.read.format("binaryFile").load(path).agg(F.min("path")).first()[0]
    if first is None:
        raise FileNotFoundError(str(path))
    if multiline is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multiline = bool(spark.read.option("encoding", charset).text(path).where(quotes % 2 == 1).limit(1).count())
    options = {"sep": sep, "encoding": charset, "quote": '"', "escape": '"', "multiLine": multiline, "nullValue": "", "emptyValue": "", "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    lines = spark.read.options(header=False, **options).csv(first).limit(1).collect()
    names = _header([(x or "").lstrip("﻿") for x in lines[0]]) if lines else ["_c0"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.options(header=True, enforceSchema=True, **options).schema(schema).csv(path)
    return cast_by_cells(df) if typed else df


def _header(names: list[str]) -> list[str]:
    """Names made unique, ignoring case; blank ones by position."""
    out: list[str] = []
    seen: set[str] = set()
    for k, n in enumerate(names):
        n = n.strip() or f"column_{k + 1}"
        base, m = n, 2
        while n.lower() in seen:
            n, m = f"{base}_{m}", m + 1
        seen.add(n.lower())
        out.append(n)
    return out


def sampled_types(df: DataFrame, sample: int = SAMPLE) -> dict[str, str]:
    """INTEGER, FLOAT, DATE or TEXT for each column, from the first rows: what schema collection reports."""
    return cell_types(df.limit(sample))


def cell_types(df: DataFrame) -> dict[str, str]:
    """INTEGER, FLOAT, DATE or TEXT for each column, the first that all its cells fit."""
    row = df.agg(*(scalars.inferred_type(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(df.columns))).first()
    return dict(zip(df.columns, row, strict=True))


def cast_by_cells(df: DataFrame) -> DataFrame:
    """Text columns cast to the types that all their cells fit; the words NULL and null count as blank in such a column.

    A whole number beyond 64 bits makes its column FLOAT.
    """
    out = []
    for name, kind in cell_types(df).items():
        c = F.col(f"`{name}`")
        if kind == "DATE":
            text = F.trim(c)
            cast = F.coalesce(*(F.try_to_timestamp(F.when(scalars.is_date(text), text), F.lit(p)) for p in scalars.DATE_LAYOUTS)).cast("timestamp_ntz")
        else:
            cast = {"INTEGER": scalars.to_integer(c), "FLOAT": scalars.to_number(c)}.get(kind, c)
        out.append(cast.alias(name))
    return df.select(*out)


def read_parquet(spark: SparkSession, path: str, allowed: str | None = None) -> DataFrame:
    """Parquet below ``allowed``, if that is given."""
    if allowed is not None and (".." in path.split("/") or not path.startswith(allowed.rstrip("/") + "/")):
        raise PermissionError(f"{path} lies outside {allowed}")
    return spark.read.parquet(path)
