"""The query engine: labelled sources as views, one Spark plan per statement, guard, policy, row limit and result envelope."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tablewright.plans import dialect, guard, policy
from tablewright.sources.remote import Remote


@dataclass
class Result:
    """Rows of a statement, at most ``limit`` of them."""

    columns: list[str]
    types: list[str]
    rows: list[tuple]
    truncated: bool
    seconds: float
    stripped: list[str] = field(default_factory=list)

    @property
    def row_count(self) -> int:
        return len(self.rows)


@dataclass
class Planned:
    """A statement's DataFrame, the columns stripped from it, its parsed tree, and the labels of the sources it reads."""

    df: DataFrame
    stripped: list[str]
    parsed: object
    labels: list[str]


def own_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark``, with its settings and views of its own.

    ANSI errors are off there, so a predicate that can't be computed for a row, as a division by zero, is null and drops the
    row; in a projection such a value is null.
    """
    out = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    out.conf.set("spark.sql.ansi.enabled", "false")
    return out


class Engine:
    """Sources under labels; statements over one of them or across several.

    ``query`` plans a statement without running it; ``execute`` collects at most ``limit`` rows of the outermost result, never
    of an input. A statement's own LIMIT may go beyond that, up to ``most_rows``. Statements of a source label run one at a
    time; a second one is refused. Only registered tables can be read, whatever else the session knows, and Parquet or other
    files by path only below ``folder``.
    """

    def __init__(self, spark: SparkSession, rules: policy.Policy | None = None, max_rows: int = 1000, most_rows: int = 1_000_000, folder: str = ""):
        self.spark, self.rules, self.max_rows, self.most_rows, self.folder = own_session(spark), rules or policy.Policy(), max_rows, most_rows, folder.rstrip("/")
        self.sources: dict[str, dict[str, Callable[[], DataFrame]]] = {}
        self.remotes: dict[str, Remote] = {}
        self.locks: dict[str, threading.Lock] = {}

    def register(self, label: str, tables: dict[str, DataFrame | Callable[[], DataFrame]]) -> Engine:
        """Adds tables (or functions that load them) under ``label``; labels and names ignore case."""
        own = self.sources.setdefault(label.lower(), {})
        for name, df in tables.items():
            own[name.lower()] = (lambda df=df: df) if isinstance(df, DataFrame) else df
        self.locks.setdefault(label.lower(), threading.Lock())
        return self

    def attach(self, label: str, remote: Remote) -> Engine:
        """Adds a server under ``label``: its tables as ``@label.table``, its own language through ``ask`` and ``@label.promql(...)``."""
        self.remotes[label.lower()] = remote
        self.locks.setdefault(label.lower(), threading.Lock())
        return self

    def bind(self, label: str, table: str) -> DataFrame:
        own = self.sources.get(label.lower(), {})
        if table.lower() in own:
            return own[table.lower()]()
        if label.lower() in self.remotes:
            return self.remotes[label.lower()].table(self.spark, table)
        raise LookupError(f"no table {table} under label {label}")

    def check(self) -> dict[str, str]:
        """For each label, "" if all its tables can be planned, or else the first error; nothing is read."""
        out = {}
        for label, tables in self.sources.items():
            out[label] = ""
            for load in tables.values():
                try:
                    load().limit(0).schema  # noqa: B018
                except Exception as e:  # any source's error
                    out[label] = f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"
                    break
        return out

    def _view(self, name: str, df: DataFrame) -> None:
        """A view in the engine's own session, whatever session ``df`` is from."""
        plan = df._jdf.queryExecution().analyzed()
        own = self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan)
        own.createOrReplaceTempView(name)

    def _resolved(self, sql: str, text: str) -> tuple[str, dict[str, str], list[DataFrame]]:
        """``text`` with views in the place of tables; label.table of each view; the tables read."""
        names: dict[str, str] = {}
        read: list[DataFrame] = []

        def add(view: str, label: str, table: str, df: DataFrame) -> None:
            self._view(view, df)
            names[view.lower()] = f"{label.lower()}.{table.lower()}"
            read.append(df)

        for label, expression in dialect.promql_calls(sql):
            add(dialect.view_name(label, f"promql({expression})"), label, "promql", self._asked(label, expression))
        for label, table in dialect.references(sql):
            add(dialect.view_name(label, table), label, table, self.bind(label, table))
        edits = set()
        for node, parts, aliased in guard.relations(guard.parse(self.spark, text)):
            origin = node.origin()
            start, stop = origin.startIndex().get(), origin.stopIndex().get()
            if parts[0].lower() in names:
                continue
            label, table = next(((x, parts[0].lower()) for x, tables in self.sources.items() if len(parts) == 1 and parts[0].lower() in tables), ("", ""))
            if not label and len(parts) == 2 and self.folder and parts[1].startswith(f"{self.folder}/") and ".." not in parts[1].split("/"):
                continue  # files below the allowed folder
            if not label:
                raise policy.PolicyError(f"{'.'.join(parts)} isn't a table of this engine")
            view = dialect.view_name(label, table)
            if view.lower() not in names:
                add(view, label, table, self.bind(label, table))
            edits.add((start, stop + 1, f"`{view}`" + ("" if aliased else f" AS `{parts[0]}`")))
        for start, stop, new in sorted(edits, reverse=True):
            text = text[:start] + new + text[stop:]
        return text, names, read

    def query(self, sql: str) -> DataFrame:
        """The DataFrame of a read-only statement, after policy."""
        return self._planned(sql).df

    def _planned(self, sql: str) -> Planned:
        guard.check_read_only(self.spark, dialect.to_spark(sql))
        _, names, read = self._resolved(sql, dialect.to_spark(sql))
        texts = frozenset(c.lower() for df in read for c, kind in df.dtypes if kind == "string") - frozenset(c.lower() for df in read for c, kind in df.dtypes if kind != "string")
        text = dialect.to_spark(sql, texts)
        parsed = guard.check_read_only(self.spark, text)
        text, names, _ = self._resolved(sql, text)
        df = self.spark.sql(text)
        target = self.spark.sql(dialect.text_of(_inner(dialect.tokens_of(text)))) if guard.explained(parsed) else df
        gone = policy.check(target, text, self.rules, names)
        if not guard.explained(parsed):
            df = policy.mask_columns(df, self.rules.mask_columns, self.rules.mask, names) if self.rules.mask_columns else df
            df = df.drop(*gone) if gone else df
        return Planned(df, gone, parsed, sorted({n.split(".", 1)[0] for n in names.values()}))

    def _asked(self, label: str, text: str) -> DataFrame:
        """What a server answers to a request in its own language, after its read-only check and the policy's rules."""
        if label.lower() not in self.remotes:
            raise LookupError(f"no server under label {label}")
        remote = self.remotes[label.lower()]
        tables, columns = remote.check(text)
        policy.check_native(self.rules, tables, columns)
        df = remote.ask(self.spark, text)
        return policy.mask_native(df, columns, self.rules)

    @contextmanager
    def _locked(self, labels: list[str]) -> Iterator[None]:
        held = []
        try:
            for label in labels:
                lock = self.locks.setdefault(label, threading.Lock())
                if not lock.acquire(blocking=False):
                    raise BlockingIOError(f"a statement on {label} is running")
                held.append(lock)
            yield
        finally:
            for lock in held:
                lock.release()

    def execute(self, sql: str, limit: int | None = None, timeout: float | None = None) -> Result:
        """Runs a statement. Without a limit of its own at most ``limit`` (``max_rows``) rows come back; a timeout cancels its jobs."""
        began = time.monotonic()
        planned = self._planned(sql)
        with self._locked(planned.labels):
            return self._collected(planned.df, guard.has_limit(planned.parsed), planned.stripped, began, limit, timeout)

    def ask(self, label: str, text: str, limit: int | None = None, timeout: float | None = None) -> Result:
        """Runs a request in a server's own language: SQL, PromQL, a search body, a command."""
        began = time.monotonic()
        with self._locked([label.lower()]):
            df = self._asked(label, text)
            gone = [c for c in df.columns if any(policy.matches(p.rsplit(".", 1)[-1], c) for p in self.rules.deny_columns)]
            return self._collected(df.drop(*gone), False, gone, began, limit, timeout)

    def _collected(self, df: DataFrame, own_limit: bool, gone: list[str], began: float, limit: int | None, timeout: float | None) -> Result:
        most = self.most_rows if own_limit else limit if limit is not None else self.max_rows
        tag = f"tablewright-{uuid.uuid4().hex}"
        timer = threading.Timer(timeout, lambda: self.spark.interruptTag(tag)) if timeout else None
        if timer:
            timer.start()
        self.spark.addTag(tag)
        try:
            rows = df.limit(most + 1).collect()
        finally:
            self.spark.removeTag(tag)
            if timer:
                timer.cancel()
        if own_limit and len(rows) > most:
            raise ValueError(f"more than {most} rows: take them with query(), which leaves them on the executors")
        return Result(df.columns, [f.dataType.simpleString() for f in df.schema], [tuple(r) for r in rows[:most]], len(rows) > most, time.monotonic() - began, gone)


def _inner(tokens: list[dialect.Token]) -> list[dialect.Token]:
    """What an EXPLAIN explains."""
    k = 1
    while k < len(tokens) and tokens[k].key in ("EXTENDED", "FORMATTED", "CODEGEN", "COST"):
        k += 1
    return tokens[k:]
