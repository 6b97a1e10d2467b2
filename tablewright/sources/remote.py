"""Servers behind labels: what a request in a server's own language names, whether it only reads, and its answer as a DataFrame."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tablewright.sources import jdbc, services, sqlite
from tablewright.sources.dsn import SQL_KINDS, Dsn

#: Words that a table's name follows in the SQL of any server.
BEFORE_TABLES = frozenset("FROM JOIN TABLE DESC DESCRIBE INTO UPDATE".split())


@dataclass(frozen=True)
class Remote:
    """A server at an address. ``client``: a MongoDB client of its own (tests); others are made on demand."""

    dsn: Dsn
    client: object = None

    @property
    def base(self) -> str:
        scheme = "https" if self.dsn.options.get("tls", "") in ("1", "true") else "http"
        return f"{scheme}://{self.dsn.host}:{self.dsn.port}"

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """A table, index, collection or metric as a DataFrame; filters go down where the server's reader has that."""
        kind = self.dsn.kind
        if kind == "sqlite":
            return sqlite.read_table(spark, self.dsn.database, name)
        if kind in SQL_KINDS:
            return jdbc.read_table(spark, self.dsn, name)
        if kind == "prometheus":
            return services.read_prometheus(spark, self.base, name)
        if kind == "elasticsearch":
            return services.read_elastic(spark, self.base, "{}", name)
        if kind == "mongo":
            return services.read_mongo(spark, self.dsn, json.dumps({"find": name}), self.client)
        if kind == "redis":
            return services.redis_keys(spark, self.dsn.host, self.dsn.port, name)
        raise LookupError(f"{kind} has no tables")

    def check(self, text: str) -> tuple[list[str], list[str]]:
        """(tables, columns) that a request names; an error if it doesn't only read. Names of SQL are all its identifiers."""
        kind = self.dsn.kind
        if kind in SQL_KINDS:
            from tablewright.plans.native import check_native

            tokens = check_native(text)
            plain = [t.text.strip('`"[]') for t in tokens if t.kind in ("word", "quoted", "string")]
            after = [b.text.strip('`"') for a, b in zip(tokens, tokens[1:], strict=False) if a.key in BEFORE_TABLES or a.text in (",", ".")]
            return after, plain
        if kind == "prometheus":
            from tablewright.plans.policy import promql_names

            return promql_names(text)
        if kind == "mongo":
            spec = services.check_mongo(text)
            return [spec.get("find") or spec["aggregate"], *services.mongo_joined(spec)], services.mongo_fields(spec)
        if kind == "redis":
            return services.redis_named(services.check_redis(text)), []
        if kind == "qdrant":
            return [services.qdrant_request(text)[1]], []
        if kind == "elasticsearch":
            return services.elastic_names(text)
        raise LookupError(f"{kind} takes no requests")

    def ask(self, spark: SparkSession, text: str) -> DataFrame:
        """The answer to a request that ``check`` has passed."""
        kind, d = self.dsn.kind, self.dsn
        if kind == "sqlite":
            return sqlite.read_query(spark, d.database, text)
        if kind in SQL_KINDS:
            return jdbc.read_query(spark, d, text)
        if kind == "prometheus":
            return services.read_prometheus(spark, self.base, text)
        if kind == "mongo":
            return services.read_mongo(spark, d, text, self.client)
        if kind == "redis":
            return services.read_redis(spark, d.host, d.port, text)
        if kind == "qdrant":
            return services.read_qdrant(spark, self.base, text)
        if kind == "elasticsearch":
            body = json.loads(text) if text.lstrip().startswith("{") else {}
            return services.read_elastic(spark, self.base, json.dumps({k: v for k, v in body.items() if k != "index"}) if body else text, body.get("index", ""))
        raise LookupError(f"{kind} takes no requests")
